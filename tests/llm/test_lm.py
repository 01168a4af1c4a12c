"""Language-model scores: the base against brute force, the attention model by its gradient, against a plain loop, and on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from noctua.llm import bpe, lm
from tests.llm import edge

CODER = lm.coder_of(bpe.read_ranks(P.path(lm.RANKS)))


def brute(rows):
    held = {id(r): zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows}
    counts = Counter()
    for r in rows:
        if not held[id(r)]:
            counts.update(lm.words_of(r.text) + ["end"])
    n, v = counts.total(), len(counts)
    for r in rows:
        tokens = lm.words_of(r.text) + ["end"]
        yield r.doc_id, held[id(r)], len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)


def scored(docs):
    prepared = lm.prepare(docs)
    counts = lm.count_words(prepared)
    return lm.score(prepared, counts, lm.fit(prepared)), counts


@pytest.mark.parametrize("top, held", [(300_000, 400_000), (5, 10)])
def test_base_against_brute_force(spark, monkeypatch, top, held):
    """With few words sent to the tasks, the others come by the join."""
    monkeypatch.setattr(lm, "TOP", top)
    monkeypatch.setattr(lm, "HELD", held)
    docs = edge.documents(spark)
    found, counts = scored(docs)
    key = lambda r: (str(r[0]), r[2], r[5])
    own = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, counts.total, r.base_score) for r in found.collect()), key=key)
    wanted = sorted(brute(docs.collect()), key=key)
    assert [x[:5] for x in own] == [x[:5] for x in wanted]
    assert [x[5] for x in own] == pytest.approx([x[5] for x in wanted])


def test_no_rows(spark):
    found, counts = scored(edge.documents(spark, empty=True))
    assert found.count() == 0 and (counts.total, counts.distinct) == (0, 0)
    # nothing learned: scores are those of the start
    empty = lm.prepare(edge.documents(spark, empty=True))
    rows = lm.score(lm.prepare(edge.documents(spark)), lm.count_words(empty), lm.fit(empty)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and np.isfinite(r.score) and r.score < 0 for r in rows)


def plain_log10(w, vocab, ids):
    """The log10 probability of one text, place by place, in plain Python."""
    width, row = lm.WIDTH, [int(vocab.row_of[i]) for i in [vocab.end, *ids[:-1]]]
    turn = lambda x, m: [math.fsum(x[i] * float(m[i][j]) for i in range(width)) for j in range(len(m[0]))]
    total = 0.0
    for t, target in enumerate(ids):
        window = 0 if t < lm.WINDOW else -(-(t + 1 - lm.WINDOW) // lm.STRIDE)
        begin = window * lm.STRIDE
        e = [[float(a) + float(b) for a, b in zip(w["e"][row[i]], w["p"][i - begin])] for i in range(begin, t + 1)]
        q, keys, values = (turn(e[-1], w["w"][:, :width]), *([turn(x, w["w"][:, k * width : (k + 1) * width]) for x in e] for k in (1, 2)))
        seen = [math.exp(sum(a * b for a, b in zip(q, k)) / math.sqrt(width)) for k in keys]
        mixed = [sum(s * v[j] for s, v in zip(seen, values)) / sum(seen) for j in range(width)]
        o = [a + b for a, b in zip(e[-1], turn(mixed, w["o"]))]
        group, member = divmod(int(vocab.class_of[target]), lm.MEMBERS)
        first = [math.exp(a + float(b)) for a, b in zip(turn(o, w["u"]), w["b"])]
        second = [math.exp(a + float(b)) for a, b in zip(turn(o, w["c"][group]), w["d"][group])]
        total += math.log10(first[group] / sum(first)) + math.log10(second[member] / sum(second)) + float(vocab.inner[target]) / math.log(10)
    return total


def test_query_against_plain_loops(spark, sf_dir, monkeypatch):
    """The registered query: base against brute force, and the model that it fits against plain loops."""
    models, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    found = {r.doc_id: r for r in lm.op10_lm_scores(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc, held, tokens, known, n, base in brute(docs):
        r = found[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base)
    w, vocab = lm.unpack(models[0].weights), models[0].vocab
    for r in sorted(docs, key=lambda r: len(r.text or ""))[:12] + sorted(docs, key=lambda r: len(r.text or ""))[60:66]:
        ids = [*CODER.ids(lm.words_of(r.text)).tolist(), vocab.end]
        assert found[r.doc_id].score == pytest.approx(plain_log10(w, vocab, ids), rel=1e-3)


def tiny():
    rng = np.random.default_rng(0)
    vocab = lm.vocabulary(rng.integers(0, 50, 3000))
    return vocab, lm.fresh(vocab), rng


def test_gradient():
    vocab, w, rng = tiny()
    w = {k: x.astype(np.float64) for k, x in w.items()}
    rows, targets = rng.integers(0, 200, (2, 5)), rng.integers(0, lm.CLASSES, (2, 5))
    _, g = lm.gradient(w, rows, targets)
    for k in w:
        group, member = divmod(int(targets[0, 1]), lm.MEMBERS)
        at = {"e": (rows[0, 1], 3), "p": (1, 3), "c": (group, 2, 5), "d": (group, member)}.get(k) or tuple(rng.integers(0, s) for s in w[k].shape)
        moved = []
        for step in (1e-5, -1e-5):
            other = {**w, k: w[k].copy()}
            other[k][at] += step
            moved.append(lm.gradient(other, rows, targets)[0])
        assert g[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_probabilities_add_up_and_look_only_back():
    vocab, w, rng = tiny()
    rows = rng.integers(0, 200, (1, 6))
    every = [lm.log_next(w, rows, np.full((1, 6), c)) for c in range(lm.CLASSES)]
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones((1, 6)), rel=1e-4)
    assert np.exp(vocab.inner[vocab.class_of == 3]).sum() == pytest.approx(1, rel=1e-4)
    other = rows.copy()
    other[0, 4] = 7
    same = lm.log_next(w, rows, np.zeros((1, 6), int)) == lm.log_next(w, other, np.zeros((1, 6), int))
    assert same[0, :4].all() and not same[0, 4:].any()
    assert lm.log_next(w, rows, np.full((1, 4), 9), 2)[0] == pytest.approx(lm.log_next(w, rows, np.full((1, 6), 9))[0, 2:], rel=1e-5)


def test_classes_without_ids_have_no_probability():
    """A few frequent ids take the room of several classes."""
    vocab = lm.vocabulary(np.array([1000, 10, 5, 5, 1, 0, 0]))
    w = lm.fresh(vocab)
    used = np.unique(vocab.class_of)
    assert len(used) < lm.CLASSES and (used == np.arange(len(used))).all()
    every = np.exp([lm.log_next(w, np.zeros((1, 1), int), np.full((1, 1), c))[0, 0] for c in used])
    assert every.sum() == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 56, 57, 200])
def test_each_token_is_scored_once(n):
    vocab, w, rng = tiny()
    texts = [rng.integers(0, 3000, n), rng.integers(0, 3000, 40)]
    found = lm.score_batch(w, vocab, texts, at_once=3)
    assert found == pytest.approx([plain_log10(w, vocab, ids.tolist()) for ids in texts], rel=1e-4)


def test_context_helps_on_held_out_texts(spark, sf_dir):
    """Against the same vocabulary without context."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.fit(lm.prepare(docs))
    w, vocab = lm.unpack(model.weights), model.vocab
    held = [np.append(CODER.ids(lm.words_of(r.text)), vocab.end) for r in docs.where(lm.held_out("doc_id")).collect()]
    mass = vocab.class_mass.reshape(lm.GROUPS, lm.MEMBERS)
    flat = {**w, "u": np.zeros_like(w["u"]), "c": np.zeros_like(w["c"]), "b": np.logaddexp.reduce(mass, axis=1), "d": mass}
    gained = (lm.score_batch(w, vocab, held).sum() - lm.score_batch(flat, vocab, held).sum()) / sum(map(len, held))
    assert gained > 0.1


def test_short_texts_train(spark):
    """A table of texts that are all shorter than a window is trained on, their ends included."""
    texts = [f"{a} {b}" for a, b in (("red", "apple"), ("green", "pear"), ("blue", "plum")) * 100]
    model = lm.fit(lm.prepare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    ids = [np.append(CODER.ids(x), model.vocab.end) for x in ([b"red", b"apple"], [b"blue", b"plum"])]
    start = lm.score_batch(lm.fresh(model.vocab), model.vocab, ids)
    assert (lm.score_batch(lm.unpack(model.weights), model.vocab, ids) > start).all()


def test_rounds_share_the_windows(spark, sf_dir):
    """Each id of each training text, and its end, is a target in one round and in one task."""
    prepared = lm.prepare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = lm.id_counts(prepared)
    vocab, texts = lm.vocabulary(counts), prepared.texts.where("NOT held_out")
    shipped, state = spark.sparkContext.broadcast(vocab), lm.pack(lm.fresh(vocab))
    taught = [lm.copies(lm.share(texts, turn, 3), shipped, prepared.kind, state, turn, 2).agg({"n": "sum"}).first()[0] for turn in range(3)]
    assert sum(taught) == counts.sum() and min(taught) > 0


@pytest.mark.parametrize("n", [0, 1, 30, 31, 32, 33, 63, 64, 100])
def test_each_id_is_trained_on_once(n):
    vocab, _, rng = tiny()
    texts = [np.append(rng.integers(0, 3000, k), vocab.end) for k in (n, 5, n)]
    rows, targets = lm.windows_of(texts, vocab)
    assert targets[targets >= 0].tolist() == vocab.class_of[np.concatenate(texts)].tolist()
    assert rows[targets >= 0].tolist() == [int(vocab.row_of[i]) for ids in texts for i in [vocab.end, *ids[:-1]]]


def test_padding_has_no_gradient():
    vocab, w, rng = tiny()
    rows, targets = rng.integers(0, 200, (1, 9)), rng.integers(0, lm.CLASSES, (1, 9))
    loss, g = lm.gradient(w, rows[:, :5], targets[:, :5])
    targets[:, 5:] = -1
    padded_loss, padded_g = lm.gradient(w, rows, targets)
    assert padded_loss == pytest.approx(loss, rel=1e-5)
    assert not padded_g["p"][5:].any()
    padded_g["p"] = padded_g["p"][:5]
    assert all(padded_g[k] == pytest.approx(g[k], rel=1e-3, abs=1e-6) for k in g)


def test_long_words_and_unicode():
    words = ["x" * 1000, "é🙂" * 200, "plain"]
    ids = CODER.ids([w.encode() for w in words])
    assert CODER.library.decode(ids.tolist()) == " " + " ".join(words)


@pytest.mark.parametrize("texts", [[[]], [[], [b"one"], []], [[b"one", b"two", b"one"], [], [b"x" * 500, "é🙂".encode() * 90, b"two"]], []])
def test_words_are_encoded_once_and_counted(texts):
    words = lm.Words(CODER)
    for some in (texts, texts):
        numbers = words.numbers(some)
        words.count(numbers)
        assert [np.frombuffer(x, CODER.kind).tolist() for x in words.packed(numbers)] == [[*CODER.ids(t).tolist(), CODER.end] for t in some]
    assert dict(zip(words.asked, words.counts.tolist())) == Counter(w for t in texts for w in t for _ in range(2))


def test_scores_do_not_hang_on_the_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def scores(parts):
        prepared = lm.prepare(docs.repartition(parts))
        return {r.id: r.score / r.n_tokens for r in lm.score(prepared, lm.count_words(prepared), lm.fit(prepared)).collect()}

    one, many = scores(1), scores(16)
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-4


@pytest.mark.parametrize("texts", [[], [None], ["", " ", None, "x"], [" a", "a ", "\t\n a  B\x0b\x0cc\r\n", "\xc0B c", " \x1c ", "a\x00B", "a\xa0b\x85 a"], ["".join(chr(i) + "Q" for i in range(0x100))]])
def test_words_are_split_as_python_does(texts):
    sizes, which, different = lm.split_words(pc.ascii_lower(pa.array(texts, pa.string()).fill_null("")))
    words = [different[i].as_py() for i in which.tolist()]
    assert len(set(different.to_pylist())) == len(different)
    assert [words[b - n : b] for n, b in zip(sizes, np.cumsum(sizes))] == [lm.words_of(x) for x in texts]


def test_attention_needs_no_keys_and_values():
    """The maps' products are all that places meet: at each place 16 numbers are kept where there were 48."""
    vocab, w, rng = tiny()
    rows = rng.integers(0, 200, (3, 9))
    e, q, a, sums, h, o = lm.attend(w, rows, 2)
    queries, keys, values = np.split(e @ w["w"], 3, axis=2)
    assert q @ e.transpose(0, 2, 1) == pytest.approx(queries[:, 2:] @ keys.transpose(0, 2, 1) / lm.WIDTH**0.5, rel=1e-3, abs=1e-4)
    assert o == pytest.approx((e[:, 2:] + (a / sums) @ values @ w["o"]).reshape(o.shape), rel=1e-3, abs=1e-4)
