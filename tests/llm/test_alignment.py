"""Alignment against a plain one of whole texts: no units, no cache, boundaries by sets, counts by dictionaries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from noctua.llm import alignment, bpe
from tests.llm import edge


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: x for x, c in enumerate(bpe.byte_characters())}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        names = [[bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]], [of_b(i) for i in ids[1]]]
        if any(b"".join(x) != (" " + text).encode() for x in names):
            return []
        ends = [np.cumsum([len(x) for x in n]).tolist() for n in names]
        cuts = sorted({*ends[0]} & {*ends[1]})
        found = [([], []) for _ in cuts]
        for k in (0, 1):
            for i, g in zip(ids[k], np.searchsorted(cuts, ends[k])):
                found[g][k].append(i)
        return found

    return groups


def brute(rows, groups):
    linked = [Counter((a, b) for x, y in groups(t) for a in x for b in y) for _, t in rows]
    count, best = Counter(p for links in linked for p in links), defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (key, text), links in zip(rows, linked):
        g = groups(text)
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        digest = hashlib.sha256(written.encode()).hexdigest() if g else ""
        sizes = sum(len(x) for x, _ in g), sum(len(y) for _, y in g)
        out.append((key, *sizes, len(g), sum(links.values()), sum(n for (a, b), n in links.items() if count[a, b] == best[a]), sum(n * count[p] for p, n in links.items()), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", " ", "a  b", " a", "a ", "x▁y z", "▁", "<|endoftext|> a <s>", "\n\n \t x\x0b", "日本語 テキスト 🙂🙂🙂 z", "a\xa0b c", "x  y", "é naïve \x00 \x1c q", "🙂" * 300, "<0x41> <unk>", "1234567 1/2"]


@pytest.mark.parametrize("top", [alignment.TOP, 200, 0])
def test_against_whole_texts(spark, plain, top):
    docs = edge.documents(spark)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    found = alignment.summaries(docs, top=top).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs.select("doc_id", "text").collect(), plain)


def test_empty_table(spark):
    assert alignment.summaries(edge.documents(spark, empty=True)).count() == 0


def test_arrays(spark, plain):
    """Ids, ends and groups as arrays; other columns stay."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *ODD])], "doc_id long, text string, a_ids string").withColumnRenamed("a_ids", "b_like")
    for row in alignment.align(docs).collect():
        found = plain(row.text)
        assert row.b_like == "x"
        for k, (ids, of, ends) in enumerate(((row.a_ids, row.a_groups, row.a_ends), (row.b_ids, row.b_groups, row.b_ends))):
            assert [(i, g) for i, g in zip(ids, of)] == [(i, g) for g, both in enumerate(found) for i in both[k]]
            assert not ends or ends[-1] == len((" " + row.text).encode())


def test_jump_finds_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n) < share) + 1, n + 1) for share in rng.random(2))
        cuts = np.intersect1d(a, b)
        found = alignment.jump(a, b)
        assert np.array_equal(found[0], np.searchsorted(cuts, a)) and np.array_equal(found[1], np.searchsorted(cuts, b))


def test_units_are_forgotten_and_met_again(monkeypatch, plain):
    monkeypatch.setattr(alignment, "KEEP_UNITS", 3)
    own = alignment.Aligner(*alignment.files())
    for text in ("one two three four five", "five six one", "one two"):
        (units,) = own.aligned([text])
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(text))
        assert b";".join(own.written[i] for i in units).decode() == written
