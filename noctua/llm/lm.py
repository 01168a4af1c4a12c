"""Language-model scores of whole texts: a smoothed unigram over words, and causal self-attention over subword ids.

Words are lower-cased (A-Z); a text is its words with a space before each, encoded to byte-level ids, and an end. The
attention model predicts the class of the next id: first one of GROUPS, then one of MEMBERS in it, each by a softmax over
what attention found. Classes have about equal mass in the training texts, so a frequent id is a class of its own; among
the ids of one class each has its add-one share, so probabilities of all ids add up to one. Windows of WINDOW ids
overlap: each begins STRIDE ids after the last one, and an id is scored in the first window that reaches it.

prepare() reads the texts once and writes a table: of each text its words and ids, and of the training texts the words
that a task has counted. Everything else reads that table: word counts (partial sums, then a shuffle), id counts,
training and scores. Training takes all ids of all training texts, ends included, each as a target once; short windows
are padded and masked. Texts are dealt to lanes, as many as there are rows for, by a hash of key and ids, and come in the
order of that hash, so what is learned does not hang on how the table is split. Each lane trains its own copy from common
weights on one of ROUNDS shares of the texts; the copies are averaged in a tree, and that is done ROUNDS times. Batches
pass by, none is held.

Scoring sends the TOP most frequent words to the tasks with their counts; other words leave as one row each, are joined
with the counts by a shuffle, and come back as sums for each text.

Null and empty texts are only an end. Texts of any length are read whole. Repeated rows are counted, trained on and
scored as often as they come. A null key counts as the empty text where rows are held out. Other columns are not read.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm import bpe
from noctua.llm.common import cut, most_frequent, shared_folder, slices, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A word with the space before it; pieces of longer words are encoded on their own, so no word is slow.
PIECE = " ?[^ ]{1,64}"
#: Words whose counts tasks hold, at most: about 50 MB in a worker.
TOP = 300_000
#: Distinct words that a task knows before it passes their counts on and begins anew.
HELD = 250_000
GROUPS, MEMBERS, OWN_ROWS, WIDTH, WINDOW, STRIDE = 8, 20, 1024, 16, 32, 28
CLASSES = GROUPS * MEMBERS
#: Rounds of training, windows of a step, size of the first steps and steps after which it is halved; copies averaged at once.
ROUNDS, BATCH, RATE_OF_STEP, HALVED, FAN_IN = 3, 256, 0.02, 500, 64
#: Training texts of a lane, about, up to so many lanes; then lanes grow.
LANE, MOST_LANES = 4096, 10_000
#: Bytes of ids or words that a task handles at once, about.
PIECE_BYTES = 4 << 20
#: Windows that are scored at once.
AT_ONCE = 256
END_OF_WORDS = b""  # no word is empty


@dataclass(frozen=True)
class Counts:
    words: DataFrame  # word (binary), c
    total: int  # N
    distinct: int  # V
    texts: int

    @property
    def base(self) -> float:
        return math.log10(self.total + self.distinct + 1)


def held_out(key: str) -> Column:
    """Rows of which crc32(key as text) mod 7 is 2; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7) == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split_words(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of some texts in lower case, as words_of() has them, without a Python object for each word.

    Returns how many words each text has, the number of each word, and the different words by number.
    """
    lists = pc.ascii_split_whitespace(lowered)
    flat = lists.flatten()
    filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    before = np.concatenate([[0], np.cumsum(filled)])
    sizes = np.diff(before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    return sizes, coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary())


class Coder:
    """The byte-level tokenizer of some ranks. The id after the last rank is the end of a text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.library = tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = kind_of(self.end)
        self.lengths = np.zeros(self.end, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The ids of a text's words, each with the space before it."""
        return np.array(self.library.encode_ordinary(b"".join(b" " + w for w in words).decode()), np.int64)


def kind_of(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


_CODERS: dict[int, Coder] = {}


def coder_of(ranks: dict[bytes, int]) -> Coder:
    """The worker's coder of these ranks, used by its later tasks again."""
    key = hash(frozenset(ranks.items()))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks)
    return _CODERS[key]


class Words(dict):
    """Numbers words in the order in which they are first asked for; each is encoded once, and counted."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.asked, self.counts = coder, [], np.zeros(0, np.int64)
        self.flat, self.starts, self.sizes = np.zeros(0, coder.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.asked)
        self.asked.append(word)
        return number

    def encode_new(self) -> None:
        new = self.asked[len(self.sizes) :]
        ids = self.coder.ids(new)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        cuts = np.searchsorted(np.cumsum(self.coder.lengths[ids]), ends, "right")  # no token crosses words
        sizes = np.diff(cuts, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.flat) + cuts - sizes])
        self.flat = np.concatenate([self.flat, ids.astype(self.coder.kind)])
        self.sizes = np.concatenate([self.sizes, sizes])

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        found = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in texts]
        if len(self.asked) > len(self.sizes):
            self.encode_new()
        return found

    def count(self, numbers: list[np.ndarray]) -> None:
        new = np.bincount(np.concatenate([np.zeros(0, np.int64), *numbers]), minlength=len(self.asked))
        new[: len(self.counts)] += self.counts
        self.counts = new

    def packed(self, numbers: list[np.ndarray]) -> list[bytes]:
        """The ids of each text, and its end, as bytes."""
        flat = np.concatenate([np.zeros(0, np.int64), *numbers])
        sizes = self.sizes[flat]
        before = np.concatenate([[0], np.cumsum(sizes)])
        tokens = np.diff(before[np.cumsum([0, *map(len, numbers)])])
        out = np.full(len(numbers) + before[-1], self.coder.end, self.coder.kind)
        out[np.arange(before[-1]) + np.repeat(np.arange(len(numbers)), tokens)] = self.flat[bpe.ragged(self.starts[flat], sizes)]
        data, ends = out.tobytes(), (np.cumsum(tokens + 1) * out.itemsize).tolist()
        return [data[x:y] for x, y in zip([0, *ends], ends)]


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame  # texts: row, id, held_out, body, ids; counted words: word, n
    size: int  # ids; the last one is the end

    @property
    def kind(self) -> str:
        return kind_of(self.size - 1)

    @property
    def texts(self) -> DataFrame:
        return self.rows.where("word IS NULL")


ROW = "row bigint, id bigint, held_out boolean, body binary, ids binary, word binary, n bigint"


def prepare(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, ranks: dict[bytes, int] | None = None) -> Prepared:
    """Words and ids of each text, and partial counts of the words of those not held out, as a table in the shared folder."""
    spark = docs.sparkSession
    ranks = ranks or bpe.read_ranks(public_tokenizers.path(RANKS))
    shipped = spark.sparkContext.broadcast(ranks)
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        row, texts = TaskContext.get().partitionId() << 40, 0
        words = Words(coder_of(shipped.value))
        for batch in slices(batches, most=PIECE_BYTES):
            held, lowered = batch.column(1).to_pylist(), pc.ascii_lower(batch.column(2).fill_null(""))
            sizes, which, different = split_words(lowered)
            numbers = np.split(words.numbers([different.to_pylist()])[0][which], np.cumsum(sizes)[:-1])
            words.count([x for x, own in zip(numbers, held) if not own])
            n, texts = len(held), texts + held.count(False)
            columns = [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), lowered.cast(pa.binary()), pa.array(words.packed(numbers), pa.binary())]
            row += n
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
            if len(words) > HELD:
                yield counted(words, texts)
                words, texts = Words(words.coder), 0
        yield counted(words, texts)

    def counted(words: Words, texts: int):
        some = np.flatnonzero(words.counts)
        n = len(some) + 1
        columns = [pa.array([END_OF_WORDS, *map(words.asked.__getitem__, some.tolist())], pa.binary()), pa.array([texts, *words.counts[some].tolist()], pa.int64())]
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:5]), *columns], names=names)

    rows = docs.select(F.col(key).cast("bigint").alias("id"), (held_out(key) if held is None else held).alias("held_out"), F.col(text))
    folder = shared_folder(spark, "lm")
    rows.mapInArrow(run, ROW).write.option("compression", "zstd").parquet(folder)
    return Prepared(spark.read.schema(ROW).parquet(folder), max(ranks.values()) + 2)


def count_words(prepared: Prepared) -> Counts:
    """Counts of all training words; each training text also has one end, which is a token."""
    words = stored(prepared.rows.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    total, distinct, ends = words.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END_OF_WORDS), F.col("c")))).first()
    return Counts(words, total or 0, distinct, ends or 0)


@dataclass(frozen=True)
class Vocabulary:
    """Of each id (the end is the last): its class, its row of the embedding, its log probability in its class."""

    class_of: np.ndarray
    row_of: np.ndarray
    inner: np.ndarray
    class_mass: np.ndarray  # logarithms; very low where a class has no id

    @property
    def end(self) -> int:
        return len(self.class_of) - 1


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """As many classes of about equal mass as there may be, from the most frequent id on."""
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(counts[order] + 1e-9) - (counts[order] + 1e-9) / 2
    mass /= counts.sum() + 1e-9 * len(counts)
    for parts in range(2 * CLASSES, 0, -1):  # a frequent id takes the room of several classes, so there are more parts than classes
        ranked = np.minimum((mass * parts).astype(np.int64), parts - 1)
        ranked = np.cumsum(np.diff(ranked, prepend=ranked[0]) > 0)
        if ranked[-1] < CLASSES:
            break
    class_of, row_of = np.empty(len(counts), np.int32), np.empty(len(counts), np.int32)
    class_of[order] = ranked
    row_of[order] = np.where(np.arange(len(counts)) < OWN_ROWS, np.arange(len(counts)), OWN_ROWS + ranked)
    sums, sizes = np.bincount(class_of, counts, CLASSES), np.bincount(class_of, minlength=CLASSES)
    inner = np.log((counts + 1) / (sums + sizes)[class_of])
    share = np.where(sizes > 0, np.log(np.maximum(sums + sizes, 1) / (sums + sizes).sum()), -1e9)
    return Vocabulary(class_of, row_of, inner.astype(np.float32), share.astype(np.float32))


SHAPES = {
    "e": (OWN_ROWS + CLASSES, WIDTH), "p": (WINDOW, WIDTH), "w": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH),
    "u": (WIDTH, GROUPS), "b": (GROUPS,), "c": (GROUPS, WIDTH, MEMBERS), "d": (GROUPS, MEMBERS),
}
Weights = dict[str, np.ndarray]


def pack(w: Weights) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in SHAPES)


def unpack(data: bytes) -> Weights:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k, shape in SHAPES.items():
        out[k] = flat[at : at + math.prod(shape)].reshape(shape).copy()
        at += math.prod(shape)
    return out


def fresh(vocab: Vocabulary, seed: int = 5) -> Weights:
    """Small random weights; the biases are the classes' mass, so training starts from the unigram of classes."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * (0.3 if k in "ep" else WIDTH**-0.5 * 0.5)).astype(np.float32) for k, s in SHAPES.items() if k not in "bd"}
    mass = vocab.class_mass.reshape(GROUPS, MEMBERS)
    return w | {"b": np.logaddexp.reduce(mass, axis=1), "d": mass.copy()}


#: Which keys (last axis) a place may see.
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Of each class: its group, its number in the group. Of each row of the embedding: the places of its values.
GROUP_OF, MEMBER_OF = (np.arange(CLASSES) // MEMBERS).astype(np.uint8), np.arange(CLASSES) % MEMBERS
PLACES = np.arange((OWN_ROWS + CLASSES) * WIDTH).reshape(-1, WIDTH)


def exponentials(z: np.ndarray, axis: int, seen: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of z, and their sums over an axis, which is kept; those that are not seen are 0.

    Scores are small, so nothing is subtracted first; only where a sum has overflowed or vanished is that done.
    """
    with np.errstate(over="ignore"):
        e = np.exp(z, out=out)
    if seen is not None:
        e *= seen
    sums = (e.reshape(-1, e.shape[-1]) @ np.ones((e.shape[-1], 1), e.dtype)).reshape(*e.shape[:-1], 1) if axis == e.ndim - 1 else e.sum(axis=axis, keepdims=True)
    if np.isfinite(sums).all() and (sums > 0).all():
        return e, sums
    z = z if seen is None else np.where(seen > 0, z, -np.inf)
    e = np.exp(z - z.max(axis=axis, keepdims=True), out=out)
    return e, e.sum(axis=axis, keepdims=True)


def products(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Queries by keys, scaled, and values by output: with one head, only these products of the maps are needed at places."""
    q, k, v = np.split(w["w"], 3, axis=1)
    return q @ k.T * q.dtype.type(WIDTH**-0.5), v @ w["o"]


def attend(w: Weights, rows: np.ndarray, skip: int = 0):
    """What stands at each place of each window from ``skip`` on, after attention to it and what lies before it.

    Returns the embedding, what meets it as queries, weights of attention and their sums, the mixture, the result.
    """
    n, length = rows.shape
    meet, out = products(w)
    e = w["e"].take(rows.ravel(), axis=0).reshape(n, length, WIDTH)
    e += w["p"][:length]
    own = np.ascontiguousarray(e[:, skip:]) if skip else e
    q = (own.reshape(-1, WIDTH) @ meet).reshape(own.shape)
    a, sums = exponentials(q @ e.transpose(0, 2, 1), 2, SEEN[skip:length, :length])
    h = a @ e
    h /= sums
    o = h.reshape(-1, WIDTH) @ out
    o += own.reshape(-1, WIDTH)
    return e, q, a, sums, h, o


def by_group(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of places by the group of their class, and each group with where it begins and ends in that order."""
    groups = GROUP_OF.take(classes)
    order = np.argsort(groups, kind="stable")
    cuts = np.cumsum(np.bincount(groups, minlength=GROUPS)).tolist()
    return order, [(j, a, b) for j, (a, b) in enumerate(zip([0, *cuts], cuts)) if a < b]


def maps(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Of each group: the maps to all groups and to its members, one below the other, and their biases."""
    m = np.concatenate([np.broadcast_to(w["u"].T, (GROUPS, GROUPS, WIDTH)), w["c"].transpose(0, 2, 1)], axis=1)
    return m, np.concatenate([np.broadcast_to(w["b"], (GROUPS, GROUPS)), w["d"]], axis=1)[:, :, None]


def shares(w: Weights, o: np.ndarray, order: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """Exponentials for the groups, and below them for the members of its group, at each place in order (number, place).

    Also the sums of both, the places in order, and the maps.
    """
    m, bias = maps(w)
    turned, z = np.ascontiguousarray(o.take(order, axis=0).T), np.empty((GROUPS + MEMBERS, len(o)), o.dtype)
    for j, a, b in parts:
        part = z[:, a:b]
        np.matmul(m[j], turned[:, a:b], out=part)
        part += bias[j]
    both = np.empty_like(z)
    sums, sums2 = (exponentials(z[x], 0, out=both[x])[1][0] for x in (slice(GROUPS), slice(GROUPS, None)))
    return both, sums, sums2, turned, m


def log_next(w: Weights, rows: np.ndarray, classes: np.ndarray, skip: int = 0) -> np.ndarray:
    """Log probabilities of the classes that follow, from place ``skip`` of each window on; earlier places are only seen."""
    o, y = attend(w, rows, skip)[-1], classes.ravel()
    order, parts = by_group(y)
    both, sums, sums2, *_ = shares(w, o, order, parts)
    own = both.ravel().take((GROUPS + MEMBER_OF.take(y.take(order))) * len(y) + np.arange(len(y)))
    own /= sums2
    own /= sums
    for j, a, b in parts:
        own[a:b] *= both[j, a:b]
    p = np.empty_like(own)
    p[order] = own
    return np.log(np.maximum(p, np.finfo(p.dtype).tiny)).reshape(classes.shape)


def gradient(w: Weights, rows: np.ndarray, targets: np.ndarray, loss: bool = True) -> tuple[float, Weights]:
    """Mean cross-entropy of the classes that follow (0 if not asked for), and its gradient.

    Places of which the target is negative do not count.
    """
    e, q, a, sums, h, o = attend(w, rows)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    y = np.maximum(targets.ravel(), 0)
    order, parts = by_group(y)
    both, total, total2, turned, m = shares(w, o, order, parts)
    counted = targets.ravel().take(order) >= 0
    n, entropy = max(int(counted.sum()), 1), 0.0
    member = (GROUPS + MEMBER_OF.take(y.take(order))) * len(y) + np.arange(len(y))
    if loss:
        of_group = np.concatenate([both[j, x:z] for j, x, z in parts])
        entropy = -sum(np.log(np.maximum(p, 1e-37))[counted].sum() for p in (of_group / total, both.ravel()[member] / total2)) / n
    weight = (counted / n).astype(o.dtype)
    both[:GROUPS] *= weight / total
    both[GROUPS:] *= weight / total2
    both.ravel()[member] -= weight
    back, gm, gb = np.empty_like(turned), np.zeros_like(m), np.zeros(m.shape[:2], m.dtype)
    for j, x, z in parts:
        part = both[:, x:z]
        part[j] -= weight[x:z]
        np.matmul(m[j].T, part, out=back[:, x:z])
        np.matmul(part, turned[:, x:z].T, out=gm[j])
        part.sum(axis=1, out=gb[j])
    g = {"u": gm[:, :GROUPS].sum(axis=0).T, "b": gb[:, :GROUPS].sum(axis=0), "c": gm[:, GROUPS:].transpose(0, 2, 1), "d": gb[:, GROUPS:]}
    do = np.empty_like(o)
    do[order] = back.T
    meet, out = products(w)
    dh = (do @ out.T).reshape(h.shape)
    dh /= sums  # the weights of attention are not divided by their sums
    ds = dh @ e.transpose(0, 2, 1)
    ds -= (flat(dh * h) @ np.ones((WIDTH, 1), h.dtype)).reshape(sums.shape)
    ds *= a
    dq = ds @ e
    of_meet, of_out = flat(e).T @ flat(dq) * e.dtype.type(WIDTH**-0.5), flat(h).T @ do
    wq, wk, wv = np.split(w["w"], 3, axis=1)
    g["o"] = wv.T @ of_out
    g["w"] = np.hstack([of_meet @ wk, of_meet.T @ wq, of_out @ w["o"].T])
    de = ds.transpose(0, 2, 1) @ q
    de += a.transpose(0, 2, 1) @ dh
    de = flat(de)
    de += do
    de += flat(dq) @ meet.T
    g["p"] = de.reshape(e.shape).sum(axis=0)
    g["e"] = np.bincount(PLACES.take(rows.ravel(), axis=0).ravel(), de.ravel(), w["e"].size).reshape(w["e"].shape).astype(e.dtype)
    return float(entropy), g


class Learner:
    """A copy of the weights in training, by moment estimates (Adam) with a falling step."""

    def __init__(self, w: Weights, rate: float = RATE_OF_STEP):
        self.w, self.rate, self.t, self.targets = {k: x.copy() for k, x in w.items()}, rate, 0, 0
        self.first, self.second = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def learn(self, rows: np.ndarray, targets: np.ndarray) -> None:
        """One pass over some windows, BATCH at a step."""
        for i in range(0, len(rows), BATCH):
            self.t += 1
            self.targets += int((targets[i : i + BATCH] >= 0).sum())
            rate = self.rate / (1 + self.t / HALVED)
            up, down = rate / (1 - 0.9**self.t), 1 / (1 - 0.99**self.t)
            for k, g in gradient(self.w, rows[i : i + BATCH], targets[i : i + BATCH], False)[1].items():
                first, second = self.first[k], self.second[k]
                first += 0.1 * (g - first)
                g *= g
                second += 0.01 * (g - second)
                self.w[k] -= (up * first / (np.sqrt(second * down) + 1e-8)).astype(np.float32)


def keep_memory() -> None:
    """Has the C library keep what numpy frees: arrays of some 100 KB are made anew at every step, and their pages with them."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-1, 96 << 20)  # M_TRIM_THRESHOLD
        mallopt(-3, 48 << 20)  # M_MMAP_THRESHOLD


def score_batch(w: Weights, vocab: Vocabulary, texts: list[np.ndarray], at_once: int = AT_ONCE) -> np.ndarray:
    """log10 of the probability of each text, given as ids that finish with the end."""
    lengths = np.array([len(x) for x in texts], np.int64)
    if not len(lengths):
        return np.zeros(0)
    targets = np.concatenate(texts)
    inputs = np.concatenate([[vocab.end], targets[:-1]])
    begins = np.cumsum(lengths) - lengths
    inputs[begins] = vocab.end
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(texts)), n)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    start, left = begins[text] + offset, lengths[text] - offset
    total = np.add.reduceat(vocab.inner[targets].astype(np.float64), begins)
    rows = sliding_window_view(np.append(vocab.row_of[inputs], np.zeros(WINDOW, np.int32)), WINDOW)
    classes = np.append(vocab.class_of[targets], np.zeros(WINDOW, np.int32))
    for later in (False, True):  # all places of the first window of a text, the last STRIDE of the others
        skip = (WINDOW - STRIDE) * later
        ahead = sliding_window_view(classes[skip:], WINDOW - skip)
        own = np.flatnonzero((offset > 0) == later)
        for i in range(0, len(own), at_once):
            some = own[i : i + at_once]
            logs = log_next(w, rows[start[some]], ahead[start[some]], skip)
            logs *= np.arange(skip, WINDOW) < left[some][:, None]
            total += np.bincount(text[some], logs.sum(axis=1, dtype=np.float64), len(texts))
    return total / math.log(10)


@dataclass(frozen=True)
class Model:
    vocab: Vocabulary
    weights: bytes


def id_counts(prepared: Prepared) -> np.ndarray:
    """How often each id comes in the training texts; last, the end."""
    size, kind = prepared.size, prepared.kind

    def run(batches):
        sums = np.zeros(size, np.int64)
        for batch in slices(batches):
            sums += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["id", "n"])

    found = np.zeros(size, np.int64)
    for i, n in prepared.texts.where("NOT held_out").select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).toLocalIterator():
        found[i] = n
    return found


def windows_of(texts: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding and targets (classes) of each window of WINDOW ids; each id of a text is a target once.

    The last window of a text may be short: behind its end the target is -1.
    """
    lengths = np.array([len(x) for x in texts], np.int64)
    ids = np.concatenate([np.empty(0, np.int64), *texts]).astype(np.int64)
    own, begins, n = vocab.row_of[ids], np.cumsum(lengths) - lengths, -(-lengths // WINDOW)
    inputs = np.concatenate([own[:1], own[:-1]])
    inputs[begins] = vocab.row_of[vocab.end]
    place = np.arange(len(ids)) + np.repeat(WINDOW * (np.cumsum(n) - n) - begins, lengths)
    rows, targets = np.full(n.sum() * WINDOW, vocab.row_of[vocab.end], np.int32), np.full(n.sum() * WINDOW, -1, np.int32)
    rows[place], targets[place] = inputs, vocab.class_of[ids]
    return rows.reshape(-1, WINDOW), targets.reshape(-1, WINDOW)


KIND = pa.schema([("lane", pa.int64()), ("n", pa.int64()), ("w", pa.binary())])


def copies(texts: DataFrame, vocab: Broadcast, kind: str, state: bytes, turn: int, lanes: int) -> DataFrame:
    """lane, n, w: a copy of the weights for each lane, trained on all windows of its texts, n targets."""

    def train(batches):
        keep_memory()
        learner, lane = Learner(unpack(state), RATE_OF_STEP / (1 + turn)), 0
        for i, texts in enumerate(regrouped(batches)):
            lane = texts[0][0]
            rows, targets = windows_of([np.frombuffer(x, kind) for _, x in texts], vocab.value)
            order = np.random.default_rng([turn, i]).permutation(len(rows))
            learner.learn(rows[order], targets[order])
        if learner.targets:
            yield pa.RecordBatch.from_pydict({"lane": [lane], "n": [learner.targets], "w": [pack(learner.w)]}, KIND)

    dealt = texts.withColumn("lane", F.pmod("h", F.lit(lanes)).cast("int")).repartitionById(lanes, "lane").sortWithinPartitions("lane", "h", "ids")
    return cut(dealt.select("lane", "ids").mapInArrow(train, "lane bigint, n bigint, w binary"))


def regrouped(batches, most: int = PIECE_BYTES // 8):
    """(lane, ids) of a task in pieces of so many bytes, which do not hang on how Spark cuts its batches."""
    held, size = [], 0
    for batch in slices(batches):
        for lane, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((lane, ids))
            size += len(ids)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def averaged(copies: DataFrame) -> DataFrame:
    """One copy, or none: the average by targets, FAN_IN lanes at a time."""

    def average(data: pa.Table) -> pa.Table:
        data = data.sort_by("lane")  # sums of fractions hang on their order
        n = data.column("n").to_numpy().astype(np.float64)
        w = sum(np.frombuffer(x, "<f4") * share for x, share in zip(data.column("w").to_pylist(), n / n.sum()))
        return pa.Table.from_pydict({"lane": [data.column("lane")[0].as_py()], "n": [int(n.sum())], "w": [w.astype("<f4").tobytes()]}, KIND)

    left = (copies.agg(F.max("lane")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        copies = copies.withColumn("lane", F.floor(F.col("lane") / FAN_IN)).groupBy("lane").applyInArrow(average, "lane bigint, n bigint, w binary")
    return copies


def share(texts: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The texts of one round: each is in one. h: a hash of key and ids."""
    return texts.withColumn("h", F.xxhash64("id", "ids")).where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(rounds)) == turn)


def fit(prepared: Prepared, rounds: int = ROUNDS) -> Model:
    """Trains on all ids of all texts that are not held out, each as a target once."""
    texts = prepared.texts.where("NOT held_out")
    vocab = vocabulary(id_counts(prepared))
    shipped = texts.sparkSession.sparkContext.broadcast(vocab)
    state = pack(fresh(vocab))
    lanes = min(-(-max(texts.count(), 1) // LANE), MOST_LANES)
    for turn in range(rounds):
        for row in averaged(copies(share(texts, turn, rounds), shipped, prepared.kind, state, turn, lanes)).collect():  # one row
            state = bytes(row.w)
    return Model(vocab, state)


_LOGS: dict[str, dict[bytes, float]] = {}


def logs_of(key: str, packed: bytes, counts: np.ndarray) -> dict[bytes, float]:
    """log10(c + 1) of words whose count is known here; kept by the worker for its later tasks with that key."""
    if key not in _LOGS:
        _LOGS.clear()
        _LOGS[key] = dict(zip(packed.split(), np.log10(counts + 1.0).tolist()))
    return _LOGS[key]


def score(prepared: Prepared, counts: Counts, model: Model) -> DataFrame:
    """id, held_out, n_tokens, n_known, base_score and score of each row. A null text is only an end."""
    spark, kind = prepared.rows.sparkSession, prepared.kind
    words = counts.words.where(F.col("word") != F.lit(END_OF_WORDS))
    top_words, top_counts = [], []
    for row in most_frequent(words, TOP).toLocalIterator():
        top_words.append(bytes(row.word))
        top_counts.append(row.c)
    shipped = spark.sparkContext.broadcast((model, b" ".join(top_words), np.array(top_counts, np.int64)))
    key = uuid.uuid4().hex
    base, ends, complete = counts.base, counts.texts, len(top_words) == counts.distinct - (counts.texts > 0)
    del top_words, top_counts
    schema = "row bigint, id bigint, held_out boolean, word binary, n_tokens bigint, n_known bigint, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        keep_memory()
        m, packed, n = shipped.value
        logs, weights = logs_of(key, packed, n), unpack(m.weights)
        for batch in slices(batches, most=PIECE_BYTES):
            row = batch.column(0).to_numpy()
            texts = [np.frombuffer(x, kind).astype(np.int64) for x in batch.column(4).to_pylist()]
            scores = score_batch(weights, m.vocab, texts)
            sizes, which, different = split_words(batch.column(3).cast(pa.string()))
            found = np.fromiter(map(logs.get, different.to_pylist(), repeat(-1.0)), np.float64, len(different))
            text, missing = np.repeat(np.arange(len(row)), sizes), (found < 0)[which]
            sums = np.bincount(text, np.maximum(found, 0)[which], len(row)) + math.log10(ends + 1) - base * (sizes + 1)
            known = sizes + 1 - np.bincount(text[missing], minlength=len(row)) - (ends == 0)
            # a row for each text has a key of its own, no word: it holds a space
            keys = pa.array([b" %d" % x for x in row.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys, pa.array(sizes + 1), pa.array(known), pa.array(sums), pa.array(scores)], names=names)
            if not complete and missing.any():
                k = int(missing.sum())
                blank = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), different.take(pa.array(which[missing])), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(row[text[missing]]), *blank], names=names)

    joined = prepared.texts.select("row", "id", "held_out", "body", "ids").mapInArrow(run, schema).join(counts.words, "word", "left")
    return (
        joined.groupBy("row")
        .agg(
            F.max("id").alias("id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + F.count("c")).alias("n_known"),
            (F.sum("base_score") + F.coalesce(F.sum(F.log10(F.col("c") + 1.0)), F.lit(0.0))).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("row")
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every whole text, learning from those not held out."""
    prepared = prepare(table(spark, sf_dir, "documents"))
    counts = count_words(prepared)
    found = score(prepared, counts, fit(prepared))
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(counts.total).alias("train_tokens"), "base_score", "score")
