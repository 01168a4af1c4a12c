"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

A is a byte-level BPE file, B a sentencepiece model that puts a space before the text; both spell space + text, and each
token covers a range of its bytes. Every token points to its farthest-right overlapping token (of equals, the one of B):
the token of the other kind that covers its last byte, or itself if none reaches farther. Doubling the pointers (s = s[s])
leads each token to the last one of its component in a number of rounds that is the logarithm of the longest chain; that
last token labels the group. All tokens of a batch are jumped at once.

A text is cut into units at each single space between two non-space characters. Neither tokenizer joins bytes across such
a place (for B it is looked up in its vocabulary; where a piece does, texts are not cut), so units are aligned on their own
and a worker keeps those it has met. Texts of any length are read whole.

prepare() reads the texts once and writes a table: of each text its counts, digest and linked id pairs, and the pairs that
a task has counted, a text at most once for each. Counts of pairs are partial sums, then a shuffle. In the second pass the
TOP most frequent pairs go to the tasks; of others each text's leave as rows, are joined by a shuffle and come back as sums.

A text that is null, empty, or that the tokens of A or B do not spell (one with U+2581, which B takes for a space) has no
tokens: its counts are 0, its groups empty. Repeated rows count as often as they come. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from noctua.llm import bpe
from noctua.llm.common import most_frequent, quoted, shared_folder, slices, stored, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units, and tokens of them, that a worker keeps, at most; then it starts anew.
KEEP_UNITS, KEEP_TOKENS = 300_000, 3_000_000
#: Distinct pairs that a task counts before it passes them on and begins anew.
HELD = 400_000
#: Pairs whose counts tasks hold, at most: 17 bytes each.
TOP = 1_000_000
#: Units of one text for the library of A.
CALL = 4000
#: The only places where texts are cut.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


def files(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """The contents of both tokenizers' files, as tasks are sent them."""
    with open(a or public_tokenizers.path(A_FILE), encoding="utf-8") as one, open(b or public_tokenizers.path(B_FILE), "rb") as two:
        return one.read(), two.read()


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from 0 on, by pointer jumping over the bytes at which tokens end.

    Both cover the same bytes, so their last ends are equal. Tokens of A are numbered before those of B.
    """
    n = len(a_ends)
    covers_a = n + np.searchsorted(b_ends, a_ends)
    covers_b = np.searchsorted(a_ends, b_ends)
    own = np.arange(n, n + len(b_ends))
    to = np.concatenate([covers_a, np.where(a_ends[covers_b] > b_ends, covers_b, own) if n else own])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            break
        to = farther
    last = np.flatnonzero(to == np.arange(len(to)))
    group = np.searchsorted(last, to)
    return group[:n], group[n:]


def distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id of each group once: groups, ids, how often it comes there."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def pairs_of(a_group: np.ndarray, a: np.ndarray, b_group: np.ndarray, b: np.ndarray, sizes: tuple[int, int], groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct id pairs of each group: groups, pairs (a * size of B + b), links."""
    ga, ia, na = distinct(a_group, a, sizes[0])
    gb, ib, nb = distinct(b_group, b, sizes[1])
    count_b = np.bincount(gb, minlength=groups)
    first_b = np.cumsum(count_b) - count_b
    each = count_b[ga]
    left, right = np.repeat(np.arange(len(ga)), each), bpe.ragged(first_b[ga], each)
    return ga[left], ia[left] * sizes[1] + ib[right], na[left] * nb[right]


class Ragged:
    """Numbers in stretches, one for each unit."""

    def __init__(self, kind):
        self.flat, self.starts, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.sizes, sizes])

    def of(self, units: np.ndarray) -> np.ndarray:
        return self.flat[bpe.ragged(self.starts[units], self.sizes[units])]


class Aligner:
    """Both tokenizers and the units that a worker has aligned with them."""

    def __init__(self, a_file: str, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        back = {c: b for b, c in enumerate(bpe.byte_characters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = len(self.a_bytes), len(self.b_bytes)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in b], np.int64) for b in (self.a_bytes, self.b_bytes))
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.pair_kind = "<u4" if self.sizes[0] * self.sizes[1] <= 1 << 32 else "<u8"
        self.forget()

    def forget(self) -> None:
        self.asked: list[str] = []
        self.number = bpe.Numbered(self.asked, "")
        self.written: list[bytes] = []
        self.ids, self.groups = (Ragged(np.uint32), Ragged(np.uint32)), (Ragged(np.uint32), Ragged(np.uint32))
        self.pairs, self.links = Ragged(np.int64), Ragged(np.int64)
        self.spelt, self.n_groups, self.n_links = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of the units of each text; new units are aligned."""
        if len(self.asked) > KEEP_UNITS or len(self.ids[0].flat) > KEEP_TOKENS:
            self.forget()
        found = [[] if not t or SPACE in t else list(map(self.number.__getitem__, CUT.split(t) if self.cut else (t,))) for t in texts]
        if len(self.written) < len(self.asked):
            self.learn(self.asked[len(self.written) :])
        return found

    def learn(self, units: list[str]) -> None:
        """Encodes and aligns units; each is told without the space before it."""
        ids, counts = zip(self.encode_a(units), self.encode_b(units))
        spelt = np.ones(len(units), bool)
        whole = ("".join(f" {u}" for u in units)).encode()
        if any(b"".join(map(names.__getitem__, x.tolist())) != whole for names, x in zip((self.a_bytes, self.b_bytes), ids)):
            for names, x, n in zip((self.a_bytes, self.b_bytes), ids, counts):
                each, at = x.tolist(), np.cumsum(n).tolist()
                for i, (u, y, z) in enumerate(zip(units, [0, *at], at)):
                    spelt[i] &= b"".join(map(names.__getitem__, each[y:z])) == b" " + u.encode()
            ids = [x[np.repeat(spelt, n)] for x, n in zip(ids, counts)]
            counts = [n * spelt for n in counts]
        groups = jump(np.cumsum(self.a_lengths[ids[0]]), np.cumsum(self.b_lengths[ids[1]]))
        total = int(groups[1][-1]) + 1 if len(groups[1]) else 0
        unit = np.repeat(np.arange(len(units)), counts[1])
        unit_of = np.zeros(total, np.int64)
        unit_of[groups[1]] = unit
        n_groups = np.bincount(unit_of, minlength=len(units)) if total else np.zeros(len(units), np.int64)
        first = np.cumsum(n_groups) - n_groups
        for k in (0, 1):
            self.ids[k].add(ids[k], counts[k])
            self.groups[k].add(groups[k] - np.repeat(first, counts[k]), counts[k])
        group, pair, links = pairs_of(groups[0], ids[0], groups[1], ids[1], self.sizes, total)
        before = np.concatenate([[0], np.cumsum(links)])
        per_unit = np.bincount(unit_of[group], minlength=len(units)) if total else np.zeros(len(units), np.int64)
        ends = np.cumsum(per_unit)
        self.pairs.add(pair, per_unit)
        self.links.add(links, per_unit)
        self.spelt, self.n_groups = np.concatenate([self.spelt, spelt]), np.concatenate([self.n_groups, n_groups])
        self.n_links = np.concatenate([self.n_links, before[ends] - before[ends - per_unit]])
        self.written += self.write(ids, groups, counts)

    def encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all units, and how many each has. Units without white space go to the library joined, CALL at a time."""
        plain = np.fromiter((u != "" and len(u.split(None, 1)) == 1 and not u[0].isspace() and not u[-1].isspace() for u in units), bool, len(units))
        joined, odd = [u for u, p in zip(units, plain) if p], [u for u, p in zip(units, plain) if not p]
        texts = ["".join(f" {u}" for u in joined[i : i + CALL]) for i in range(0, len(joined), CALL)]
        found = [e.ids for e in self.a.encode_batch_fast([*texts, *(" " + u for u in odd)], add_special_tokens=False)]
        together = np.fromiter(chain.from_iterable(found[: len(texts)]), np.int64)
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in joined), np.int64, len(joined)))
        cuts = np.searchsorted(np.cumsum(self.a_lengths[together]), ends, "right")  # no token crosses units
        counts = np.zeros(len(units), np.int64)
        counts[plain], counts[~plain] = np.diff(cuts, prepend=0), [len(x) for x in found[len(texts) :]]
        ids = np.empty(counts.sum(), np.int64)
        own = np.repeat(plain, counts)
        ids[own], ids[~own] = together, np.fromiter(chain.from_iterable(found[len(texts) :]), np.int64)
        return ids, counts

    def encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode(units, num_threads=1)  # it adds the space
        counts = np.fromiter(map(len, found), np.int64, len(units))
        return np.fromiter(chain.from_iterable(found), np.int64, counts.sum()), counts

    @staticmethod
    def write(ids: list[np.ndarray], groups: tuple[np.ndarray, np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
        """The groups of each unit as text: ids of A, a bar, ids of B; groups parted by semicolons."""
        order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")
        after = [np.where(np.diff(g, append=-1) == 0, ",", mark) for g, mark in zip(groups, "|;")]
        some = counts[1] > 0
        after[1][np.cumsum(counts[1])[some] - 1] = "\n"  # the last of a unit
        marks, each = np.concatenate(after)[order].tolist(), np.concatenate(ids)[order].tolist()
        lines = "".join(map(str.__add__, map(str, each), marks)).encode().split(b"\n")
        lines = iter(lines)
        return [next(lines) if x else b"" for x in some.tolist()]

    def aligned(self, texts: list[str | None]):
        """For each text: its units (none if it is not spelt)."""
        found = [np.array(x, np.int64) for x in self.numbers(texts)]
        return [u if len(u) and self.spelt[u].all() else u[:0] for u in found]


_LOADED: dict[int, Aligner] = {}


def loaded(contents: tuple[str, bytes]) -> Aligner:
    """The worker's aligner of these files: later tasks of the worker use it, and the units it knows, again."""
    key = hash(contents)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(*contents)
    return _LOADED[key]


def sums(values: np.ndarray, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the units' values for each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values[units])])[np.concatenate([[0], ends])])


def align(docs: DataFrame, text: str = "text", contents: tuple[str, bytes] | None = None) -> DataFrame:
    """Adds the tokens and groups of each text, as arrays: a_ids, a_ends (the byte of space + text at which each token of A
    ends), a_groups (the number of its group in the text), and b_ids, b_ends, b_groups.

    Columns of those names are replaced, others pass through. Texts without tokens: empty arrays. Narrow.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(contents or files())
    added = [f"{k}_{x}" for k in "ab" for x in ("ids", "ends", "groups")]
    kept = [c for c in docs.columns if c not in added]
    if text not in kept:
        raise ValueError(f"no column {text}")
    schema = docs.select(*map(quoted, kept)).schema
    for name in added:
        schema = schema.add(name, T.ArrayType(T.LongType() if name.endswith("ends") else T.IntegerType()))

    def run(batches):
        own = loaded(shipped.value)
        for batch in slices(batches):
            units = own.aligned(batch.column(text).to_pylist())
            arrays = []
            for k, lengths in enumerate((own.a_lengths, own.b_lengths)):
                each = [own.ids[k].of(u).astype(np.int64) for u in units]
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in each])]), pa.int32())
                group = [own.groups[k].of(u).astype(np.int64) + np.repeat(np.cumsum(own.n_groups[u]) - own.n_groups[u], own.ids[k].sizes[u]) for u in units]
                for values, kind in ((each, pa.int32()), ([np.cumsum(lengths[x]) for x in each], pa.int64()), (group, pa.int32())):
                    arrays.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *arrays], names=[*kept, *added])

    return docs.select(*map(quoted, kept)).mapInArrow(run, schema)


ROW = "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, links binary, pair bigint, n bigint"
NAMES = [x.split()[0] for x in ROW.split(", ")]
KINDS = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


class Counter:
    """Counts of pairs as sorted runs, merged when the new ones are as many as those that are merged."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.merged = 0

    def add(self, keys: np.ndarray) -> None:
        self.runs.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.runs) > 2 * self.merged + 50_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([np.zeros(0, np.int64), *(r[i] for r in self.runs)]) for i in (0, 1))
        found, back = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, n)
        self.runs, self.merged = [(found, total)], len(found)
        return found, total


def prepare(docs: DataFrame, key: str = "doc_id", text: str = "text", contents: tuple[str, bytes] | None = None) -> DataFrame:
    """One row for each text (``pair`` is null): its counts, digest, distinct pairs and their links as bytes; and rows of
    counted pairs: pair, n (texts of a task that hold it linked). Written to the shared folder."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(contents or files())

    def run(batches):
        own, row, counter = loaded(shipped.value), TaskContext.get().partitionId() << 40, Counter()
        size = own.sizes[0] * own.sizes[1]
        for batch in slices(batches):
            texts = own.aligned(batch.column(1).to_pylist())
            units, ends, n = np.concatenate([np.zeros(0, np.int64), *texts]), np.cumsum([len(u) for u in texts]), len(texts)
            text_of = np.repeat(np.arange(n), [len(u) for u in texts])
            keyed, back = np.unique(np.repeat(text_of, own.pairs.sizes[units]) * size + own.pairs.of(units), return_inverse=True)
            links = np.zeros(len(keyed), np.int64)
            np.add.at(links, back, own.links.of(units))
            pairs, cuts = keyed % size, np.searchsorted(keyed, np.arange(n + 1) * size).tolist()
            counter.add(pairs)
            digests = [hashlib.sha256(b";".join(map(own.written.__getitem__, u.tolist()))).hexdigest() if len(u) else "" for u in texts]
            packed, times = pairs.astype(own.pair_kind), links.astype("<i8")
            columns = [pa.array(np.arange(row, row + n)), batch.column(0)]
            columns += [pa.array(sums(v, units, ends)) for v in (own.ids[0].sizes, own.ids[1].sizes, own.n_groups, own.n_links)]
            columns += [pa.array(digests, pa.string()), *(pa.array([v[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()) for v in (packed, times))]
            row += n
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=NAMES)
            if counter.merged > HELD:
                yield counted(counter)
                counter = Counter()
        yield counted(counter)

    def counted(counter: Counter):
        pairs, n = counter.merge()
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), k) for k in KINDS[:9]), pa.array(pairs), pa.array(n)], names=NAMES)

    folder = shared_folder(spark, "alignment")
    docs.select(quoted(key).cast("bigint").alias("id"), quoted(text).alias("text")).mapInArrow(run, ROW).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(ROW).parquet(folder)


def pair_counts(prepared: DataFrame, b_size: int) -> DataFrame:
    """pair, a_id, b_id, c (texts that hold the pair linked), best (c is the highest of its A id)."""
    counts = prepared.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("c")).withColumn("a_id", F.expr(f"pair div {b_size}"))
    counts = stored(counts, "pairs")
    highest = F.broadcast(counts.groupBy("a_id").agg(F.max("c").alias("most")))  # a row for each id of A at most
    return counts.join(highest, "a_id").select("pair", "a_id", F.expr(f"pair % {b_size}").alias("b_id"), "c", (F.col("c") == F.col("most")).alias("best"))


def summed(prepared: DataFrame, counts: DataFrame, pair_kind: str, top: int = TOP) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each text, from prepare() and pair_counts()."""
    spark = prepared.sparkSession
    counts = stored(counts.select("pair", "c", "best"), "counts")
    known = [np.array(x) for x in zip(*((r.pair, r.c, r.best) for r in most_frequent(counts, top).toLocalIterator()))]
    order = np.argsort(known[0]) if known else []
    known = [x[order] for x in known] if known else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    complete = len(known[0]) == counts.count()
    shipped = spark.sparkContext.broadcast(known)
    plain = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pair bigint, links bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        keys, c, best = shipped.value
        for batch in slices(batches):
            n = batch.num_rows
            each = [np.frombuffer(x, pair_kind) for x in batch.column(7).to_pylist()]
            text = np.repeat(np.arange(n), [len(x) for x in each])
            pairs = np.concatenate([np.zeros(0, np.int64), *each]).astype(np.int64)
            links = np.frombuffer(b"".join(batch.column(8).to_pylist()), "<i8")
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            own = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            if len(keys):
                np.add.at(own[0], text[hit], links[hit] * best[at[hit]])
                np.add.at(own[1], text[hit], links[hit] * c[at[hit]])
            blank = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), *map(pa.array, own), blank, blank], names=names)
            left = np.flatnonzero(~hit)
            if len(left):
                row = batch.column(0).to_numpy()[text[left]]
                blank = [*(pa.nulls(len(left), k) for k in KINDS[1:7]), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(row), *blank, pa.array(pairs[left]), pa.array(links[left])], names=names)

    texts = prepared.where("pair IS NULL").select(*plain, "pairs", "links")
    found = texts.mapInArrow(run, schema)
    if complete:
        return found.drop("row", "pair", "links")
    found = stored(found, "sums")
    more = found.where("pair IS NOT NULL").select("row", "pair", "links").join(counts, "pair")
    more = more.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("c")).alias("more_sum"))
    whole = found.where("pair IS NULL").join(more, "row", "left")
    return whole.select(*plain[1:], *((F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))))


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", contents: tuple[str, bytes] | None = None, top: int = TOP) -> DataFrame:
    """Each text's counts of tokens, groups and links, the digest of its groups, and how its links stand in the corpus."""
    contents = contents or files()
    aligner = Aligner(*contents)
    prepared = prepare(docs, key, text, contents)
    found = summed(prepared, pair_counts(prepared, aligner.sizes[1]), aligner.pair_kind, top)
    return found.withColumnRenamed("id", key)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents aligned; pairs counted over all of them."""
    return summaries(table(spark, sf_dir, "documents"))
