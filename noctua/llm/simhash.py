"""Near-duplicate documents by SimHash: fingerprints of word shingles, linked at a few differing bits, and components.

A fingerprint is made where the text is read. Links are found between distinct fingerprints only, by exact comparison
in tiles: numpy exclusive-or and bit counts over blocks of fingerprints in the order of their population counts, where
a pair of blocks is skipped if its population counts differ by more than the radius. Two fingerprints within a radius
r agree wholly in one of r + 1 bands of bits, so tiles are formed within the fingerprints of one band value: work grows
with the pairs that share a band, not with all pairs. A band value with over GROUP fingerprints is dealt out
further, as pairs of tiles (population count, part), each pair a unit of work for any task.

Where pairs are many, a task does not return them but a spanning forest of them (at most one link for each fingerprint),
so a group of n near copies costs n links. Components come from alternating large-star and small-star steps on those links.

annotate() links by fingerprints alone; annotate_similar() has a larger radius and lets the texts' shingles decide: there
a forest would not do, since a link of it may fail, so what it returns is made of tested pairs only. annotate_copies() finds
all texts of a similarity: fingerprints propose, sets decide, and those whose fingerprints lie farther apart meet under their
rarest shingles.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.common import cut, look_up, only, slices, stored, table, unsigned

#: Fingerprints compared within one task at once, at most; more are dealt out as pairs of tiles.
GROUP = 32_768
#: As many with their sets of shingles.
SETS = 4096
#: Values with a HOT-th of all rows or more are dealt out at the latest: there are no more than HOT.
HOT = 100_000
#: Side of a block of the comparison in numpy.
BLOCK = 1024
#: Pairs for each fingerprint of a value up to which all are listed.
PAIRS = 16
#: Hashes of which the bits are summed at once.
SLICE = 65_536
SEED = 42

def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits that are set in over half the XXH64 of the shingles, repeats included; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    a, b = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    for i in range(0, len(a), SLICE):
        hashes = np.array([digest(joined[x:y], SEED) for x, y in zip(a[i : i + SLICE], b[i : i + SLICE])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(a), bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 32-bit hashes; empty without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, "<u4")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    k = min(words, len(found))
    a, b = np.concatenate([[0], ends[:-1] + 1])[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(joined[x:y], SEED) for x, y in zip(a, b)], "<u4"))


def jaccard(a: bytes, b: bytes) -> float:
    """The similarity of two packed shingle sets; 1 if both are empty."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, sets: int | None = None) -> DataFrame:
    """row, id (the key), exact (a hash of the text) and fp (the fingerprint as a signed long) of each row.

    With ``sets``, also the set of its shingles of so many words.
    """

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            columns = {"row": pa.array(rows), "id": batch.column(0), "exact": batch.column(2), "fp": pa.array(found.view(np.int64))}
            if sets:
                columns["shingles"] = pa.array([shingle_set(t, sets).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "row bigint, id bigint, exact bigint, fp bigint" + ", shingles binary" * bool(sets)
    return docs.select(F.col(key).cast("bigint"), F.col(text), F.xxhash64(text)).mapInArrow(run, schema)


def flattened(parent: np.ndarray) -> np.ndarray:
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    return parent


def connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Joins the trees of each a[i] and b[i]; every node points to the root of its tree, before and after.

    Also returns the pairs that joined two trees: as many as there are trees fewer.
    """
    used_a, used_b = [], []
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent, used_a, used_b
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        high, low = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(parent, high, low)
        chosen = np.flatnonzero(parent[high] == low)
        one = np.full(len(parent), -1)
        one[high[chosen]] = chosen
        one = one[one >= 0]
        used_a.append(a[one])
        used_b.append(b[one])
        parent = flattened(parent)


@dataclass(frozen=True)
class Reach:
    """Which two texts may be linked: fingerprints within the radius, and sizes that allow the similarity (if there is one)."""

    radius: int
    similarity: float = 0.0

    def within(self, fp_a, size_a, fp_b, size_b, most: int) -> np.ndarray:
        near = np.bitwise_count(fp_a[:, None] ^ fp_b[None, :]) <= most
        if self.similarity:
            near &= np.minimum.outer(size_a, size_b) >= self.similarity * np.maximum.outer(size_a, size_b)
        return near

    def blocks(self, fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, most: int):
        """Block by block, the places of left and right that may be linked at up to ``most`` bits, as a matrix.

        Both are in the order of the population count, and a pair of blocks too far apart in it is skipped. One and the
        same array on both sides: each pair once.
        """
        ones = np.bitwise_count(fps)
        for i in range(0, len(left), BLOCK):
            a = left[i : i + BLOCK]
            for j in range(i if left is right else 0, len(right), BLOCK):
                b = right[j : j + BLOCK]
                if int(ones[b[0]]) - int(ones[a[-1]]) > most:
                    break
                if int(ones[a[0]]) - int(ones[b[-1]]) > most:
                    continue
                near = self.within(fps[a], sizes[a], fps[b], sizes[b], most)
                yield a, b, np.triu(near, 1) if left is right and i == j else near

    def pairs(self, fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All pairs of places that may be linked; None if there are more than ``most``."""
        x, y, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for a, b, near in self.blocks(fps, sizes, left, right, self.radius):
            if (n := n + np.count_nonzero(near)) > most:
                return None
            i, j = np.nonzero(near)
            x.append(a[i])
            y.append(b[j])
        return np.concatenate(x), np.concatenate(y)

    def linked(self, fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places that may be linked with any."""
        found = np.zeros(len(fps), bool)
        for a, b, near in self.blocks(fps, sizes, left, right, self.radius):
            found[a] |= near.any(axis=1)
            found[b] |= near.any(axis=0)
        return np.flatnonzero(found)

    def forest(self, fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places that connect all that may be linked; a place hangs on one that is close to it where there is such."""
        parent, used_a, used_b = np.arange(len(fps)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for most in sorted({min(self.radius, 4), self.radius}):
            for a, b, near in self.blocks(fps, sizes, left, right, most):
                near &= parent[a][:, None] != parent[b][None, :]
                i, j = np.nonzero(near)
                parent, new_a, new_b = connect(parent, a[i], b[j])
                used_a += new_a
                used_b += new_b
        return np.concatenate(used_a), np.concatenate(used_b)


def similar(sets: list[np.ndarray], own: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the others' sets of shingles are that similar to one; two empty sets are."""
    x, sizes = sets[own], np.array([len(sets[k]) for k in others.tolist()], np.int64)
    flat = np.concatenate([sets[k] for k in others.tolist()])
    hit = np.zeros(len(flat), bool)
    if len(x) and len(flat):
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    both = np.bincount(np.repeat(np.arange(len(others)), sizes), hit, len(others))
    return both >= least * (len(x) + sizes - both)


def first_meeting(a: np.ndarray, b: np.ndarray, cuts: list[tuple[int, int]], flips: int, band: int, value: int) -> np.ndarray:
    """Whether each pair, of those that meet under a band's value, meets under no earlier band and no smaller value.

    Links of other pairs can be left out: both ends meet earlier too, and by induction are connected there.
    """
    a, b = a.view(np.uint64), b.view(np.uint64)
    one = np.uint64(1)
    first = np.ones(len(a), bool)
    for at, bits in cuts[:band]:
        first &= np.bitwise_count((a ^ b) >> np.uint64(at) & np.uint64((1 << bits) - 1)) > 2 * flips
    if not flips:
        return first
    at, bits = cuts[band]
    x, y = ((v >> np.uint64(at)) & np.uint64((1 << bits) - 1) for v in (a, b))
    apart = x ^ y
    low = apart & (~apart + one)
    top = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        top |= top >> np.uint64(k)
    same = x ^ (top ^ top >> one)  # without its highest bit
    least = np.where(apart == 0, same, np.where(apart == low, np.minimum(x, y), np.minimum(x ^ low, y ^ low)))
    return first & (least == np.uint64(value))


@dataclass(frozen=True)
class Bands:
    """Bands of bits. Two fingerprints within the radius differ in at most radius // bands bits in one of them.

    With flips = 1 each fingerprint stands under the values of its bands with up to one bit turned, so those that differ in
    two bits of a band meet: fewer and wider bands for a larger radius.
    """

    bands: int
    flips: int = 0

    def check(self, radius: int) -> None:
        if radius // self.bands > 2 * self.flips:
            raise ValueError("bands of so many bits can miss pairs within the radius")

    @property
    def cuts(self) -> list[tuple[int, int]]:
        width = 64 // self.bands
        return [(i * width, width if i < self.bands - 1 else 64 - i * width) for i in range(self.bands)]

    def own(self) -> list[Column]:
        """band << 32 | value of each band."""
        return [F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1).bitwiseOR(F.lit(i << 32)) for i, (at, bits) in enumerate(self.cuts)]

    def turned(self, value: Column, i: int) -> list[Column]:
        return [value, *(value.bitwiseXOR(1 << k) for k in range(self.cuts[i][1] if self.flips else 0))]


def meetings(nodes: DataFrame, reach: Reach, bands: Bands, group: int | None = None) -> DataFrame:
    """Rows of nodes (node, fp, size and others) under each value at which they meet, those of one value side by side.

    Values of over GROUP rows (or a HOT-th of all) are dealt out as pairs (t, u) of tiles, by population count and hash:
    their number is bounded by HOT, so they are broadcast. How many rows a value has follows from the values
    without turned bits, which are few. All rows are shuffled once.
    """
    bands.check(reach.radius)
    group = max(group or GROUP, nodes.count() * len(bands.own()) * (1 + 64 // bands.bands * bands.flips) // HOT)
    counts = nodes.select(F.explode(F.array(*bands.own())).alias("at")).groupBy("at").count()
    if bands.flips:
        band = F.shiftright("at", 32)
        spread = F.coalesce(*(F.when(band == i, F.array(*bands.turned(F.col("at"), i))) for i in range(bands.bands)))
        counts = counts.select(F.explode(spread).alias("at"), "count").groupBy("at").agg(F.sum("count").alias("count"))
    hot = counts.where(F.col("count") > group).select("at", F.ceil(F.col("count") / (4 * group)).cast("int").alias("parts"))
    every = nodes.withColumn("at", F.explode(F.array(*(v for i, own in enumerate(bands.own()) for v in bands.turned(own, i)))))
    tiles = every.join(F.broadcast(hot), "at", "left").withColumn("tile", F.expr("IF(parts IS NULL, -1, bit_count(fp) * parts + pmod(xxhash64(node), parts))").cast("int"))
    ones, radius, parts = F.bit_count("fp"), reach.radius, F.col("parts")
    partners = F.when(parts.isNull(), F.array(F.lit(-1))).otherwise(F.sequence((ones - radius) * parts, (ones + radius + 1) * parts - 1).cast("array<int>"))
    pairs = tiles.select("at", "tile", *nodes.columns, F.explode(partners).alias("other"))
    pairs = pairs.select("at", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", *nodes.columns)
    return pairs.repartition("at", "t", "u").sortWithinPartitions("at", "t", "u")


def groups_of(batches):
    """The rows of each (at, t, u) with two rows or more: an array of the integer columns, and the binary ones as lists."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        plain = [c for c in batch.columns if not pa.types.is_binary(c.type)]
        rows = np.stack([c.cast(pa.int64()).to_numpy() for c in plain])
        more = [c.to_pylist() for c in batch.columns if pa.types.is_binary(c.type)]
        if held:
            rows, more = np.concatenate([held[0], rows], axis=1), [x + y for x, y in zip(held[1], more)]
        begins = np.append(0, np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if b - a > 1:
                yield rows[:, a:b], [x[a:b] for x in more]
        held = rows[:, begins[-1] :], [x[begins[-1] :] for x in more]
    if held and held[0].shape[1] > 1:
        yield held


def sides(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a group: node, fp, size, and the places on its left and right side in the order of the population count."""
    t, u, own = rows[1, 0], rows[2, 0], rows[3]
    fps = np.ascontiguousarray(rows[5]).view(np.uint64)
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    left = order if t == u == -1 else order[own[order] == t]
    return rows[4], fps, rows[6], left, left if t == u else order[own[order] == u]


def edges_of(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def proposals(nodes: DataFrame, reach: Reach, bands: Bands, forests: bool) -> DataFrame:
    """a, b: pairs of nodes (node, fp, size) that may be linked, each told once.

    Where the nodes of a value have at most PAIRS pairs for each of them, those are all its pairs. Where they have more, as
    thousands of near copies do, a forest that connects them (``forests``), or nothing but each of its nodes as
    (node, node): all pairs that are missing are between such nodes.
    """
    cuts, flips, most = bands.cuts, bands.flips, PAIRS

    def compare(batches):
        for rows, _ in groups_of(batches):
            at = int(rows[0, 0])
            node, fps, size, left, right = sides(rows)
            pairs = reach.pairs(fps, size, left, right, most * len(fps))
            if pairs is None and not forests:
                several = node[reach.linked(fps, size, left, right)]
                yield edges_of(several, several)
                continue
            x, y = pairs or reach.forest(fps, size, left, right)
            if len(x):
                first = first_meeting(fps[x], fps[y], cuts, flips, at >> 32, at & 0xFFFFFFFF)
                yield edges_of(node[x[first]], node[y[first]])

    return meetings(nodes.select("node", "fp", "size"), reach, bands).mapInArrow(compare, "a bigint, b bigint").distinct()


def links(distinct: DataFrame, radius: int = 2, bands: int | None = None, flips: int = 0) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct fp within the radius."""
    nodes = distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("bigint").alias("size"))
    return proposals(nodes, Reach(radius), Bands(bands or radius + 1, flips), forests=True)


def verified(nodes: DataFrame, reach: Reach, bands: Bands) -> DataFrame:
    """a, b: pairs of nodes (node, fp, size, shingles) that are similar, whose components are those of all such pairs.

    Every pair within the radius is tested where it first meets, the closest first, unless tested pairs connect it already.
    """
    cuts, flips, least = bands.cuts, bands.flips, reach.similarity

    def compare(batches):
        for rows, (packed,) in groups_of(batches):
            at = int(rows[0, 0])
            node, fps, size, left, right = sides(rows)
            sets, tree, used = [np.frombuffer(x, "<u4") for x in packed], np.arange(len(fps)), []
            for a, b, near in reach.blocks(fps, size, left, right, reach.radius) if len(left) and len(right) else ():
                near &= tree[a][:, None] != tree[b][None, :]
                x, y = np.nonzero(near)
                x, y = a[x], b[y]
                first = first_meeting(fps[x], fps[y], cuts, flips, at >> 32, at & 0xFFFFFFFF)
                x, y = x[first], y[first]
                order = np.lexsort((np.bitwise_count(fps[x] ^ fps[y]), x))
                x, y = x[order], y[order]
                for others in np.split(y, np.flatnonzero(x[1:] != x[:-1]) + 1) if len(x) else ():
                    own, x, k = int(x[0]), x[len(others) :], 1
                    while len(others := others[tree[others] != tree[own]]):
                        some, others, k = others[:k], others[k:], min(4 * k, 256)
                        for other in some[similar(sets, own, some, least)].tolist():
                            if tree[other] != tree[own]:
                                used.append((own, other))
                                tree[tree == tree[other]] = tree[own]
            if used:
                yield edges_of(*(node[list(side)] for side in zip(*used)))

    dealt = meetings(nodes.select("node", "fp", "size", "shingles"), reach, bands, SETS)
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


#: Links in a part, about: a round of components() shuffles several times, and each part then makes files, however few its rows.
LINKS = 250_000


def packed(rows: DataFrame, count: int) -> DataFrame:
    """The rows in no more parts than their number asks for."""
    return rows.coalesce(max(-(-count // LINKS), 1))


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of an edge but the root itself, with the least node of its component.

    Large-star, then small-star, until the edges are stars and no longer change; the rounds grow with the logarithm
    of the nodes. The least neighbour of each node comes from a partial aggregate, and meets the edges by look_up().
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = packed(edges, edges.count())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, total = now, now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = look_up(both, least, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(packed(packed(large, 2 * total).distinct(), total))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = look_up(large, least, "u", "n", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = packed(small.unionByName(least.select("u", F.col("m").alias("v"))), 2 * total)
        edges = cut(packed(small.distinct(), total))


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: id, exact, fp, component_id (the smallest key reachable over links, itself included), kept.

    Null and empty texts have the fingerprint zero and are linked like any other. Keys that are null are the largest;
    a component of null keys only has a null id. Of each component the row of the smallest key is kept, of
    repeated rows the first read.
    """
    rows = cut(fingerprints(docs, key, text, words))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    distinct = cut(rows.groupBy("fp").agg(first.alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    groups = labelled.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("fps"))
    named = cut(look_up(labelled, groups, "root", "fps", distinct.count()).select("fp", "first", "n"))
    found = look_up(rows, named, "fp", "n", rows.count())
    return found.select("id", "exact", "fp", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def annotate_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 11, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As annotate(), but fingerprints within a larger radius only propose links, and the shingles of the texts decide.

    A link holds if the Jaccard similarity of the two texts' sets of ``shingle`` words is at least ``similarity``: the
    result is the components of all pairs of texts within the radius that are that similar, however the table is split.
    Pairs that proposals() lists are tested by joins with the sets; those of values with too many pairs are between few
    texts, which go with their sets to where they meet, and are tested there by verified().
    """
    reach, bands = Reach(radius, similarity), Bands(4, 1)
    rows = cut(fingerprints(docs, key, text, words, sets=shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    texts = rows.groupBy("exact").agg(first.alias("least"), F.min("fp").alias("fp"), F.min((F.length("shingles") / 4).cast("bigint")).alias("size"), F.count("*").alias("n"))
    texts = cut(texts.withColumn("node", F.col("least.row")))
    proposed = cut(proposals(texts, reach, bands, forests=False))
    pairs, several = proposed.where("a <> b"), proposed.where("a = b").select(F.col("a").alias("node"))
    sets = rows.select(F.col("row").alias("node"), "shingles")

    def alike(batches):
        for batch in batches:
            good = [jaccard(p, q) >= similarity for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = cut(sets.join(ends, "node", "left_semi"))  # of texts that a pair is proposed for
    x, y = (own.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    good = pairs.join(y, "b").join(x, "a").select("a", "b", "a_set", "b_set").mapInArrow(alike, "a bigint, b bigint")
    if not several.isEmpty():
        members = cut(several.join(texts.select("node", "fp", "size"), "node").join(sets, "node"))
        good = good.unionByName(verified(members, reach, bands))
    roots = components(good)
    labelled = cut(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = labelled.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("texts"))
    named = cut(look_up(labelled, groups, "root", "texts", texts.count()).select("exact", "first", "n"))
    found = look_up(rows.drop("shingles"), named, "exact", "n", rows.count())
    return found.select("id", "exact", "fp", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


#: Buckets in which shingles are counted, so that rare ones come first; all sums of one task are 4 bytes each.
BUCKETS_LOG2 = 22
#: Bits up to which any two fingerprints propose a pair of texts, before rare shingles do.
NEAR = 2
#: Texts under one shingle up to which all their pairs are listed.
LISTED = 33
#: Numbers of texts that are sent to all tasks, at most (8 bytes each); of more, sets of shingles are shuffled to them.
SENT = 1_000_000
#: Counts of tasks that are added up at once.
FAN_IN = 32


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles fall into each bucket: tasks' counts are added up FAN_IN at a time. Any counts give a right
    result, as they only order shingles; better ones a faster one."""
    kind = pa.schema([("lane", pa.int64()), ("n", pa.binary())])
    most = np.iinfo(np.uint32).max

    def count(batches):
        total = np.zeros(1 << BUCKETS_LOG2, np.int64)
        for batch in slices(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4") >> (32 - BUCKETS_LOG2), minlength=len(total))
        yield pack(TaskContext.get().partitionId(), total)

    def pack(lane: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lane]), pa.array([zlib.compress(np.minimum(total, most).astype("<u4").tobytes(), 1)])], schema=kind)

    def unpack(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)

    def add(data: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pack(data.column("lane")[0].as_py(), sum(map(unpack, data.column("n").to_pylist())))])

    partial = cut(sets.select("shingles").mapInArrow(count, "lane bigint, n binary"))
    left = (partial.agg(F.max("lane")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        partial = partial.withColumn("lane", F.floor(F.col("lane") / FAN_IN)).groupBy("lane").applyInArrow(add, "lane bigint, n binary")
    return sum((unpack(bytes(r.n)) for r in partial.collect()), np.zeros(1 << BUCKETS_LOG2, np.int64)).astype("<u4")  # one row


def needed(size: int, similarity: float) -> int:
    """Shingles of a set of that size that any set so similar shares."""
    return int(np.ceil(similarity * size - 1e-9))


def filed(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """at, node, size, nth, last: each set of shingles (node, shingles) under its rarest ones.

    As many as a similar set cannot lack all of: two similar sets share one of these. nth is the place of the shingle in the
    order, last are the two before it. Sets without shingles are under -1.
    """
    shipped = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        often = shipped.value
        for batch in slices(batches):
            parts: list[list[np.ndarray]] = []
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(packed, "<u4")
                n = len(own)
                first = own[np.lexsort((own, often[own >> (32 - BUCKETS_LOG2)]))[: n - needed(n, similarity) + 1]].astype(np.int64) if n else np.full(1, -1)
                k = len(first)
                before = np.concatenate([[0, 0], first[:-1]])[:k + 1]
                parts.append([first, np.full(k, node), np.full(k, n), np.arange(k), before[1 : k + 1] << 32 | before[:k]])
            columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "node", "size", "nth", "last"])

    return sets.select("node", "shingles").mapInArrow(run, "at bigint, node bigint, size bigint, nth bigint, last bigint")


def met_before(nth_a, last_a, nth_b, last_b) -> np.ndarray:
    """Whether two texts share one of the two shingles before the one they meet under: then they have met there."""
    out = np.zeros(np.broadcast(nth_a, nth_b).shape, bool)
    low = 0xFFFFFFFF
    for i, x in ((1, last_a >> 32 & low), (2, last_a & low)):
        for j, y in ((1, last_b >> 32 & low), (2, last_b & low)):
            out |= (nth_a >= i) & (nth_b >= j) & (x == y)
    return out


def may_be_similar(size_a, nth_a, size_b, nth_b, similarity: float) -> np.ndarray:
    """Whether two texts can be that similar, if they meet for the first time at these places of their orders: by their
    sizes, and by how many shingles they have from there on. Where they have met before, that meeting counts."""
    least = similarity / (1 + similarity) * (size_a + size_b)  # shingles in common of a similar pair
    return (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9) & (np.minimum(size_a - nth_a, size_b - nth_b) >= least - 1e-6)


def met(filing: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs that meet under a shingle of few texts, if their sizes allow the similarity. Of shingles of over LISTED
    texts, the rows themselves: node as a, no b, and at, size, nth, last. No group is held."""

    def run(batches):
        held, large = np.zeros((5, 0), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            starts = np.append(0, np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1)
            sizes = np.diff(np.append(starts, rows.shape[1]))
            wide = np.repeat((sizes > LISTED) | (rows[0, starts] == large if large is not None else False), sizes)
            keep_from = rows.shape[1] if wide[-1] else int(starts[-1])  # the last group may go on
            large = int(rows[0, -1]) if wide[-1] else None
            yield from told(rows[:, :keep_from], wide[:keep_from])
            held = rows[:, keep_from:]
        if held.shape[1]:
            yield from told(held, np.zeros(held.shape[1], bool))

    def told(rows, wide):
        if wide.any():
            at, node, size, nth, last = rows[:, wide]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), *map(pa.array, (at, size, nth, last))], names=MET_NAMES)
        at, node, size, nth, last = rows[:, ~wide]
        n = len(at)
        if n < 2:
            return
        starts = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        partners = ends - np.arange(n) - 1
        x = np.repeat(np.arange(n), partners)
        y = np.arange(len(x)) - np.repeat(np.cumsum(partners) - partners, partners) + x + 1
        near = may_be_similar(size[x], nth[x], size[y], nth[y], similarity)
        x, y = x[near], y[near]
        new = ~met_before(nth[x], last[x], nth[y], last[y])
        a, b = node[x[new]], node[y[new]]
        blank = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), blank, blank, blank, blank], names=MET_NAMES)

    return filing.repartition("at").sortWithinPartitions("at").mapInArrow(run, ", ".join(f"{c} bigint" for c in MET_NAMES))


MET_NAMES = ["a", "b", "at", "size", "nth", "last"]


def left_apart(marks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: similar pairs among rows (node, at, size, nth, last, label) of one shingle that have different labels.

    Sets go to where they meet, under those shingles only whose texts have several labels. More than SETS texts of a
    shingle are dealt out as pairs of tiles.
    """
    kinds = marks.groupBy("at").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least <> most")
    parts = F.ceil(F.col("n") / SETS).cast("int")
    rows = marks.join(kinds.select("at", parts.alias("parts")), "at").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("at", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "node", "size", "nth", "last", "label").join(sets, "node")
    dealt = dealt.select("at", "t", "u", "tile", "node", "size", "nth", "last", "label", "shingles")

    def compare(batches):
        for rows, (packed,) in groups_of(batches):
            t, u, tile, node, size, nth, last, label = rows[1, 0], rows[2, 0], *rows[3:9]
            sets, tree, used = [np.frombuffer(x, "<u4") for x in packed], np.unique(label, return_inverse=True)[1], []
            for own in np.flatnonzero(tile == t).tolist():
                far = (tree != tree[own]) & ((tile == u) if t != u else (np.arange(len(node)) > own))
                far &= may_be_similar(size, nth, size[own], nth[own], similarity)
                others = np.flatnonzero(far & ~met_before(nth, last, nth[own], last[own]))
                k = 1
                while len(others := others[tree[others] != tree[own]]):
                    some, others, k = others[:k], others[k:], min(4 * k, 256)
                    for other in some[similar(sets, own, some, similarity)].tolist():
                        if tree[other] != tree[own]:
                            used.append((own, other))
                            tree[tree == tree[other]] = tree[own]
            if used:
                yield edges_of(*(node[list(side)] for side in zip(*used)))

    return dealt.repartition("at", "t", "u").sortWithinPartitions("at", "t", "u").mapInArrow(compare, "a bigint, b bigint").distinct()


def annotate_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 11, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As annotate_similar(), for all pairs of texts that are that similar, however far their fingerprints lie apart.

    SimHash comes first, as in annotate(): all fingerprints are compared in tiles and propose at NEAR bits, sets decide. It finds
    most copies, but not all that are that similar. So each text is also filed under its rarest shingles, as many as a similar
    text cannot lack all of, and similar texts meet under one of these. Pairs under shingles of few texts are tested by joins with the sets. Texts under shingles of many, which
    mostly are copies by the hundred, are first linked by annotate_similar()'s tiles of fingerprints and tests of sets; then
    those that this left apart are tested where they meet. Pairs compared grow with texts that share rare shingles.
    """
    rows = cut(fingerprints(docs, key, text, words, sets=shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    size = F.min((F.length("shingles") / 4).cast("bigint"))
    texts = cut(rows.groupBy("exact").agg(first.alias("least"), F.min("fp").alias("fp"), size.alias("size"), F.count("*").alias("n")).withColumn("node", F.col("least.row")))
    sets = rows.select(F.col("row").alias("node"), "shingles")
    if texts.count() < rows.count():  # equal texts: one of each
        sets = sets.join(texts.select("node"), "node", "left_semi")
    found = stored(met(filed(sets, shingle_counts(rows), similarity), similarity), "met")
    pairs, marks = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL").select(F.col("a").alias("node"), "at", "size", "nth", "last")

    def alike(batches):
        for batch in batches:
            good = [jaccard(p, q) >= similarity for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    near = cut(proposals(texts, Reach(NEAR, similarity), Bands(NEAR + 1), forests=False))
    pairs = cut(pairs.unionByName(near.where("a <> b")).distinct())
    several = cut(marks.select("node").unionByName(near.where("a = b").select(F.col("a").alias("node"))).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(several).distinct()
    ends = cut(ends)
    few = F.broadcast(ends) if ends.count() <= SENT else ends
    own = stored(rows.select(F.col("row").alias("node"), "shingles").join(few, "node", "left_semi"), "sets")  # of texts that meet others
    x, y = (own.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    good = pairs.join(y, "b").join(x, "a").select("a", "b", "a_set", "b_set").mapInArrow(alike, "a bigint, b bigint")
    if several.isEmpty():
        roots = components(stored(good, "links"))
    else:
        members = several.join(texts.select("node", "fp", "size"), "node").join(own, "node")
        good = stored(good.unionByName(verified(members, Reach(radius, similarity), Bands(4, 1))), "links")  # read back in few partitions
        roots = components(good)
        apart = marks.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        more = stored(left_apart(apart, own, similarity), "links")
        if not more.isEmpty():
            roots = components(good.unionByName(more))
    labelled = cut(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = labelled.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("texts"))
    named = cut(look_up(labelled, groups, "root", "texts", texts.count()).select("exact", "first", "n"))
    back = look_up(rows.drop("shingles"), named, "exact", "n", rows.count())
    return back.select("id", "exact", "fp", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs from each group of near copies (five words, a similarity of 0.8), with all its columns."""
    return only(docs, key, text, annotate_copies(docs, key, text).select("id", "exact", "kept"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = annotate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), unsigned(F.col("fp")).alias("fingerprint"), "component_id")
