"""Hard-negative mining: exact integer inner products of anchors and all rows by Strassen's recursion, then bounded heaps.

Rows are dealt to cells of a grid, anchors by one side and candidates by the other, so each anchor meets each row in one
cell and no cell grows with the table. In a cell tiles of int64 anchors and candidates are padded with zeros to even
sizes and multiplied with seven products of quarter tiles instead of eight, down to small leaves. Additions of int64 are
exact modulo 2^64, so a score that fits in 64 bits is right whatever the sums on the way were.

Two passes: the first keeps each anchor's best rows of its own label, the second, for each of these positives, the best
rows of other labels in the window of scores that it sets. A heap is at most so many (score, row) in order; heaps of
tiles are merged in a cell, those of cells by a ranking on Spark, which keeps the best of each task before it shuffles.

Rows with a null label, a null vector or a component that is null or not finite take no part. Components beyond 64 bits
become the nearest 64-bit integer; shorter vectors are padded with zeros. Equal rows are rows of their own: each is a
candidate, each of an anchor's repetitions an anchor, and an anchor is its copies' positive. A row without id is never an
anchor and comes last among equals. Other columns are not read. Work grows with anchors times rows, as the search asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.llm.common import quoted, stored, table

#: Numbers of the vectors of one side of a cell, at most; rows of a side, at least, before there are more cells.
CELL, LEAST_ROWS = 1 << 20, 1024
#: Rows and columns of a product of tiles.
TILE = (512, 4096)
#: Recursion ends at inner sizes, and at sides, of so many.
LEAF, LEAF_SIDE = 8, 32
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if k <= LEAF or min(m, n) <= LEAF_SIDE:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    c = np.empty((m, n), np.int64)
    c11, c12, c21, c22 = c[:h, :j], c[:h, j:], c[h:, :j], c[h:, j:]
    p = strassen(a11 + a22, b11 + b22)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return c


class Heaps:
    """For each anchor the best ``k`` scores and where their rows stand, best first; of equal scores the first pushed."""

    def __init__(self, anchors: int, k: int):
        self.scores, self.at = np.full((anchors, k), NONE), np.zeros((anchors, k), np.int64)

    def push(self, anchors: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
        """Some anchors' scores (NONE: not allowed) of rows, which stand behind those of earlier calls. Changes ``scores``."""
        k, each = self.scores.shape[1], np.arange(len(anchors))
        best, where = np.empty((len(anchors), k), np.int64), np.empty((len(anchors), k), np.int64)
        for j in range(k):
            hit = scores.argmax(axis=1)
            best[:, j], where[:, j] = scores[each, hit], at[hit]
            scores[each, hit] = NONE
        both = np.concatenate([self.scores[anchors], best], axis=1)
        order = np.argsort(~both, axis=1, kind="stable")[:, :k]  # ~ turns the order round without overflow
        self.scores[anchors] = np.take_along_axis(both, order, axis=1)
        self.at[anchors] = np.take_along_axis(np.concatenate([self.at[anchors], where], axis=1), order, axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor, place of the row, score of all that are held."""
        anchor, j = np.nonzero(self.scores > NONE)
        return anchor, self.at[anchor, j], self.scores[anchor, j]


def matrix(rows: pa.Table) -> np.ndarray:
    """The vectors as rows of a matrix, the shorter ones padded with zeros."""
    lists = rows.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with as many columns."""
    k = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, k - x.shape[1]))) for x in (a, b))


def in_order(candidates: pa.Table) -> pa.Table:
    """By id; those without one last."""
    return candidates.take(pc.sort_indices(candidates, sort_keys=[("id", "ascending")], null_placement="at_end"))


def tiles(n: int, size: int):
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def best_of_label(anchors: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Of one cell: each anchor's best rows of its own label, but for itself."""
    candidates = in_order(candidates)
    a, c = widened(matrix(anchors), matrix(candidates))
    label_a, label_c, own = (t.column(x).to_numpy() for t, x in ((anchors, "label"), (candidates, "label"), (candidates, "row")))
    row_a, heaps = anchors.column("row").to_numpy(), Heaps(len(a), k)
    for label in np.intersect1d(label_a, label_c):
        some, at = np.flatnonzero(label_a == label), np.flatnonzero(label_c == label)
        for y in tiles(len(at), TILE[1]):
            turned = np.ascontiguousarray(c[at[y]].T)
            for x in tiles(len(some), TILE[0]):
                scores = strassen(a[some[x]], turned)
                scores[row_a[some[x]][:, None] == own[at[y]]] = NONE
                heaps.push(some[x], scores, at[y])
    anchor, where, score = heaps.found()
    return pa.table({"row": pa.array(row_a[anchor]), "id": candidates.column("id").take(pa.array(where)), "score": pa.array(score)})


def best_in_windows(anchors: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Of one cell: for each anchor and window (lists ``low`` and ``high``) the best rows of other labels."""
    candidates = in_order(candidates)
    a, c = widened(matrix(anchors), matrix(candidates))
    label_a, label_c, row_a = (t.column(x).to_numpy() for t, x in ((anchors, "label"), (candidates, "label"), (anchors, "row")))
    low, high = (anchors.column(x).to_pylist() for x in ("low", "high"))
    slots = max(map(len, low), default=0)
    low = np.array([[*x, *[1] * (slots - len(x))] for x in low], np.int64)  # a window that holds nothing
    high = np.array([[*x, *[0] * (slots - len(x))] for x in high], np.int64)
    heaps = [Heaps(len(a), k) for _ in range(slots)]
    for y in tiles(len(c), TILE[1]):
        turned, at = np.ascontiguousarray(c[y].T), np.arange(y.start, y.stop)
        for x in tiles(len(a), TILE[0]):
            scores = strassen(a[x], turned)
            other = label_a[x][:, None] != label_c[y]
            for slot in range(slots):
                allowed = other & (scores >= low[x, slot, None]) & (scores <= high[x, slot, None])
                some = np.flatnonzero(allowed.any(axis=1))
                if len(some):
                    heaps[slot].push(x.start + some, np.where(allowed[some], scores[some], NONE), at)
    parts = []
    for slot in range(slots):
        anchor, where, score = heaps[slot].found()
        parts.append(pa.table({"row": pa.array(row_a[anchor]), "slot": pa.array(np.full(len(anchor), slot, np.int32)), "id": candidates.column("id").take(pa.array(where)), "score": pa.array(score)}))
    return pa.concat_tables(parts) if parts else pa.table({"row": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def integers(rows: DataFrame, id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """row (a number of its own), id, label, v (array<bigint>) of the rows that take part."""
    x = quoted(vector)
    sound = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    whole = F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double")).cast("bigint"))
    chosen = rows.select(quoted(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(sound, whole).alias("v"))
    return chosen.where("label IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id())


def mine(rows: DataFrame, anchors: Column, label: Column, id: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells from the column ``id`` which rows are. A negative's score, in hundredths of the positive's, lies in
    the window, ends included.
    """
    spark = rows.sparkSession
    whole = stored(integers(rows, id, vector, label, scale), "vectors")
    n, width, queries = whole.agg(F.count("*"), F.max(F.size("v")), F.count_if(anchors)).first()
    side = max(min(CELL // max(width or 1, 1), max(LEAST_ROWS, n // (2 * spark.sparkContext.defaultParallelism))), 1)
    across, down = -(-max(n, 1) // side), -(-max(queries, 1) // side)
    place = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    again = whole.select(*(F.col(c).alias(c) for c in whole.columns))  # names of its own, or the two sides of a cell could not be told apart
    candidates = again.withColumns({"across": place(across), "down": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}).groupBy("down", "across")

    def dealt(some: DataFrame):
        return some.withColumns({"down": place(down), "across": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))}).groupBy("down", "across").cogroup(candidates)

    asked = whole.where(anchors)
    own = dealt(asked).applyInArrow(lambda a, c: best_of_label(a, c, positives), "row bigint, id bigint, score bigint")
    ranked = own.withColumn("slot", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))) - 1).where(F.col("slot") < positives)
    ranked = stored(ranked, "positives")
    hundredths = lambda share, up: F.expr(f"(score div 100) * {share} + {'ceil' if up else 'floor'}((score % 100) * {share} / 100.0D)").cast("bigint")
    windows = ranked.select("row", "slot", hundredths(window[0], True).alias("low"), hundredths(window[1], False).alias("high"))
    windows = windows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w")).select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    other = dealt(asked.join(windows, "row")).applyInArrow(lambda a, c: best_in_windows(a, c, negatives), "row bigint, slot int, id bigint, score bigint")
    last = other.withColumn("rank", F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= negatives)
    last = last.select("row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = ranked.select("row", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = last.join(named, ["row", "slot"]).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows of which the id is divisible by 50; of those divisible by 7 the label is one further."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.n, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.n <> c.n WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS slot FROM s WHERE same QUALIFY slot <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.n, p.slot ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.n = p.n AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
