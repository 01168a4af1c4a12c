"""A uniform shuffle into shards of exact sizes: draw how many rows go from each part to each shard, then permute.

Rows fall into parts by a hash of their columns. The matrix of counts, parts by shards, is drawn on the driver from
the parts' sizes, cell by cell, from hypergeometric distributions: it has the distribution that dealing the places of
all shards out to all rows at random would give, and its sums are the parts' and the shards' sizes exactly. Rows are
permuted within their part and dealt out by that matrix, exchanged, and permuted again within their shard. Only
DataFrame functions touch rows; the matrix has MOST_PARTS x shards cells at most, whatever the input.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.llm.common import HOT_SHARE, cut, table

#: Rows of a part, and of a bucket of a shard, about; parts, at most: beyond it they grow.
PART_ROWS, MOST_PARTS = 20_000, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement, are good. Inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    down = up = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left, a, b = rng.random() - up, mode, mode
    while left > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            if (left := left - up) <= 0:
                return b
        if a > low:
            down *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            if (left := left - down) <= 0:
                return a
        if up + down < 1e-300:
            break
    return mode


def draw_matrix(sizes: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """Rows from each part to each shard; its row sums are ``sizes``, its column sums ``capacities``."""
    rng, left, matrix = random.Random(seed), list(capacities), []
    for size in sizes:
        total, row = sum(left), []
        for room in left:
            take = hypergeometric(rng, room, total - room, size)
            row.append(take)
            total, size = total - room, size - take
        left = [room - take for room, take in zip(left, row)]
        matrix.append(row)
    return matrix


def shard(rows: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1, sizes at most one apart) and ``slot`` (gapless from 0 in each shard).

    The result depends on the rows and the seed, not on how they were read. Wholly equal rows may take each other's
    places; nulls, texts of any length and any number of columns are fine. Columns named shard or slot are replaced. An
    empty table gives none.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    own = list(names.values())
    base = cut(rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    total = base.count()
    base, copy = numbered_copies(base, own, total)
    parts = min(max(1, -(-total // PART_ROWS)), MOST_PARTS)

    def key(salt: int):
        return F.xxhash64(F.lit(seed * 4 + salt), *own, *copy)

    placed = base.withColumn("part", F.pmod(key(0), F.lit(parts)).cast("int"))
    sizes = dict(placed.groupBy("part").count().collect())
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = draw_matrix([sizes.get(p, 0) for p in range(parts)], capacities, seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    drawn = base.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("part", "ends"))
    local = placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(key(1), *own)))
    dealt = local.join(F.broadcast(drawn), "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("k"))))
    buckets = max(1, -(-total // (shards * PART_ROWS)))
    dealt = cut(dealt.withColumn("bucket", F.pmod(key(2), F.lit(buckets)).cast("int")).select(*own, *copy, "shard", "bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(key(3), *own))
    found = dealt.withColumn("place", place).join(bases, ["shard", "bucket"])
    return found.select(*(F.col(n).alias(c) for c, n in names.items()), "shard", (F.col("base") + F.col("place") - 1).alias("slot"))


def numbered_copies(base: DataFrame, own: list[str], total: int) -> tuple[DataFrame, list[str]]:
    """Adds ``copy`` where rows have very many equal to them: the number of the row among these, for all others 0.

    So equal rows do not share one part. Rows with over a HOT_SHARE-th of all equal to them are of HOT_SHARE kinds at most.
    A copy's number is that within its partition and the copies in partitions before it, so no task gets all of a kind.
    """
    same = F.xxhash64(*own)
    counts = base.groupBy(same.alias("same")).count()
    hot = cut(counts.where(F.col("count") > max(PART_ROWS, total // HOT_SHARE)).select("same"))
    if hot.isEmpty():
        return base, []
    kept = cut(base.withColumns({"same": same, "pid": F.spark_partition_id()}).join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "same", "left"))
    some = kept.where("is_hot")
    here = Window.partitionBy("same", "pid")
    before = Window.partitionBy("same").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = some.groupBy("same", "pid").count().select("same", "pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    each = some.withColumn("n", F.row_number().over(here.orderBy("same"))).join(F.broadcast(bases), ["same", "pid"]).select(*own, (F.col("base") + F.col("n")).alias("copy"))
    return cut(kept.where("is_hot IS NULL").select(*own, F.lit(0).cast("bigint").alias("copy")).unionByName(each)), ["copy"]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards by the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    law, none = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return shard(rows).select("doc_id", "size", "text_crc32", law, "shard", "slot", none)
