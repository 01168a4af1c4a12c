"""Sources mixed to target weights by Pfair scheduling of blocks of documents.

A source with the share a / M of the time (a of every M blocks) must place its block c in the window from
floor(c * M / a) to ceil((c + 1) * M / a): at any time it then is less than one block from its share. Of the blocks
whose window has begun, the one with the earliest deadline comes next, which meets all windows since the shares add up
to one. Windows repeat after M blocks, so one period is scheduled, by a fold over M slots in SQL, and the slot of
any block follows by arithmetic, without a pass over other blocks. Sources of equal shares have equal windows: they take
turns in one class, and the fold looks at classes only (under 50 of them at shares of a thousandth, however many sources).

Within a source, documents are in the order of a hash. Their places are counted in chunks of that order, and
prefix sums of the chunks' sizes give each chunk its base: a source of any size is spread over many tasks, and so is a key
that comes very often, since its rows then have hashes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.llm.common import HOT_SHARE, cut, look_up, table

#: Documents of a block; shares are multiples of about 1 / RESOLUTION; documents of a chunk, about.
BLOCK, RESOLUTION, CHUNK_ROWS = 16, 1000, 2000
#: Rows of a schedule up to which it is broadcast; slots folded at once.
MOST_SENT, SLOTS = 200_000, 500


def shares(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Adds ``a``: the whole number of blocks of each source in a period, at least one.

    Without weights, the target of a source is in proportion to the square root of its number of documents. A source
    that the weights do not name gets the smallest share.
    """
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(0.0)) if weights else F.lit(1.0)
    share = F.coalesce(weight / F.nullif(F.sum(weight).over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0))
    return counts.withColumn("a", F.greatest(F.lit(1), F.round(share * RESOLUTION)).cast("long"))


def classes(shared: DataFrame) -> DataFrame:
    """Adds k and r: how many sources have the same share, and the place of each among them."""
    same = Window.partitionBy("a")
    return shared.withColumn("k", F.count("*").over(same)).withColumn("r", F.row_number().over(same.orderBy("source")) - 1)


def period(sources: DataFrame) -> DataFrame:
    """a, period (M), n, t: the slot t of block n of the sources of share a in one period; M rows.

    Block j of the source at place r of k is block j * k + r of its class.
    """
    every = sources.groupBy("a").agg(F.count("*").alias("k")).agg(F.array_sort(F.collect_list(F.struct("a", "k"))).alias("s"), F.sum(F.col("a") * F.col("k")).alias("m"))
    every = every.where("m > 0").select("s", "m", F.col("s.a").alias("shares"), F.col("s.k").alias("sizes"))
    m, a, k = F.col("m"), F.col("shares"), F.col("sizes")
    none = F.expr("CAST(array() AS array<int>)")

    def only(value: Column, use) -> Column:
        """use(value), where value is worked out once."""
        return F.transform(F.array(value), use)[0]

    def step(state: Column, t: Column) -> Column:
        turn = lambda c, i: F.floor(c / k[i])
        due = F.transform(state["c"], lambda c, i: F.when(turn(c, i) * m < (t + 1) * a[i], F.struct(F.floor(((turn(c, i) + 1) * m + a[i] - 1) / a[i]).alias("d"), i.alias("i"))))
        given = lambda x: F.transform(state["c"], lambda c, i: c + F.when(i == x, 1).otherwise(0))
        return only(F.array_min(due)["i"], lambda x: F.struct(given(x).alias("c"), F.concat(state["out"], F.array(x)).alias("out")))

    def part(state: Column, begin: Column) -> Column:
        slots = F.sequence(begin, F.least(begin + SLOTS - 1, m - 1))
        folded = F.aggregate(slots, F.struct(state["c"].alias("c"), none.alias("out")), step)
        return only(folded, lambda x: F.struct(x["c"].alias("c"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.transform("shares", lambda a: F.lit(0).cast("long")).alias("c"), F.expr("CAST(array() AS array<array<int>>)").alias("out"))
    run = every.select("s", "m", F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), m - 1, F.lit(SLOTS).cast("long")), start, part)["out"]).alias("out"))
    slots = run.select("s", "m", F.posexplode("out").alias("t", "i"))
    n = F.row_number().over(Window.partitionBy("i").orderBy("t")) - 1
    return slots.select(F.col("s")[F.col("i")]["a"].alias("a"), F.col("m").alias("period"), n.alias("n"), "t")


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f":{seed}")))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """key, source, block (of its source), slot (of the block in the mix) and place (in the block) of each row of docs.

    The mix is the order of (slot, place). All rows are kept: once a source has run out its slots stay empty, and the
    others go on at their rates. A null source is a source of its own. Repeated rows are placed one after another, but
    for keys of over a thousandth of all rows, which are spread.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), order_key(key, seed).alias("h"))
    rows = cut(rows.withColumn("g", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))))
    total = rows.count()
    often = rows.groupBy("h").count().where(F.col("count") > max(total // HOT_SHARE, CHUNK_ROWS)).select("h")  # under HOT_SHARE of them
    if not (often := cut(often)).isEmpty():
        own = F.md5(F.concat("h", F.lit(":"), F.monotonically_increasing_id().cast("string")))
        rows = cut(rows.join(F.broadcast(often.withColumn("often", F.lit(True))), "h", "left").withColumn("h", F.when(F.col("often"), own).otherwise(F.col("h"))).drop("often"))
    counts = rows.groupBy("g", "source").agg(F.count("*").alias("n"))
    sources = cut(classes(shares(counts, weights).withColumn("source", F.col("g"))).drop("source"))
    schedule = cut(period(sources))  # RESOLUTION rows and at most one for each source
    length = schedule.count()
    known = look_up(rows, sources.withColumn("period", F.lit(length)), "g", "n", total)
    lead = F.conv(F.substring("h", 1, 7), 16, 10).cast("long")
    known = known.withColumn("chunk", F.floor(lead * F.ceil(F.col("n") / CHUNK_ROWS) / F.lit(1 << 28)))
    before = Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.groupBy("g", "chunk").count().select("g", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("g", "chunk").orderBy("h", "id"))
    placed = known.withColumn("at", at).join(bases, ["g", "chunk"]).withColumn("at", F.col("base") + F.col("at") - 1)
    blocked = placed.withColumn("block", F.floor(F.col("at") / block))
    sent = schedule.select(F.col("a").alias("share"), F.col("n").alias("turn"), "t")
    turn = (F.col("block") % F.col("a")) * F.col("k") + F.col("r")
    blocked = blocked.join(F.broadcast(sent) if length <= MOST_SENT else sent, (F.col("a") == F.col("share")) & (turn == F.col("turn")))
    slot = F.floor(F.col("block") / F.col("a")) * F.col("period") + F.col("t")
    return blocked.select(F.col("id").alias(key), F.col("source").alias(source), "block", slot.alias("slot"), (F.col("at") % block).alias("place"))


def arranged(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs in the order of the mix: partitions follow one another, and rows within them.

    Rows of one key go together, to the first of their places.
    """
    places = mix(docs, key, source, weights).groupBy(F.col(key).alias("__id")).agg(F.min(F.struct("slot", "place")).alias("__at"))
    places = cut(places)
    last = places.agg(F.max("__at.slot")).first()[0] or 0
    parts = (docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    placed = docs.join(places, F.col(f"`{key}`").eqNullSafe(F.col("__id"))).withColumn("__part", F.floor(F.col("__at.slot") * parts / (last + 1)).cast("int"))
    return placed.repartitionById(parts, "__part").sortWithinPartitions("__at").select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of all sources."""
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), doc_id) - 1 AS pos
  FROM documents
), n AS (SELECT g, count(*) AS n FROM d GROUP BY g
), w AS (SELECT g, greatest(1, CAST(round(sqrt(CAST(n AS DOUBLE)) / (SELECT sum(sqrt(CAST(n AS DOUBLE))) FROM n) * {RESOLUTION}) AS BIGINT)) AS a FROM n
), v AS (SELECT g, a, count(*) OVER (PARTITION BY a) AS k, row_number() OVER (PARTITION BY a ORDER BY g) - 1 AS r FROM w
), m AS (SELECT CAST(sum(a * k) AS BIGINT) AS m, list(a ORDER BY a) AS s, list(k ORDER BY a) AS ks FROM (SELECT a, count(*) AS k FROM w GROUP BY a)
), p AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS i, list_transform(s, lambda a: CAST(0 AS BIGINT)) AS c, m, s, ks FROM m
  UNION ALL
  SELECT t + 1, x.i, list_transform(c, lambda v, k: CASE WHEN k = x.i THEN v + 1 ELSE v END), m, s, ks
  FROM p, LATERAL (SELECT list_aggregate(list_transform(range(1, len(s) + 1), lambda k: CASE WHEN c[k] // ks[k] * m < (t + 2) * s[k]
                   THEN ((c[k] // ks[k] + 1) * m + s[k] - 1) // s[k] * 1000000 + k END), 'min') % 1000000 AS i) x
  WHERE t + 1 < m
), f AS (SELECT s[i] AS a, t, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS n FROM p WHERE i IS NOT NULL
), b AS (SELECT d.*, pos // {BLOCK} AS block, a, k, r FROM d JOIN v USING (g))
SELECT doc_id, source, block, block // b.a * (SELECT m FROM m) + t AS slot, pos % {BLOCK} AS place
FROM b JOIN f ON f.a = b.a AND f.n = block % b.a * k + r
"""
