"""Stand-ins for recordings, derived from the driver's tables. They exercise the operators; they are not sleep data.

usability, stages, mobility and samples come from ``events`` (night = user), tri-axial samples from ``lineitem`` (night
= supplier), vectors from ``embeddings``. Each has a SQL text of the same rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of an epoch of the stand-in samples at one sample a second.
EPOCH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """night_id, rn (from 0, by time), event_type, value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return events.select(F.col("user_id").cast("string").alias("night_id"), (F.row_number().over(order) - 1).alias("rn"), "event_type", "value")


NUMBERED = "e AS (SELECT CAST(user_id AS VARCHAR) AS night_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS rn, event_type, value FROM events)"


def usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels; an epoch without its second channel is left out."""
    rows = numbered(spark, sf_dir)
    label = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 4).otherwise(0)
    long = rows.select("night_id", F.floor(F.col("rn") / 2).cast("int").alias("epoch_idx"), F.concat(F.lit("C"), (F.col("rn") % 2).cast("string")).alias("channel"), label.alias("label"))
    return long.withColumn("n", F.count("*").over(Window.partitionBy("night_id", "epoch_idx"))).where("n = 2").drop("n")


USABILITY = NUMBERED + """,
u0 AS (SELECT night_id, rn // 2 AS epoch_idx, 'C' || (rn % 2) AS channel,
  CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS label FROM e),
u AS (SELECT * FROM u0 QUALIFY count(*) OVER (PARTITION BY night_id, epoch_idx) = 2)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage for each whole sleep epoch of the usability stand-in, taken from the first of its events."""
    rows = numbered(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("night_id")))
    own = rows.where((F.col("rn") % 6 == 0) & (F.col("rn") + 6 <= F.col("n")))
    return own.select("night_id", F.floor(F.col("rn") / 6).cast("int").alias("epoch_idx"), (F.floor("value") % 5).cast("int").alias("stage"))


STAGES = """
s AS (SELECT night_id, rn // 6 AS epoch_idx, CAST(floor(value) AS INTEGER) % 5 AS stage
  FROM (SELECT *, count(*) OVER (PARTITION BY night_id) AS n FROM e) WHERE rn % 6 = 0 AND rn + 6 <= n)"""


def mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("night_id", F.col("rn").alias("epoch_idx"), F.when(F.col("value") < 60, 1).otherwise(3).alias("label"))


MOBILITY = "\nm AS (SELECT night_id, rn AS epoch_idx, CASE WHEN value < 60 THEN 1 ELSE 3 END AS label FROM e)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel at one sample a second."""
    rows = numbered(spark, sf_dir)
    return rows.select("night_id", F.lit("EEG").alias("channel"), F.col("rn").cast("long").alias("sample_idx"), "value", F.lit(1).alias("fs"))


SAMPLES = "\nx AS (SELECT night_id, 'EEG' AS channel, CAST(rn AS BIGINT) AS sample_idx, value, 1 AS fs FROM e)"


def wide_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three axes at 16 samples a second, within about -2 to 2, as columns."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("night_id"), (F.row_number().over(order) - 1).cast("long").alias("sample_idx"), (F.col("l_quantity") / 25 - 1).alias("dX"), (F.col("l_discount") * 10).alias("dY"), (F.col("l_tax") * 20 - 1).alias("dZ"), F.lit(16).alias("fs"))


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows of the channels dX, dY, dZ."""
    return wide_axes(spark, sf_dir).unpivot(["night_id", "sample_idx", "fs"], ["dX", "dY", "dZ"], "channel", "value")


AXES = """w AS (SELECT CAST(l_suppkey AS VARCHAR) AS night_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS sample_idx,
  l_quantity / 25 - 1 AS dX, l_discount * 10 AS dY, l_tax * 20 - 1 AS dZ FROM lineitem),
a AS (SELECT night_id, sample_idx, channel, value, 16 AS fs FROM (SELECT night_id, sample_idx, unnest(['dX', 'dY', 'dZ']) AS channel, unnest([dX, dY, dZ]) AS value FROM w))"""


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel at 256 samples a second; the lines of 8192 order keys are a night, so nights do not grow with the data."""
    night = F.floor(F.col("l_orderkey") / 8192)
    order = Window.partitionBy(night).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(night.cast("string").alias("night_id"), F.lit("EEG").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("sample_idx"), (F.col("l_quantity") / 1000).alias("value"), F.lit(256).alias("fs"))


RECORDING = """rec AS (SELECT CAST(l_orderkey // 8192 AS VARCHAR) AS night_id, row_number() OVER (PARTITION BY l_orderkey // 8192 ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS sample_idx,
  l_quantity / 1000 AS value FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """night_id, channel, epoch_idx, fs, samples: each embedding as an epoch of 64 points.

    Those of a label among 64 neighbours are a night, so nights do not grow with the data.
    """
    part = F.floor(F.col("vec_id") / 64)
    order = Window.partitionBy("label", part).orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    night = F.concat_ws("-", F.col("label").cast("string"), part.cast("string"))
    return rows.select(night.alias("night_id"), F.lit("EEG").alias("channel"), (F.row_number().over(order) - 1).alias("epoch_idx"), F.lit(64).alias("fs"), F.col("embedding").cast("array<double>").alias("samples"), "vec_id")


VECTORS = """v AS (SELECT CAST(label AS VARCHAR) || '-' || CAST(vec_id // 64 AS VARCHAR) AS night_id, CAST(row_number() OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id) - 1 AS INTEGER) AS epoch_idx,
  CAST(embedding AS DOUBLE[]) AS samples, vec_id FROM embeddings)"""
