"""Which nights there are, where their results go, and which are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def nights(files: DataFrame, first_channel: str | None = None) -> DataFrame:
    """src_path of each folder that holds a recording.

    With first_channel: a file of that name with the ending edf or bdf; without: any file of these endings. Case does
    not matter.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    if first_channel is None:
        hit = name.rlike(r"\.(edf|bdf)$")
    else:
        hit = name.isin(f"{first_channel.lower()}.edf", f"{first_channel.lower()}.bdf")
    return files.where(hit).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("src_path")).distinct()


def with_destination(found: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds dest_path: the source path with the root of the raw data replaced by that of the results."""
    return found.withColumn("dest_path", F.replace("src_path", F.lit(raw), F.lit(out)))


def to_do(found: DataFrame, outputs: DataFrame, step: str, config_hash: str) -> DataFrame:
    """Nights without an output of the step made under the same settings. outputs: night_id, step, config_hash."""
    done = outputs.where((F.col("step") == step) & (F.col("config_hash") == config_hash)).select("night_id")
    return found.join(done, "night_id", "left_anti")


def locate(at_source: DataFrame, at_destination: DataFrame) -> DataFrame:
    """night_id, path of an output: beside the source if it is there, else at the destination."""
    both = at_source.select("night_id", F.col("path").alias("a")).join(at_destination.select("night_id", F.col("path").alias("b")), "night_id", "full")
    return both.select("night_id", F.coalesce("a", "b").alias("path"))
