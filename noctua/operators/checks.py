"""Checks of recordings and scores. Each gives the rows at fault with the code of the fault, or the rows that pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.config import ERRORS, NOT_FATAL, REM, REM_ALTERNATIVE, Config


def durations(samples: DataFrame) -> DataFrame:
    """night_id, seconds, code: the duration of each night by its first channel; under a minute is error 2."""
    each = samples.groupBy("night_id", "channel").agg((F.count("*") / F.first("fs")).alias("seconds"))
    night = each.groupBy("night_id").agg(F.min_by("seconds", "channel").alias("seconds"))
    return night.withColumn("code", F.when(F.col("seconds") < 60, 2).cast("int"))


def acceleration_in_range(samples: DataFrame, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """night_id, low, high, code: error 12 if any sample lies outside the range."""
    night = samples.groupBy("night_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return night.withColumn("code", F.when((F.col("low") < low) | (F.col("high") > high), 12).cast("int"))


def passing(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """The rows of nights without a code."""
    return rows.join(checked.where("code IS NULL").select("night_id"), "night_id", "left_semi")


def stage_faults(stages: DataFrame, facts: DataFrame, config: Config = Config()) -> DataFrame:
    """night_id, code: the first fault of a night's stages, in the order unreadable (4), duration (5), usability (7), range (6).

    facts: night_id, seconds, n_usability (null where unknown). stage is null where it could not be read.
    """
    night = stages.groupBy("night_id").agg(F.count("*").alias("n"), F.count_if(F.col("stage").isNull()).alias("unreadable"), F.min("stage").alias("low"), F.max("stage").alias("high"))
    joined = night.join(facts, "night_id")
    code = (
        F.when(F.col("unreadable") > 0, 4)
        .when(F.floor(F.col("seconds") / config.sleep_len) != F.col("n"), 5)
        .when(F.floor(F.col("n_usability") / config.per_sleep) != F.col("n"), 7)
        .when((F.col("low") < 0) | (F.col("high") > REM_ALTERNATIVE), 6)
    )
    return joined.select("night_id", code.cast("int").alias("code"))


def unify_rem(stages: DataFrame, only_if_both: bool = False) -> DataFrame:
    """Stage 5 becomes 4, the one REM that statistics count; with only_if_both, only in nights that have both."""
    five = F.col("stage") == REM_ALTERNATIVE
    if only_if_both:
        night = Window.partitionBy("night_id")
        five = five & (F.max((F.col("stage") == REM).cast("int")).over(night) == 1)
    return stages.withColumn("stage", F.when(five, REM).otherwise(F.col("stage")))


def spiky_epochs(usability: DataFrame, label: int = 3) -> DataFrame:
    """night_id, channel, n_spiky, epochs: the epochs of that label of each channel."""
    found = usability.where(F.col("label") == label).groupBy("night_id", "channel")
    return found.agg(F.count("*").alias("n_spiky"), F.sort_array(F.collect_list("epoch_idx")).alias("epochs"))


def wrong_width(features: DataFrame, expected: int, column: str = "features") -> DataFrame:
    """Rows whose vector does not have the model's width."""
    return features.withColumn("width", F.size(column)).where(F.col("width") != expected)


def missing_channels(present: DataFrame, required: list[str]) -> DataFrame:
    """night_id, missing: required channels that a night lacks (error 13)."""
    night = present.groupBy("night_id").agg(F.collect_set("channel").alias("has"))
    absent = F.sort_array(F.array_except(F.array(*map(F.lit, required)), F.col("has")))
    return night.select("night_id", absent.alias("missing")).where(F.size("missing") > 0)


def error_report(faults: list[DataFrame]) -> DataFrame:
    """night_id, code, reason, fatal of all faults, once each."""
    every = reduce(DataFrame.unionByName, (f.where("code IS NOT NULL").select("night_id", F.col("code").cast("int").alias("code")) for f in faults)).distinct()
    reasons = F.create_map(*(F.lit(x) for k, v in ERRORS.items() for x in (k, v)))
    return every.select("night_id", "code", reasons[F.col("code")].alias("reason"), (~F.col("code").isin(*NOT_FATAL)).alias("fatal"))


def success_count(nights: DataFrame, report: DataFrame) -> DataFrame:
    """n_nights, n_failed, n_passed: nights with several faults count once, and only fatal ones fail a night."""
    failed = report.where("fatal").select("night_id").distinct().withColumn("failed", F.lit(1))
    joined = nights.select("night_id").distinct().join(failed, "night_id", "left")
    return joined.agg(F.count("*").alias("n_nights"), F.count("failed").alias("n_failed")).withColumn("n_passed", F.col("n_nights") - F.col("n_failed"))
