"""Usability labels to artifact-rejected sleep scores, by majority over channels and over epochs.

usability: night_id, epoch_idx, channel, label. stages: night_id, epoch_idx, stage. Epochs are numbered without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions.config import GOOD, M_SHAPED, PLACEHOLDER, Config


def ignore_m_shaped(usability: DataFrame) -> DataFrame:
    """M-shaped noise counts as good."""
    return usability.withColumn("label", F.when(F.col("label") == M_SHAPED, GOOD).otherwise(F.col("label")))


def unusable_flags(usability: DataFrame) -> DataFrame:
    """unusable: 1 for any label but good, else 0."""
    return usability.withColumn("unusable", (F.col("label") != GOOD).cast("int"))


def channel_majority(usability: DataFrame) -> DataFrame:
    """night_id, epoch_idx, unusable: whether more than half of the channels are unusable (of two: both)."""
    flags = unusable_flags(usability)
    return flags.groupBy("night_id", "epoch_idx").agg((2 * F.sum("unusable") > F.count("unusable")).alias("unusable"))


def epoch_majority(usability: DataFrame, config: Config = Config()) -> DataFrame:
    """night_id, epoch_idx (of sleep), unusable: majority of the channel majorities; a partial last epoch is dropped.

    One shuffle, by night and sleep epoch, serves both majorities.
    """
    k = config.per_sleep
    grouped = unusable_flags(usability).withColumn("sleep_epoch", F.floor(F.col("epoch_idx") / k).cast("int"))
    grouped = grouped.repartition("night_id", "sleep_epoch")
    channels = grouped.groupBy("night_id", "sleep_epoch", "epoch_idx").agg((2 * F.sum("unusable") > F.count("unusable")).cast("int").alias("bad"))
    epochs = channels.groupBy("night_id", "sleep_epoch").agg((2 * F.sum("bad") > F.count("bad")).alias("unusable"), F.count("bad").alias("n"))
    return epochs.where(F.col("n") == k).select("night_id", F.col("sleep_epoch").alias("epoch_idx"), "unusable")


def length_mismatch(usability: DataFrame, stages: DataFrame, config: Config = Config()) -> DataFrame:
    """night_id, n_usability, n_stages of nights whose stages do not fit their whole sleep epochs (error 7)."""
    epochs = usability.groupBy("night_id").agg((F.max("epoch_idx") + 1).cast("long").alias("n_usability"))
    scores = stages.groupBy("night_id").agg(F.count("*").alias("n_stages"))
    return epochs.join(scores, "night_id").where(F.floor(F.col("n_usability") / config.per_sleep) != F.col("n_stages"))


def overlay(usability: DataFrame, stages: DataFrame, config: Config = Config()) -> DataFrame:
    """night_id, epoch_idx, stage: the unusable label where the majority is unusable, else the stage.

    Nights whose lengths do not fit are left out; length_mismatch() names them.
    """
    bad = epoch_majority(usability, config)
    wrong = length_mismatch(usability, stages, config).select("night_id")
    joined = stages.join(bad, ["night_id", "epoch_idx"]).join(wrong, "night_id", "left_anti")
    return joined.select("night_id", "epoch_idx", F.when(F.col("unusable"), config.unusable).otherwise(F.col("stage")).cast("int").alias("stage"))


def usable_percent(usability: DataFrame) -> DataFrame:
    """night_id, usable_percent over all epochs and channels, and its band: low (under 50), fair (under 80), good."""
    share = usability.groupBy("night_id").agg((F.avg((F.col("label") == GOOD).cast("int")) * 100).alias("usable_percent"))
    band = F.when(F.col("usable_percent") < 50, "low").when(F.col("usable_percent") < 80, "fair").otherwise("good")
    return share.withColumn("band", band)


def pseudo_scores(usability: DataFrame, config: Config = Config()) -> DataFrame:
    """Placeholder stages for nights without scores: one for each whole sleep epoch."""
    whole = usability.groupBy("night_id").agg(F.floor((F.max("epoch_idx") + 1) / config.per_sleep).cast("int").alias("n")).where("n > 0")
    return whole.select("night_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch_idx"), F.lit(PLACEHOLDER).alias("stage"))


def recovery(before: DataFrame, after: DataFrame, spiky: int = 3) -> DataFrame:
    """Per night: spiky epochs before filtering, those that became usable, and their percent (null without spiky ones)."""
    keys = ["night_id", "channel", "epoch_idx"]
    joined = before.where(F.col("label") == spiky).join(after.withColumnRenamed("label", "now"), keys, "left")
    counted = joined.groupBy("night_id").agg(F.count("*").alias("n_spiky"), F.count_if(F.col("now") == GOOD).alias("n_recovered"))
    every = before.select("night_id").distinct().join(counted, "night_id", "left").na.fill(0, ["n_spiky", "n_recovered"])
    return every.withColumn("recovered_percent", F.round(F.col("n_recovered") / F.nullif(F.col("n_spiky"), F.lit(0)) * 100, 2))
