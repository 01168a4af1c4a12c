"""Lights-out and lights-on moments from mobility labels, and scores cropped to the time in bed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.config import LAYING, Config


def laying_runs(mobility: DataFrame, least_run: int) -> DataFrame:
    """night_id, start, stop (inclusive), n of each run of lying still that is long enough.

    Gaps and islands: within the laying epochs of a night, epoch minus rank is constant over a run. Only laying
    epochs are sorted; a night has a few thousand.
    """
    laying = mobility.where(F.col("label") == LAYING)
    rank = F.row_number().over(Window.partitionBy("night_id").orderBy("epoch_idx"))
    runs = laying.withColumn("run", F.col("epoch_idx") - rank).groupBy("night_id", "run")
    return runs.agg(F.min("epoch_idx").alias("start"), F.max("epoch_idx").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least_run).drop("run")


def lights(mobility: DataFrame, config: Config = Config(), least_run: int | None = None) -> DataFrame:
    """One row per night with a bedtime: from the start of the first long run to one past the end of the last.

    Seconds count from the start of the recording, data indices are at the configured rate. A night without a long
    run, or with one of a single epoch, has none (error 9).
    """
    runs = laying_runs(mobility, least_run or config.least_run)
    found = runs.groupBy("night_id").agg(F.min("start").alias("out"), F.max("stop").alias("last")).where("out <> last")
    out, on, length = F.col("out"), F.col("last") + 1, config.mobility_len
    return found.select(
        "night_id",
        out.alias("lights_out_epoch"),
        on.alias("lights_on_epoch"),
        (out * length).alias("lights_out_second"),
        (on * length).alias("lights_on_second"),
        (out.cast("long") * length * config.rate).alias("lights_out_data_index"),
        (on.cast("long") * length * config.rate).alias("lights_on_data_index"),
    )


def without_lights(mobility: DataFrame, found: DataFrame) -> DataFrame:
    """Nights of mobility labels for which no bedtime was found."""
    return mobility.select("night_id").distinct().join(found, "night_id", "left_anti")


def crop_bounds(found: DataFrame, epoch_len: int, config: Config = Config()) -> DataFrame:
    """night_id, start and stop (exclusive) in epochs of epoch_len seconds: all that overlap the time in bed."""
    if epoch_len % config.mobility_len:
        raise ValueError("an epoch must be a whole number of mobility epochs")
    k = epoch_len // config.mobility_len
    start = F.floor(F.col("lights_out_epoch") / k).cast("int")
    stop = (F.floor((F.col("lights_on_epoch") - 1) / k) + 1).cast("int")
    return found.select("night_id", start.alias("start"), stop.alias("stop"))


def crop(scores: DataFrame, found: DataFrame, epoch_len: int, config: Config = Config()) -> DataFrame:
    """The scores within the time in bed; nights without one are left out. An equi-join: the range is a filter on it."""
    bounds = crop_bounds(found, epoch_len, config)
    return scores.join(bounds, "night_id").where("epoch_idx >= start AND epoch_idx < stop").drop("start", "stop")
