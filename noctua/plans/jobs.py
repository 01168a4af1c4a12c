"""Whole jobs over all nights. Each recording is decoded once: its blocks are written to a work folder with their counts and
bounds beside them, and all else reads tables from there. A night's failure leaves only its own rows out.

A job's results can be written by night (write_results()): a ledger then names the steps of each night that are done, so a
job that was stopped goes on with the nights that are left, and repeating it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from noctua.functions import features, filters, spectral
from noctua.functions.config import Config
from noctua.operators import bedtime, checks, epochs, majority, signals, sinks, sleepstats
from noctua.operators.epochs import KEY
from noctua.sources import edf, nights, recordings

Model = Callable[[np.ndarray], np.ndarray]
#: Acceleration outside this range fails a night.
LOWEST, HIGHEST = -2.0, 2.0


@dataclass(frozen=True)
class Setup:
    """What a job is told: channels, models (matrix of features to probabilities), settings.

    axes: none where there is no accelerometer; a constant one then stands for it, and there is no mobility. per_channel:
    each channel is a file of its name. lite: spectrograms only; lite_mobility: powers of the axes instead of statistics.
    saved: a folder where statistical features are kept between runs; those that fit a night's signal are used again.
    """

    channels: list[str]
    usability: Model
    mobility: Model
    axes: tuple[str, ...] = epochs.AXES
    config: Config = Config()
    least_run: int | None = None
    lite: bool = False
    lite_mobility: bool = True
    per_channel: bool = False
    ignore_m_shaped: bool = True
    saved: str | None = None


@dataclass(frozen=True)
class Signals:
    epochs: DataFrame  # night_id, channel, epoch_idx, fs, samples: whole epochs at the configured rate
    facts: DataFrame  # night_id, seconds: of nights without a fault
    faults: DataFrame  # night_id, code
    #: the same, all channels of an epoch in a row: night_id, epoch_idx, channel and samples (lists), whole and whole_axes (epochs of a night)
    together: DataFrame | None = None


@dataclass(frozen=True)
class Results:
    faults: DataFrame  # night_id, code
    usability: DataFrame  # with probs
    mobility: DataFrame  # with probs
    rejected: DataFrame
    lights: DataFrame
    statistics: DataFrame
    facts: DataFrame


STEPS = ("usability", "rejected", "mobility", "lights", "rejected_tib", "usability_tib", "statistics")


def table(rows: DataFrame, path: str, **options) -> DataFrame:
    """The rows, written once and read from there."""
    with sinks.shuffles_removed(rows.sparkSession):
        rows.write.mode("overwrite").options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: How tables of samples are written: readers hold a group of rows at once, and a row is all channels of an epoch.
SAMPLES = {"compression": "zstd", "parquet.block.row.count.limit": 256}


def nights_to_do(files: DataFrame, outputs: DataFrame, step: str, config: Config) -> DataFrame:
    """Files (path) of the nights that have no output of the step under these settings yet."""
    night = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = nights.nights(files.select("path")).select(F.col("src_path").alias("night_id"))
    left = nights.to_do(found, outputs, step, sinks.config_hash(config))
    return files.withColumn("night_id", night).join(left, "night_id", "left_semi").drop("night_id")


def signal_epochs(files: DataFrame, setup: Setup, work: str) -> Signals:
    """Epochs of the channels and axes of each night at the configured rate, and the faults of nights left out.

    files: path, length. Headers are read first; nights with a fault there are not decoded. Blocks at another rate exchange
    their edges with their neighbours and are resampled. Channels and axes are each cut to the whole epochs of the
    shortest of their own. All channels of an epoch are one row from the decoding on.
    """
    config, rate, seconds = setup.config, setup.config.rate, setup.config.usability_len
    if seconds != edf.BLOCK_SECONDS:
        raise ValueError(f"epochs are blocks of {edf.BLOCK_SECONDS} seconds")
    wanted = [*setup.channels, *setup.axes]
    found = table(recordings.catalog(files), f"{work}/catalog")
    chosen, faults = recordings.per_channel(found, wanted) if setup.per_channel else recordings.combined(found, wanted)
    faults = faults.select(F.col("src_path").alias("night_id"), "code")
    decoded = table(recordings.together(chosen, None if setup.per_channel else wanted), f"{work}/blocks", **SAMPLES).withColumnRenamed("src_path", "night_id")
    same, narrow = decoded, blocks_of(decoded, "fs", "n", "least", "most")
    with sinks.shuffles_removed(files.sparkSession):
        rates = {r.fs for r in narrow.select("fs").distinct().collect()}  # few
    if rates - {rate}:
        same = table(at_rate(decoded, rate, seconds), f"{work}/resampled", **SAMPLES)
    is_axis = F.col("channel").isin(*setup.axes) if setup.axes else F.lit(False)
    lengths = narrow.groupBy("night_id", "channel").agg((F.sum("n") / F.first("fs")).alias("seconds"))
    ours = blocks_of(same, "n", "least", "most").withColumn("axis", is_axis)
    each = ours.groupBy("night_id", "channel", "axis").agg(F.floor(F.sum("n") / (rate * seconds)).cast("int").alias("n"))
    whole = table(each.groupBy("night_id").agg(F.min(F.when(~F.col("axis"), F.col("n"))).alias("whole"), F.min(F.when(F.col("axis"), F.col("n"))).alias("whole_axes")), f"{work}/whole")
    firsts = [setup.channels[0], *setup.axes[:1]]
    first = lengths.where(F.col("channel").isin(*firsts)).groupBy("night_id").agg(F.min("seconds").alias("least"), F.max(F.when(F.col("channel") == firsts[0], F.col("seconds"))).alias("seconds"))
    inside = ours.where("axis").join(F.broadcast(whole), "night_id").where("epoch_idx < whole_axes")
    range_ = inside.groupBy("night_id").agg(F.min("least").alias("low"), F.max("most").alias("high"))
    facts = table(first.join(range_, "night_id", "left").select("night_id", "seconds", F.when(F.col("least") < 60, 2).when((F.col("low") < LOWEST) | (F.col("high") > HIGHEST), 12).cast("int").alias("code")), f"{work}/facts")
    # a row for each night, which is told to go to the tasks: else samples are shuffled to meet it
    limits = F.broadcast(table(whole.join(facts.where("code IS NULL").select("night_id"), "night_id"), f"{work}/limits"))
    beside = same.join(limits, "night_id").where("epoch_idx < greatest(whole, whole_axes)")
    kept = blocks_of(beside, "fs", "n", "samples", more=("whole", "whole_axes")).where(F.when(is_axis, F.col("epoch_idx") < F.col("whole_axes")).otherwise(F.col("epoch_idx") < F.col("whole"))).where(F.col("n") == rate * seconds)
    faults = faults.unionByName(facts.where("code IS NOT NULL").select("night_id", "code"))
    return Signals(kept.select(*KEY, "fs", "samples"), facts.where("code IS NULL").drop("code"), faults, beside.select("night_id", "epoch_idx", "channel", "samples", "whole", "whole_axes"))


def blocks_of(together: DataFrame, *columns: str, more: tuple[str, ...] = ()) -> DataFrame:
    """night_id, channel, epoch_idx and the columns of each block of rows that hold all channels of an epoch. No other list is read."""
    each = F.explode(F.arrays_zip("channel", *columns)).alias("block")
    return together.select("night_id", "epoch_idx", *more, each).select("night_id", "block.channel", "epoch_idx", *more, *(f"block.{c}" for c in columns))


def at_rate(decoded: DataFrame, rate: int, seconds: int) -> DataFrame:
    """Rows of all channels of an epoch, with the blocks at another rate resampled. Those meet the others by a shuffle."""
    columns = ["channel", "fs", "n", "least", "most", "samples"]
    each = blocks_of(decoded, *columns[1:])
    other = signals.resample_blocks(each.where(F.col("fs") != rate), rate, seconds)
    other = other.withColumns({"n": F.size("samples"), "least": F.array_min("samples").cast("float"), "most": F.array_max("samples").cast("float")})
    same = each.where(F.col("fs") == rate).withColumn("samples", F.col("samples").cast("array<double>"))
    rows = same.select("night_id", "epoch_idx", *columns).unionByName(other.select("night_id", "epoch_idx", *columns))
    found = rows.groupBy("night_id", "epoch_idx").agg(F.collect_list(F.struct(*columns)).alias("x"))
    return found.select("night_id", "epoch_idx", *(F.col(f"x.{c}").alias(c) for c in columns))


def predictions(together: DataFrame, setup: Setup, spiky: int | None = None, **options) -> DataFrame:
    """night_id, channel, epoch_idx, probs of each channel's epochs, and of mobility where there is no channel (null).

    All channels of an epoch are at hand, so norm, features, vector and model follow one another on a few rows at once, and
    what leaves a task is probabilities: no feature is shuffled or stored. With spiky there is no mobility; the samples of a
    channel's epochs of that label are filtered (options), and their new probabilities come as rows of probs_after, else null.
    """
    rate, n, axes = float(setup.config.rate), setup.config.rate * setup.config.usability_len, list(setup.axes)
    step = max(signals.CHUNK // n, 1)

    def features_at(x: np.ndarray) -> list[np.ndarray]:
        return [spectral.spectrogram(x, rate)] + ([] if setup.lite else [features.all_features(x, rate)])

    def vectors(own: list[np.ndarray], acceleration: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([x for pair in zip(own, acceleration) for x in pair], axis=1).astype(float)

    def power(x: np.ndarray) -> np.ndarray:
        return spectral.welch(x, rate) if setup.lite_mobility else features.all_features(x, rate)

    def run(batches):
        for batch in batches:
            night, epoch, names, samples, whole, whole_axes = batch.columns
            sizes, blocks = names.value_lengths().to_numpy(), samples.flatten()
            row = np.repeat(np.arange(len(night)), sizes)
            fits = blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == n
            starts, values = blocks.offsets.to_numpy()[:-1], blocks.values.to_numpy(zero_copy_only=False)
            names, at = names.flatten().to_numpy(zero_copy_only=False), {}
            for c in [*setup.channels, *axes]:
                of = np.flatnonzero((names == c) & fits)[::-1]
                at[c] = np.full(len(night), -1, np.int64)
                at[c][row[of]] = starts[of]
            epochs_ = epoch.to_numpy()
            most, most_axes = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (whole, whole_axes))
            moves = reduce(np.logical_and, (at[a] >= 0 for a in axes), epochs_ < most_axes) if axes else np.ones(len(night), bool)
            usable = {c: moves & (at[c] >= 0) & (epochs_ < most) for c in setup.channels}
            matrix = lambda c, rows: values[at[c][rows][:, None] + np.arange(n)].astype(float)

            def acceleration(rows: np.ndarray) -> list[np.ndarray]:
                return features_at(np.sqrt(reduce(np.add, (x * x for x in (matrix(a, rows) for a in axes)))) if axes else np.ones((len(rows), n)))

            def found(rows: np.ndarray, channel: str | None, probs: np.ndarray, after: bool = False) -> pa.RecordBatch:
                ends = pa.array(np.arange(0, probs.size + 1, probs.shape[1]), pa.int32())
                taken = pa.array(rows)
                lists = [pa.ListArray.from_arrays(ends, pa.array(probs.ravel())), pa.nulls(len(rows), pa.list_(pa.float64()))]
                return pa.RecordBatch.from_arrays([night.take(taken), pa.array([channel] * len(rows), pa.string()), epoch.take(taken), *lists[:: -1 if after else 1]], names=["night_id", "channel", "epoch_idx", "probs", "probs_after"])

            marked: dict[str, list[np.ndarray]] = {c: [] for c in setup.channels}
            anyone = np.flatnonzero(reduce(np.logical_or, usable.values(), moves & bool(axes)))
            for rows in (anyone[k : k + step] for k in range(0, len(anyone), step)):
                if axes and spiky is None and moves[rows].any():
                    own = rows[moves[rows]]
                    vector = np.concatenate([power(matrix(a, own)) for a in axes], axis=1).astype(float)
                    yield found(own, None, np.asarray(setup.mobility(vector), float) * 100)
                some = rows[reduce(np.logical_or, (usable[c][rows] for c in setup.channels))]
                beside = acceleration(some) if len(some) else []
                for c in setup.channels if len(some) else ():
                    here = usable[c][some]
                    own = some[here]
                    if not len(own):
                        continue
                    probs = np.asarray(setup.usability(vectors(features_at(matrix(c, own)), [x[here] for x in beside])), float) * 100
                    marked[c].append(own[probs.argmax(axis=1) == spiky])
                    yield found(own, c, probs)
            for c, own in ((c, np.concatenate(x)) for c, x in marked.items() if spiky is not None and x):
                for rows in (own[k : k + step] for k in range(0, len(own), step)):
                    again = features_at(filters.remove_spikes(matrix(c, rows), rate, **options))
                    yield found(rows, c, np.asarray(setup.usability(vectors(again, acceleration(rows))), float) * 100, after=True)

    return together.mapInArrow(run, "night_id string, channel string, epoch_idx int, probs array<double>, probs_after array<double>")


def statistics_of(rows: DataFrame, setup: Setup, part: str) -> DataFrame:
    """night_id, channel, epoch_idx, stat of epochs: kept ones where a night has as many epochs and channels as its signal, others
    are computed and kept. part: EEG, ACCagg or ACC."""
    if setup.saved is None:
        return signals.statistical_features(rows).select(*KEY, "stat")
    spark, folder = rows.sparkSession, f"{setup.saved}/{part}-{sinks.config_hash(setup.config)}"
    kind = "channel string, epoch_idx int, stat array<double>, night_id string"
    own = rows.select("night_id").distinct()
    kept = sinks.read_nights(spark, folder, kind)
    missing = sinks.to_compute(rows, kept.drop("stat").join(own, "night_id", "left_semi"))
    if not missing.isEmpty():
        sinks.write_nights(signals.statistical_features(missing).select(*KEY, "stat"), folder, only_these=True)
    return sinks.read_nights(spark, folder, kind).join(own, "night_id", "left_semi")


def features_of(eeg: DataFrame, acceleration: DataFrame, setup: Setup) -> DataFrame:
    """The vector of each channel's epoch, with that of the acceleration of its night."""

    def of(rows: DataFrame, part: str) -> DataFrame:
        spectrograms = signals.spectrogram_features(rows)
        if setup.lite:
            return spectrograms.drop("samples")
        if setup.saved is None:
            return signals.statistical_features(spectrograms).drop("samples")
        return spectrograms.drop("samples").join(statistics_of(rows, setup, part), KEY)

    columns = ["spec"] if setup.lite else ["spec", "stat"]
    paired = epochs.pair_with_acceleration(of(eeg, "EEG"), of(acceleration, "ACCagg"), columns)
    return epochs.lite_vector(paired) if setup.lite else epochs.usability_vector(paired)


def split_signals(whole: DataFrame, setup: Setup) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Epochs of the channels, of the axes (None if there are none), and of the one acceleration."""
    eeg = whole.where(F.col("channel").isin(*setup.channels))
    if not setup.axes:
        return eeg, None, epochs.pseudo_acceleration(eeg)
    axes = whole.where(F.col("channel").isin(*setup.axes))
    return eeg, axes, epochs.norm_of_epochs(axes, setup.axes)


def night_statistics(files: DataFrame, stages: DataFrame, setup: Setup, work: str) -> Results:
    """From files and sleep stages to usability, mobility, rejected stages, lights and statistics of all nights."""
    return labelled(signal_epochs(files, setup, work), stages, setup, work)


def labelled(found: Signals, stages: DataFrame, setup: Setup, work: str) -> Results:
    """The results of nights whose epochs are at hand. Labels are predicted once and written to the work folder.

    stages: night_id, epoch_idx, stage (null where it could not be read) of nights that have been scored; other nights have
    no rejected stages. Faults of stages: 4, 5, 7, 6, the first that holds; such nights go no farther.
    """
    config = setup.config
    eeg, axes, acceleration = split_signals(found.epochs, setup)
    if found.together is not None and setup.saved is None:
        predicted = table(signals.with_label(predictions(found.together, setup).drop("probs_after")), f"{work}/predicted")
        usability, moving = predicted.where("channel IS NOT NULL").select(*KEY, "label", "probs"), predicted.where("channel IS NULL").drop("channel")
    else:
        usability, moving = table(signals.predict(features_of(eeg, acceleration, setup), setup.usability).select(*KEY, "label", "probs"), f"{work}/usability"), None
    stages = stages.join(found.facts.select("night_id"), "night_id", "left_semi")
    sizes = usability.groupBy("night_id").agg((F.max("epoch_idx") + 1).alias("n_usability"))
    wrong = table(checks.stage_faults(stages, found.facts.join(sizes, "night_id", "left"), config).where("code IS NOT NULL"), f"{work}/stage_faults")
    good = checks.unify_rem(stages.join(wrong.select("night_id"), "night_id", "left_anti"))
    seen = majority.ignore_m_shaped(usability) if setup.ignore_m_shaped else usability
    rejected = table(majority.overlay(seen.drop("probs"), good, config), f"{work}/rejected")
    if axes is None:
        mobility = usability.select("night_id", "epoch_idx", "label", "probs").where("false")
        lights, dark = bedtime.lights(mobility, config, setup.least_run), mobility.select("night_id", F.lit(9).alias("code"))
    else:
        if moving is None:
            vectors = epochs.mobility_vector(signals.power_features(axes), "pow", setup.axes) if setup.lite_mobility else epochs.mobility_vector(statistics_of(axes, setup, "ACC"), "stat", setup.axes)
            moving = table(signals.predict(vectors, setup.mobility).select("night_id", "epoch_idx", "label", "probs"), f"{work}/mobility")
        mobility = moving.select("night_id", "epoch_idx", "label", "probs")
        lights = table(bedtime.lights(mobility, config, setup.least_run), f"{work}/lights")
        dark = bedtime.without_lights(mobility, lights).select("night_id", F.lit(9).alias("code"))
    statistics = table(sleepstats.sleep_statistics(rejected, lights, config), f"{work}/statistics")
    scored = rejected.select("night_id").distinct()
    short = scored.join(statistics, "night_id", "left_anti").select("night_id", F.lit(11).alias("code"))
    unscored = found.facts.join(scored, "night_id", "left_anti").join(wrong, "night_id", "left_anti").select("night_id", F.lit(10).alias("code"))
    faults = reduce(DataFrame.unionByName, (found.faults, wrong, dark, short, unscored))
    return Results(faults, usability, mobility, rejected, lights, statistics, found.facts)


def write_results(results: Results, setup: Setup, out: str) -> dict[str, float]:
    """Writes all results by night below ``out``, and enters each step of each night in the ledger after its files.

    Nights that are not among the results keep their files. Returns counts taken on the way, without another pass: nights,
    failed nights, and the usable percent of all epochs.
    """
    spark, config = results.usability.sparkSession, setup.config
    counted = Observation("usability")
    usability = results.usability.observe(counted, F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("usable"))
    sinks.write_nights(usability.select(*KEY, "label", F.col("probs").alias("percent")), f"{out}/usability_probabilities", only_these=True)
    lights = results.lights
    wide = sinks.wide_usability(results.usability, setup.channels, config)
    inside = bedtime.crop(results.usability.drop("probs"), lights, config.usability_len, config)
    tables = {
        "usability": wide,
        "rejected": sinks.rejected_scores(results.rejected, config),
        "mobility": results.mobility.select("night_id", "epoch_idx", "label", F.col("probs").alias("percent")),
        "lights": lights,
        "rejected_tib": sinks.rejected_scores(bedtime.crop(results.rejected, lights, config.sleep_len, config), config),
        "usability_tib": sinks.wide_usability(inside, setup.channels, config),
        "statistics": sleepstats.to_pairs(results.statistics),
    }
    for step in STEPS:
        sinks.write_nights(tables[step], f"{out}/{step}", only_these=True)
        sinks.enter(tables[step].select("night_id"), out, step, config)
    report = checks.error_report([results.faults])
    every = results.facts.select("night_id").unionByName(report.select("night_id")).distinct()
    status = every.join(report.groupBy("night_id").agg(F.sort_array(F.collect_list("code")).alias("codes"), F.max("fatal").alias("fatal")), "night_id", "left")
    outcome = Observation("nights")
    observed = status.observe(outcome, F.count(F.lit(1)).alias("n_nights"), F.count_if("fatal").alias("n_failed"))
    sinks.write_nights(observed, f"{out}/nights", only_these=True)
    sinks.enter(spark.read.parquet(f"{out}/nights").join(every, "night_id", "left_semi").select("night_id"), out, "nights", config)
    share = {"n": 0} if results.facts.isEmpty() else counted.get  # Spark leaves out what it knows to be empty
    return outcome.get | {"usable_percent": 100 * share["usable"] / share["n"] if share["n"] else float("nan")}


def run(files: DataFrame, stages: DataFrame, setup: Setup, work: str, out: str) -> dict[str, float]:
    """The whole job for the nights of a listing (path, length) that the ledger does not have yet."""
    left = nights_to_do(files, sinks.ledger(files.sparkSession, out), "nights", setup.config)
    if left.isEmpty():
        return {"n_nights": 0, "n_failed": 0, "usable_percent": float("nan")}
    return write_results(night_statistics(left, stages, setup, work), setup, out)


def filter_spiky_epochs(eeg: DataFrame, acceleration: DataFrame, usability: DataFrame, setup: Setup, spiky: int = 3, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signal with spiky epochs filtered, usability with those scored anew, and the recovery of each night.

    Only filtered epochs go through features and model again.
    """
    labelled = eeg.join(usability.select(*KEY, "label"), KEY)
    filtered = signals.filter_spiky(labelled, spiky=spiky, **options)
    changed = features_of(filtered.where(F.col("label") == spiky).drop("label"), acceleration, replace(setup, saved=None))
    rescored = signals.rescore(usability.select(*KEY, "label"), changed, setup.usability)
    return filtered.drop("label"), rescored, majority.recovery(usability, rescored, spiky)


def recovered(found: Signals, setup: Setup, work: str, spiky: int = 3, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usability, usability with spiky epochs filtered and scored anew, and the recovery of each night, as filter_spiky_epochs() gives
    them, from rows that hold all channels of an epoch: label, filter and second label are made in one pass, and no sample is shuffled."""
    rows = table(predictions(found.together, setup, spiky, **options), f"{work}/recovered")
    usability = signals.with_label(rows.where("probs IS NOT NULL").drop("probs_after"))
    both = rows.groupBy(*KEY).agg(F.first("probs", ignorenulls=True).alias("probs"), F.first("probs_after", ignorenulls=True).alias("after"))
    rescored = signals.with_label(both.select(*KEY, F.coalesce("after", "probs").alias("probs"))).drop("probs")
    return usability, rescored, majority.recovery(usability, rescored, spiky)


def write_filtered(filtered: DataFrame, folder: str, setup: Setup, low: float, high: float) -> DataFrame:
    """The filtered signal as an EDF file of all channels for each night: night_id, path, records."""
    wide = filtered.groupBy("night_id", "epoch_idx").agg(*(F.first(F.when(F.col("channel") == c, F.col("samples")), ignorenulls=True).alias(c) for c in setup.channels))
    return sinks.write_edf(wide.dropna(), folder, setup.channels, setup.config.rate, dict.fromkeys(setup.channels, low), dict.fromkeys(setup.channels, high))
