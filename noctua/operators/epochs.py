"""Signals as rows: epochs, crops, norms, time stamps, and the assembly of feature vectors.

samples: night_id, channel, sample_idx, value, fs. signal epochs: night_id, channel, epoch_idx, fs, samples (array).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noctua.functions.config import Config

KEY = ["night_id", "channel", "epoch_idx"]


def to_epochs(samples: DataFrame, seconds: int = 10) -> DataFrame:
    """Whole epochs as arrays in the order of the samples; a partial last epoch is dropped.

    One shuffle by night, channel and epoch: keys are many and of equal size, so no night is a task of its own.
    """
    epoch = F.floor(F.col("sample_idx") / (F.col("fs") * seconds)).cast("int")
    grouped = samples.withColumn("epoch_idx", epoch).groupBy(*KEY).agg(F.first("fs").alias("fs"), F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s"))
    whole = grouped.where(F.size("s") == F.col("fs") * seconds)
    return whole.select(*KEY, "fs", F.transform("s", lambda x: x["value"]).alias("samples"))


def to_samples(epochs: DataFrame, seconds: int = 10) -> DataFrame:
    """Signal epochs as rows again."""
    rows = epochs.select(*KEY, "fs", F.posexplode("samples").alias("pos", "value"))
    return rows.select("night_id", "channel", (F.col("epoch_idx").cast("long") * F.col("fs") * seconds + F.col("pos")).alias("sample_idx"), "value", "fs")


def _whole(samples: DataFrame, seconds: int) -> DataFrame:
    """night_id, epochs: whole epochs of the shortest channel of each night."""
    each = samples.groupBy("night_id", "channel").agg(F.count("*").alias("n"), F.first("fs").alias("fs"))
    return each.groupBy("night_id").agg(F.min(F.floor(F.col("n") / (F.col("fs") * seconds))).alias("epochs"))


def crop_to_epochs(samples: DataFrame, seconds: int = 10) -> DataFrame:
    """Samples within whole epochs of the shortest channel of their night."""
    inside = F.col("sample_idx") < F.col("epochs") * F.col("fs") * seconds
    return samples.join(_whole(samples, seconds), "night_id").where(inside).drop("epochs")


def tail(samples: DataFrame, seconds: int = 10) -> DataFrame:
    """The samples that crop_to_epochs() leaves out."""
    outside = F.col("sample_idx") >= F.col("epochs") * F.col("fs") * seconds
    return samples.join(_whole(samples, seconds), "night_id").where(outside).drop("epochs")


AXES = ("dX", "dY", "dZ")


def norm(axes: DataFrame) -> DataFrame:
    """The Euclidean norm of a night's axes at each sample, as the channel ACCagg.

    Axes that come as rows of one sample each are brought together by a shuffle of all samples; where they come as
    epochs or as columns, norm_of_epochs() and norm_of_columns() do without that.
    """
    rows = axes.groupBy("night_id", "sample_idx").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"), F.first("fs").alias("fs"))
    return rows.select("night_id", F.lit("ACCagg").alias("channel"), "sample_idx", "value", "fs")


def norm_of_columns(wide: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """norm() of rows that hold all axes of a sample: a projection."""
    squares = reduce(lambda a, b: a + b, (F.col(x) * F.col(x) for x in axes))
    return wide.select("night_id", F.lit("ACCagg").alias("channel"), "sample_idx", F.sqrt(squares).alias("value"), "fs")


def norm_of_epochs(epochs: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Epochs of the norm from epochs of the axes; those that lack an axis are left out. One shuffle, of arrays."""
    wide = epochs.where(F.col("channel").isin(*axes)).groupBy("night_id", "epoch_idx")
    wide = wide.agg(F.first("fs").alias("fs"), *(F.first(F.when(F.col("channel") == x, F.col("samples")), ignorenulls=True).alias(x) for x in axes)).dropna(subset=list(axes))
    return wide.select("night_id", F.lit("ACCagg").alias("channel"), "epoch_idx", "fs", norm_of_arrays(*axes).alias("samples"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def norm_of_arrays(*axes: pa.Array) -> pa.Array:
    """The Euclidean norm at each place of arrays; null where one of them has no value."""
    sizes = np.stack([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in axes])
    most = sizes.max(axis=0)
    ends = np.append(0, np.cumsum(most))
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], most)

    def padded(x: pa.Array, own: np.ndarray) -> pa.Array:
        if (own == most).all():
            return x.flatten().cast(pa.float64())
        at = np.repeat(np.cumsum(own) - own, most) + place
        return x.flatten().cast(pa.float64()).take(pa.array(at, mask=place >= np.repeat(own, most)))

    values = [padded(x, own) for x, own in zip(axes, sizes)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.sqrt(reduce(pc.add, (pc.multiply(v, v) for v in values))))


def timestamps(epochs: DataFrame, seconds: int, config: Config = Config()) -> DataFrame:
    """Adds start_time_sec (of the first sample) and end_time_sec of each epoch."""
    i = F.col("epoch_idx")
    return epochs.withColumns({"start_time_sec": i * seconds + F.lit(1.0) / config.rate, "end_time_sec": ((i + 1) * seconds).cast("double")})


def data_indices(epochs: DataFrame, seconds: int, config: Config = Config()) -> DataFrame:
    """Adds start_data_index and end_data_index (inclusive) of each epoch."""
    n = F.lit(seconds * config.rate).cast("long")
    i = F.col("epoch_idx").cast("long")
    return epochs.withColumns({"start_data_index": i * n, "end_data_index": (i + 1) * n - 1})


def pseudo_acceleration(epochs: DataFrame) -> DataFrame:
    """A constant signal of 1 for each epoch of nights without an accelerometer, as the channel ACCagg."""
    each = epochs.groupBy("night_id", "epoch_idx").agg(F.first("fs").alias("fs"), F.max(F.size("samples")).alias("n"))
    return each.select("night_id", F.lit("ACCagg").alias("channel"), "epoch_idx", "fs", F.array_repeat(F.lit(1.0), F.col("n")).alias("samples"))


def night_facts(samples: DataFrame) -> DataFrame:
    """night_id, fs, seconds, n_channels: of the first channel by name, and how many there are."""
    each = samples.groupBy("night_id", "channel").agg(F.first("fs").alias("fs"), (F.count("*") / F.first("fs")).alias("seconds"))
    return each.groupBy("night_id").agg(F.min_by("fs", "channel").alias("fs"), F.min_by("seconds", "channel").alias("seconds"), F.count("*").alias("n_channels"))


def pair_with_acceleration(eeg: DataFrame, acc: DataFrame, columns: list[str]) -> DataFrame:
    """Each channel's epoch with the one acceleration epoch of its night: the columns of acc get the prefix acc_."""
    other = acc.select("night_id", "epoch_idx", *(F.col(c).alias(f"acc_{c}") for c in columns))
    return eeg.join(other, ["night_id", "epoch_idx"])


def usability_vector(paired: DataFrame) -> DataFrame:
    """features: spectrogram of the channel and of the acceleration, then their statistics (from pair_with_acceleration)."""
    return paired.select(*KEY, F.concat("spec", "acc_spec", "stat", "acc_stat").alias("features"))


def lite_vector(paired: DataFrame) -> DataFrame:
    """features: the two spectrograms only."""
    return paired.select(*KEY, F.concat("spec", "acc_spec").alias("features"))


def mobility_vector(axes: DataFrame, column: str, order: tuple[str, ...] = ("dX", "dY", "dZ")) -> DataFrame:
    """night_id, epoch_idx, features: the vectors of the axes in a fixed order; epochs that lack an axis are left out."""
    wide = axes.groupBy("night_id", "epoch_idx").pivot("channel", list(order)).agg(F.first(column))
    whole = wide.dropna(subset=list(order))
    return whole.select("night_id", "epoch_idx", F.concat(*order).alias("features"))


def put_back(original: DataFrame, changed: DataFrame, column: str) -> DataFrame:
    """The rows of original with the column of changed where it has the same night, channel and epoch."""
    new = changed.select(*KEY, F.col(column).alias("__new"))
    return original.join(new, KEY, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def merge_listings(first: DataFrame, second: DataFrame) -> DataFrame:
    """All files of both listings, once each."""
    return first.unionByName(second).distinct()
