"""Signal mathematics on columns of arrays: each operator sends Arrow batches of epochs to a numpy helper.

Epochs of one length are stacked to a matrix, so work is vectorized over rows, and partitions hold epochs, never whole
nights. Null and empty arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noctua.functions import features, filters, spectral
from noctua.operators.epochs import KEY

ARRAY = T.ArrayType(T.DoubleType())
Helper = Callable[[np.ndarray, float], np.ndarray]


#: Values of the matrix that a helper gets at once: what it makes on its way is up to some hundred bytes for each.
CHUNK = 1 << 17


def by_chunks(helper: Helper, samples: pa.Array, rates: np.ndarray) -> pa.Array:
    """The helper's row for each row of samples; null where there are none, or no rate. Rows of one length and rate are
    stacked CHUNK values at a time, so memory does not hang on how many rows an Arrow batch has."""
    sizes = samples.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, values = samples.offsets.to_numpy()[:-1].astype(np.int64), samples.values.to_numpy(zero_copy_only=False)
    made, widths = [], np.zeros(len(samples), np.int64)
    for n, fs in sorted({(n, fs) for n, fs in zip(sizes.tolist(), rates.tolist()) if n and fs}):
        own = np.flatnonzero((sizes == n) & (rates == fs))
        step = max(CHUNK // n, 1)
        for at in (own[k : k + step] for k in range(0, len(own), step)):
            found = np.asarray(helper(values[starts[at][:, None] + np.arange(n)].astype(float), fs))
            widths[at] = found.shape[1]
            made.append((at, found))
    ends = np.append(0, np.cumsum(widths))
    flat = np.empty(ends[-1])
    while made:
        at, found = made.pop()
        flat[ends[at][:, None] + np.arange(found.shape[1])] = found
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(widths == 0))


def on_rows(helper: Helper):
    """A column function of (samples, fs): the helper's row for each row."""

    @F.arrow_udf(ARRAY)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for samples, rates in batches:
            yield by_chunks(helper, samples, rates.fill_null(0).to_numpy(zero_copy_only=False).astype(float))

    return run


def with_vector(epochs: DataFrame, name: str, helper: Helper) -> DataFrame:
    return epochs.withColumn(name, on_rows(helper)("samples", "fs"))


def spectrogram_features(epochs: DataFrame) -> DataFrame:
    """spec: 11 x 129 densities of the epoch at 2560 points."""
    return with_vector(epochs, "spec", spectral.spectrogram)


def power_features(epochs: DataFrame) -> DataFrame:
    """pow: Welch densities, 129 for 256 points or more."""
    return with_vector(epochs, "pow", spectral.welch)


def statistical_features(epochs: DataFrame) -> DataFrame:
    """stat: 36 statistical, 18 temporal, 336 spectral features."""
    return with_vector(epochs, "stat", features.all_features)


def filter_spiky(epochs: DataFrame, label: str = "label", spiky: int = 3, **options) -> DataFrame:
    """The epochs with the samples of spiky ones filtered; others keep theirs. Only spiky rows reach the helper's matrix.

    A conditional on the row: no join is needed once labels are beside the signal. Without spiky epochs nothing changes.
    """
    apply = on_rows(lambda x, fs: filters.remove_spikes(x, fs, **options))
    chosen = F.when(F.col(label) == spiky, F.col("samples"))
    return epochs.withColumn("samples", F.coalesce(apply(chosen, F.col("fs")), F.col("samples")))


def predict(rows: DataFrame, model: Callable[[np.ndarray], np.ndarray], column: str = "features") -> DataFrame:
    """Adds probs (percent) and label: the first class of the largest probability. model: matrix -> probabilities."""

    @F.arrow_udf(ARRAY)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield by_chunks(lambda x, _: np.asarray(model(x), float) * 100, batch, np.ones(len(batch)))

    return with_label(rows.withColumn("probs", run(column)))


def with_label(rows: DataFrame, column: str = "probs") -> DataFrame:
    """label: the place of the largest probability, the first of equal ones."""
    return rows.withColumn("label", (F.array_position(column, F.array_max(column)) - 1).cast("int"))


def rescore(original: DataFrame, changed: DataFrame, model: Callable[[np.ndarray], np.ndarray], column: str = "features") -> DataFrame:
    """Labels of original with those of changed rows predicted anew; only changed rows go through the model."""
    new = predict(changed, model, column).select(*KEY, F.col("label").alias("__new"))
    return original.join(new, KEY, "left").withColumn("label", F.coalesce("__new", "label")).drop("__new")


#: Samples beside a block that its spline sees: a sample's influence falls to about 0.27 with each one further away.
HALO = 32


def resample(samples: DataFrame, target: int = 256, block: int = 8192) -> DataFrame:
    """Every channel at the target rate, by cubic splines over blocks with a halo of neighbours; int(n * target / fs) samples.

    Blocks are independent, so a night is as many tasks as it has blocks. Channels at the target rate pass through
    untouched. Past the last sample the last cubic piece goes on. Samples are numbered without gaps.
    """
    same = samples.where(F.col("fs") == target)
    other = samples.where(F.col("fs") != target)
    total = other.groupBy("night_id", "channel").agg(F.count("*").alias("n"))
    i = F.col("sample_idx")
    first, last = F.floor((i - HALO) / block), F.floor((i + HALO) / block)
    spread = other.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    schema = "night_id string, channel string, sample_idx bigint, value double, fs int"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        night, channel, b = (k.as_py() for k in key)
        at, value, fs, n = (rows.column(c).to_numpy() for c in ("sample_idx", "value", "fs", "n"))
        order, fs, n = np.argsort(at), int(fs[0]), int(n[0])
        count = int(n * (target / fs))
        low = -(-b * block * target // fs)
        high = count if (b + 1) * block >= n else -(-(b + 1) * block * target // fs)
        own = np.arange(low, max(low, min(high, count)) if b * block < n else low)
        made = spectral.spline(value[order].astype(float)[None], own * (fs / target) - at.min())[0]
        names = [pa.array([x] * len(own), pa.string()) for x in (night, channel)]
        return pa.Table.from_arrays([*names, pa.array(own), pa.array(made, pa.float64()), pa.array(np.full(len(own), target, np.int32))], names=[c.split()[0] for c in schema.split(", ")])

    done = spread.join(total, ["night_id", "channel"]).groupBy("night_id", "channel", "block").applyInArrow(run, schema)
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]
    return same.select(*columns).unionByName(done)


def resample_blocks(blocks: DataFrame, target: int = 256, seconds: int = 10) -> DataFrame:
    """resample() of signals that come as blocks of so many seconds (the last may be shorter): blocks at the target rate.

    Each block sends the HALO samples at its edges to its neighbours and is resampled with what it gets; samples never
    become rows. Blocks shorter than the halo get less of it, so rates under HALO / seconds are less exact. Blocks at the
    target rate pass through. A last block of too few samples for one new sample is left out.
    """
    columns = ["night_id", "channel", "fs", "epoch_idx", "samples"]
    blocks = blocks.select(*columns[:4], F.col("samples").cast("array<double>").alias("samples"))
    same, other = blocks.where(F.col("fs") == target), blocks.where(F.col("fs") != target)
    none = F.lit(None).cast("array<double>")
    size = F.size("samples")
    start = F.greatest(size - HALO + 1, F.lit(1))
    to_next = other.select(*KEY[:2], (F.col("epoch_idx") + 1).alias("epoch_idx"), F.slice("samples", start, HALO).alias("before"), none.alias("after"))
    to_last = other.select(*KEY[:2], (F.col("epoch_idx") - 1).alias("epoch_idx"), none.alias("before"), F.slice("samples", 1, HALO).alias("after"))
    edges = to_next.unionByName(to_last).groupBy(*KEY).agg(F.first("before", ignorenulls=True).alias("before"), F.first("after", ignorenulls=True).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, epoch = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            parts = [[np.asarray(v if v is not None else (), float) for v in batch.column(i).to_pylist()] for i in (4, 5, 6)]
            last = [v is None or not len(v) for v in parts[2]]
            shapes: dict[tuple, list[int]] = {}
            for i, (x, before, after) in enumerate(zip(*parts)):
                shapes.setdefault((int(fs[i]), len(before), len(x), len(after), bool(last[i])), []).append(i)
            made: list[np.ndarray] = [np.zeros(0)] * batch.num_rows
            for (rate, halo, n, _, ends), at in shapes.items():
                whole = np.stack([np.concatenate([parts[1][i], parts[0][i], parts[2][i]]) for i in at])
                if not ends:
                    places = np.arange(seconds * target) * (rate / target) + halo
                    for i, row in zip(at, spectral.spline(whole, places)):
                        made[i] = row
                    continue
                for i, row in zip(at, whole):  # a signal's end: int(all its samples * target / rate) in all
                    count = int((int(epoch[i]) * rate * seconds + n) * (target / rate)) - int(epoch[i]) * seconds * target
                    if count > 0:
                        made[i] = spectral.spline(row[None], np.arange(count) * (rate / target) + halo)[0]
            some = [i for i, x in enumerate(made) if len(x)]
            if some:
                kept = batch.take(pa.array(some))
                samples = pa.array([made[i] for i in some], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(np.full(len(some), target, np.int32)), kept.column(3), samples], names=columns)

    joined = other.join(edges, KEY, "left").select(*columns, "before", "after")
    return same.unionByName(joined.mapInArrow(run, "night_id string, channel string, fs int, epoch_idx int, samples array<double>"))


#: Tapers of the display and the half bandwidth (time by frequency) they are concentrated in.
TAPERS, HALF_BANDWIDTH = 5, 3.0


def display_spectra(epochs: DataFrame, low: int = 3, high: int = 303, tapers: str = "hann") -> DataFrame:
    """Per epoch and channel the dB of bins low to high - 1, after scaling the powers of a night to 0 .. 10.

    tapers: ``hann`` for one Hann window, ``slepian`` for TAPERS sequences weighted by how concentrated they are.
    """
    if tapers not in ("hann", "slepian"):
        raise ValueError(f"no tapers {tapers}")

    def helper(x: np.ndarray, fs: float) -> np.ndarray:
        if tapers == "hann":
            return spectral.display_power(x, fs, low=low, high=high)
        own, share = spectral.slepian(x.shape[1], HALF_BANDWIDTH, TAPERS)
        return spectral.display_power(x, fs, own, share / share.sum(), low, high)

    power = with_vector(epochs, "power", helper).select(*KEY, "power")
    range_ = power.groupBy("night_id").agg(F.min(F.array_min("power")).alias("least"), F.max(F.array_max("power")).alias("most"))
    scaled = lambda x: (x - F.col("least")) / F.nullif(F.col("most") - F.col("least"), F.lit(0.0)) * 10
    return power.join(range_, "night_id").select(*KEY, F.transform("power", lambda x: 10 * F.log10(F.greatest(scaled(x), F.lit(1e-10)))).alias("db"))


def hypnogram(scores: DataFrame, epoch_len: int = 30, unusable: int = -1) -> DataFrame:
    """Adds the elapsed time of each epoch as h:mm, or m:ss in recordings of under an hour; the unusable label becomes -1."""
    night = scores.groupBy("night_id").agg((F.count("*") * epoch_len).alias("total"))
    t = F.col("epoch_idx") * epoch_len
    hours = F.format_string("%d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60))
    minutes = F.format_string("%d:%02d", F.floor(t / 60), t % 60)
    label = F.when(F.col("total") >= 3600, hours).otherwise(minutes)
    stage = F.when(F.col("stage") == unusable, -1).otherwise(F.col("stage"))
    return scores.join(night, "night_id").select("night_id", "epoch_idx", stage.alias("stage"), label.alias("elapsed"))


def trace(acceleration: DataFrame) -> DataFrame:
    """Adds the time in seconds of each sample, the first at 1 / fs."""
    return acceleration.withColumn("time_sec", (F.col("sample_idx") + 1) / F.col("fs"))
