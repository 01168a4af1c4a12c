"""Results as tables: wide score tables, features that can be used again, probabilities, moments, run facts."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.functions.config import Config
from noctua.operators.epochs import timestamps


def wide_usability(usability: DataFrame, channels: list[str], config: Config = Config()) -> DataFrame:
    """night_id, epoch_idx, a column for each channel, and the epoch's times. Channels are given: no job looks for them."""
    wide = usability.groupBy("night_id", "epoch_idx").pivot("channel", channels).agg(F.first("label"))
    return timestamps(wide, config.usability_len, config)


def rejected_scores(scores: DataFrame, config: Config = Config()) -> DataFrame:
    """The artifact-rejected stages with the times of their epochs."""
    return timestamps(scores.select("night_id", "epoch_idx", "stage"), config.sleep_len, config)


#: Whether Spark removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: else these lie on disk until the driver happens to collect its garbage, and
    those of all steps of a job add up."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def dealt(rows: DataFrame, night: str) -> DataFrame:
    """Rows by night in spark.sql.shuffle.partitions parts. Their number is said: of parts of few bytes adaptive execution would
    make one, and a single task would write the files of all nights. They go by a hash, since Spark leaves out a shuffle by a column
    that rows seem to be dealt by already, and then a night may lie in two parts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(night))


def write_nights(rows: DataFrame, path: str, kind: str = "parquet", only_these: bool = False) -> None:
    """Writes rows by night as ``path/night_id=.../night.parquet``, each night's rows in the order of epochs. One shuffle, by
    night; re-running replaces.

    With only_these, nights that are not among the rows keep what they have; else the whole table is replaced. Tasks stream
    rows into a file under another name and move it into place: a folder for each night costs Spark's own writer several
    calls for its rights and its move, which with many nights is most of the time. Text (kind csv) is left to that writer.
    """
    order = [c for c in ("night_id", "epoch_idx") if c in rows.columns]
    others = [c for c in rows.columns if c != "night_id"]
    named = rows.select(F.nullif(F.col("night_id").cast("string"), F.lit("")).alias("night_id"), *others)  # none and '' share a folder
    ordered = dealt(named, "night_id").sortWithinPartitions(*order)
    if kind == "csv":
        mode = "dynamic" if only_these else "static"
        ordered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("night_id").option("header", True).csv(path)
        return
    spark = rows.sparkSession
    final = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = path if only_these else f"{path.rstrip('/')}.{uuid.uuid4().hex}"  # rows may be read from what they replace
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system.mkdirs(target)

    def put(batches):
        night, out, writer = None, None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            body = batch.select(others)
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for begin, end in zip(starts, [*starts[1:], len(names)]):
                if out is None or names[begin] != night:
                    if out:
                        writer.close()
                        yield out.close().select(["night_id"])
                    night = names[begin]
                    out = NightFile(f"{folder}/night_id={escaped(night)}/night.parquet", night, alone=True)
                    writer = parquet.ParquetWriter(out.out, body.schema)
                writer.write_batch(body.slice(begin, end - begin))
        if out:
            writer.close()
            yield out.close().select(["night_id"])

    with shuffles_removed(spark):
        ordered.mapInArrow(put, "night_id string").write.format("noop").mode("overwrite").save()
    if not only_these:
        system.delete(final, True)
        system.rename(target, final)


#: What Spark writes as % and two digits in the name of a partition's folder.
ESCAPED = re.compile("[\\x01-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]")


def escaped(value: str | None) -> str:
    """The value of a partition column as its folder is named."""
    return ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


LEDGER = "night_id string, step string, config_hash string"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_nights(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What write_nights() has written; no rows where that is nothing yet."""
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """night_id, step, config_hash of the outputs below a folder that are whole; none where nothing was written yet."""
    folder = f"{out}/ledger"
    return spark.read.schema(LEDGER).parquet(folder).distinct() if exists(spark, folder) else spark.createDataFrame([], LEDGER)


def enter(nights: DataFrame, out: str, step: str, config: Config) -> None:
    """Notes that a step of these nights is done. To be called after its files are written."""
    entries = nights.select(F.col("night_id").cast("string").alias("night_id")).distinct()
    with shuffles_removed(nights.sparkSession):
        entries.select("night_id", F.lit(step).alias("step"), F.lit(config_hash(config)).alias("config_hash")).write.mode("append").parquet(f"{out}/ledger")


def save_features(rows: DataFrame, name: str, buckets: int = 64) -> None:
    """Saves features as a table whose buckets (by night and epoch) are sorted: pairing channels with the acceleration from two
    such tables of as many buckets needs no shuffle, nor does putting epochs back, where
    spark.sql.requireAllClusterKeysForCoPartition is false."""
    laid = rows.repartition(buckets, "night_id", "epoch_idx")  # a bucket is one file, so its order is known
    laid.write.mode("overwrite").bucketBy(buckets, "night_id", "epoch_idx").sortBy("night_id", "epoch_idx").format("parquet").saveAsTable(name)


#: Epochs that a writer turns to bytes at once.
TOGETHER = 32


def write_edf(rows: DataFrame, folder: str, channels: list[str], rate: int, low: dict[str, float], high: dict[str, float], file: str = "night.edf", seconds: int = 10, make: Callable[[str, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Writes each night as an EDF file ``folder/night_id/file`` of one-second records; night_id, path, records of each.

    rows: night_id, epoch_idx (from 0, without gaps), an array of rate * seconds physical values for each channel. Values
    outside a channel's physical range are cut to it. Arrays pass by in the order of epochs, so no task holds a night; a
    file is written under another name and then moved. make(channel, matrix of arrays): arrays of the values, where rows hold
    shorter ones of equal length; so what is shuffled may be less than what is written.
    """
    counts = rows.groupBy(F.col("night_id").alias("__night")).agg(F.count("*").alias("__epochs"))
    # the channels' names may be anything
    named = rows.select("night_id", "epoch_idx", *(F.col(f"`{c}`").cast("array<double>").alias(f"c{i}") for i, c in enumerate(channels))).repartition("night_id")
    laid = named.join(counts, named["night_id"] == counts["__night"]).drop("__night").sortWithinPartitions("night_id", "epoch_idx")
    return laid.mapInArrow(edf_writer(folder, channels, rate, low, high, file, seconds, make), WRITTEN)


def write_edf_of_lines(lines: DataFrame, size: int, folder: str, channels: list[str], rate: int, low: dict[str, float], high: dict[str, float], file: str = "night.edf", seconds: int = 10, make: Callable[[str, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """write_edf() of rows that hold a value of each channel, ``size`` of them an epoch, and come by night and in order, as a window
    leaves them; so nothing is shuffled here. Column epochs: how many there are of the night. A night that is not whole where it
    is written fails."""
    write = edf_writer(folder, channels, rate, low, high, file, seconds, make)

    def run(batches):
        yield from write(arrays_of(batches, size))

    rows = lines.select("night_id", *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(channels)), "epochs")
    return rows.mapInArrow(run, WRITTEN)


def arrays_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of epochs from those of lines: columns of numbers become columns of arrays of so many."""
    left = None
    for batch in batches:
        rows = batch if left is None else pa.concat_batches([left, batch])
        n = rows.num_rows // size
        if n:
            heads, ends = pa.array(np.arange(n) * size), pa.array(np.arange(n + 1) * size, pa.int32())
            night, *values, epochs = rows.slice(0, n * size).columns
            lists = [pa.ListArray.from_arrays(ends, x) for x in values]
            yield pa.RecordBatch.from_arrays([night.take(heads), pa.nulls(n, pa.int32()), *lists, epochs.take(heads)], names=[str(i) for i in range(len(lists) + 3)])
        left = rows.slice(n * size)
    if left is not None and left.num_rows:
        raise ValueError(f"a night's lines are no multiple of {size}")


WRITTEN = "night_id string, path string, records bigint"


def edf_writer(folder: str, channels: list[str], rate: int, low: dict[str, float], high: dict[str, float], file: str, seconds: int, make: Callable[[str, np.ndarray], np.ndarray] | None):
    """A function of Arrow batches (night, epoch, an array for each channel, epochs of the night) that writes them as files."""
    bottom, top = np.array([low[c] for c in channels]), np.array([high[c] for c in channels])
    head = edf_header(channels, rate, bottom, top)

    def values(channel: str, column: pa.Array) -> np.ndarray:
        matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        matrix = make(channel, matrix) if make else matrix
        sizes = column.value_lengths()
        if sizes.null_count or len(set(sizes.to_pylist())) > 1 or matrix.shape[1] != seconds * rate:
            raise ValueError(f"an epoch of {channel} has not {seconds * rate} values")
        return matrix.reshape(-1, seconds, rate)

    def closed(out: NightFile, promised: int) -> pa.RecordBatch:
        if out.records != promised:
            raise ValueError(f"night {out.night} has {out.records} of {promised} records where it is written")
        return out.close()

    def put(batches):
        night, out, promised = None, None, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for begin, end in zip(starts, [*starts[1:], len(names)]):
                if names[begin] != night:
                    if out:
                        yield closed(out, promised)
                    night, promised = names[begin], batch.column(batch.num_columns - 1)[begin].as_py() * seconds
                    out = NightFile(f"{folder}/{night}/{file}", night, head.replace(b"RECORDS.", str(promised).ljust(8).encode()))
                for at in range(begin, end, TOGETHER):
                    part = batch.slice(at, min(TOGETHER, end - at))
                    physical = np.stack([values(c, part.column(2 + k)) for k, c in enumerate(channels)], axis=2)
                    share = (physical - bottom[:, None]) / (top - bottom)[:, None]
                    out.add(np.clip(np.rint(share * 65535 - 32768), -32768, 32767).astype("<i2").tobytes(), len(part) * seconds)
        if out:
            yield closed(out, promised)

    return put


def edf_header(channels: list[str], rate: int, low: np.ndarray, high: np.ndarray) -> bytes:
    """The header of an EDF file of one-second records; in place of their number stands RECORDS. (with the point)."""
    n, text = len(channels), lambda values, width: "".join(str(v)[:width].ljust(width) for v in values)
    fixed = text(["0"], 8) + " " * 160 + "01.01.0101.01.01" + text([256 * (n + 1)], 8) + " " * 44 + "RECORDS." + text(["1"], 8) + text([n], 4)
    each = text(channels, 16) + " " * 80 * n + text([""] * n, 8) + text([f"{x:g}" for x in low], 8) + text([f"{x:g}" for x in high], 8) + text([-32768] * n, 8) + text([32767] * n, 8) + " " * 80 * n + text([rate] * n, 8) + " " * 32 * n
    return (fixed + each).encode("latin-1", "replace")


class NightFile:
    """A file in the making: it is written under a hidden name, and takes its place when it is whole; alone: also that of all
    other files in its folder."""

    def __init__(self, path: str, night: str | None, head: bytes = b"", alone: bool = False):
        self.system, self.path = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        folder, _, name = self.path.rpartition("/")
        self.system.create_dir(folder, recursive=True)
        self.night, self.uri, self.attempt, self.records = night, path, f"{folder}/.{name}.{uuid.uuid4().hex}", 0
        self.alone = fs.FileSelector(folder) if alone else None
        self.out = self.system.open_output_stream(self.attempt)
        self.out.write(head)

    def add(self, data: bytes, records: int) -> None:
        self.out.write(data)
        self.records += records

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.system.move(self.attempt, self.path)
        for other in self.system.get_file_info(self.alone) if self.alone else ():
            if other.is_file and other.base_name[0] not in "._" and other.base_name != self.path.rpartition("/")[2]:
                self.system.delete_file(other.path)
        return pa.RecordBatch.from_pydict({"night_id": pa.array([self.night], pa.string()), "path": [self.uri], "records": [self.records]})


def reusable(features: DataFrame, signal: DataFrame) -> DataFrame:
    """night_id of saved features that fit the signal: as many epochs, as many channels."""

    def shape(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.groupBy("night_id").agg((F.max("epoch_idx") + 1).alias(f"{prefix}_epochs"), F.countDistinct("channel").alias(f"{prefix}_channels"))

    both = shape(features, "f").join(shape(signal, "s"), "night_id")
    return both.where("f_epochs = s_epochs AND f_channels = s_channels").select("night_id")


def to_compute(signal: DataFrame, features: DataFrame) -> DataFrame:
    """The rows of nights whose features must be computed."""
    return signal.join(reusable(features, signal), "night_id", "left_anti")


def probability_rows(predicted: DataFrame) -> DataFrame:
    """The prediction matrix as rows: night_id, channel, epoch_idx, class, percent."""
    return predicted.select("night_id", "channel", "epoch_idx", F.posexplode("probs").alias("class", "percent"))


def run_info(spark: SparkSession, config: Config) -> DataFrame:
    """The settings of a run as key and value, and the hash that outputs carry."""
    settings = {k: str(v) for k, v in asdict(config).items()} | {"config_hash": config_hash(config)}
    return spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in settings.items() for x in kv))).alias("key", "value"))


def config_hash(config: Config) -> str:
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:16]
