"""Recordings read in parts: the header of each file once, then ranges of its data records by seek, as blocks of a channel.

A catalog has a row for each file, made from its path and size and a read of its header; faults come from it. Blocks of the
chosen files are then read by ranges of RANGE_BYTES: what is shuffled is names of ranges, never content, and no task holds
a file. A block holds BLOCK_SECONDS of a channel, with the count and bounds of its samples beside it, so facts of a night
need not touch samples. Format ``edf`` (after register()) reads ranges through ``spark.read`` as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from noctua.operators.sinks import shuffles_removed
from noctua.sources.edf import BLOCK_SECONDS, header
from noctua.sources.edf import combined_faults as faults_of_combined
from noctua.sources.edf import per_channel_faults as faults_of_channels

#: Bytes of a file that one task reads at once, about.
RANGE_BYTES = 32 << 20
#: What opening a range counts for beside its bytes: a task reads many small ranges, but not too many.
OPENING = 128 << 10
#: Partitions of the format at least, if there are as many ranges.
LEAST_PARTS = 64
CATALOG = (
    "path string, src_path string, file string, bytes bigint, labels array<string>, per_record array<int>, low array<double>, high array<double>, "
    "digital_low array<double>, digital_high array<double>, start bigint, records bigint, seconds double, wide boolean, error string"
)
BLOCKS = "src_path string, channel string, fs int, epoch_idx int, n int, least float, most float, samples array<float>"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
#: A row of together(): the blocks of one place of a night, each list in the order of its channels.
TOGETHER = "src_path string, epoch_idx int, channel array<string>, fs array<int>, n array<int>, least array<float>, most array<float>, samples array<array<float>>"
#: Samples of all channels that together() reads at once.
AT_ONCE = 1 << 21


def open_file(path: str):
    """A file of any file system that tasks reach, for reading at any place."""
    system, inner = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the recordings below a folder; contents are not read. Spark does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.lower("path").rlike(r"\.(edf|bdf)$"))


def facts_of(file, length: int) -> dict:
    """The header's fields as numbers; an error if the file lacks samples that they promise."""
    first = file.read_at(256, 0)
    h = header(first + file.read_at(256 * int(first[252:256]), 256))
    per = [int(x) for x in h["samples"]]
    record = sum(per) * (3 if h["wide"] else 2)
    if record <= 0 or h["seconds"] <= 0:
        raise ValueError("the file has no samples")
    records = h["records"] if h["records"] >= 0 else (length - h["start"]) // record
    if length < h["start"] + records * record:
        raise ValueError("the file is shorter than its header says")
    scales = {k: [float(x) for x in h[k]] for k in ("low", "high", "digital_low", "digital_high")}
    return scales | {"labels": h["label"], "per_record": per, "start": h["start"], "records": records, "seconds": h["seconds"], "wide": h["wide"]}


def catalog(files: DataFrame) -> DataFrame:
    """One row for each file of a listing: its header, or why it cannot be read."""
    names = [c.split()[0] for c in CATALOG.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, _, name = path.rpartition("/")
                row = dict.fromkeys(names) | {"path": path, "src_path": where, "file": name, "bytes": length}
                try:
                    with open_file(path) as file:
                        row |= facts_of(file, length)
                except (ValueError, IndexError, OverflowError, OSError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    SCHEMA = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CATALOG.split(", ")])
    return files.select("path", "length").mapInArrow(run, CATALOG)


class Ranges:
    """Reads samples of a file by place; the records of the last read are kept, as the next signal often needs them."""

    def __init__(self, file, h: dict):
        self.file, self.h, self.held = file, h, (None, None)
        self.width = 3 if h["wide"] else 2
        self.before = np.cumsum([0, *h["per_record"]])

    def samples(self, signal: int, begin: int, end: int) -> np.ndarray:
        """Physical samples of a signal from ``begin`` to ``end``."""
        h, per = self.h, self.h["per_record"][signal]
        a, b = begin // per, -(-end // per)
        if self.held[0] != (a, b):
            size = int(self.before[-1]) * self.width
            data = self.file.read_at((b - a) * size, h["start"] + a * size)
            self.held = (a, b), np.frombuffer(data, np.uint8).reshape(b - a, size)
        part = np.ascontiguousarray(self.held[1][:, self.before[signal] * self.width : self.before[signal + 1] * self.width])
        if self.width == 2:
            digital = part.view("<i2").ravel().astype(np.float64)
        else:
            x = part.reshape(-1, 3).astype(np.int32)
            digital = ((x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16) ^ 0x800000).astype(np.float64) - 0x800000
        low, high, dl, dh = (h[k][signal] for k in ("low", "high", "digital_low", "digital_high"))
        return ((digital[begin - a * per : end - a * per] - dl) * ((high - low) / (dh - dl)) + low).astype(np.float32)


def rate(h: dict, signal: int) -> int:
    return int(h["per_record"][signal] / h["seconds"])


def epochs_of(h: dict, signals: list[int]) -> int:
    """Blocks of a channel that is made of some signals, one after another."""
    return -(-sum(h["per_record"][s] for s in signals) * h["records"] // max(rate(h, signals[0]) * BLOCK_SECONDS, 1))


def blocks_between(reader: Ranges, where: str, channel: str, signals: list[int], first: int, last: int) -> Iterator[pa.RecordBatch]:
    """The blocks ``first`` to ``last`` - 1 of a channel."""
    h, fs_ = reader.h, rate(reader.h, signals[0])
    size, at, parts = max(fs_ * BLOCK_SECONDS, 1), 0, []
    for s in signals:
        n = h["per_record"][s] * h["records"]
        begin, end = max(first * size - at, 0), min(last * size - at, n)
        if begin < end:
            parts.append(reader.samples(s, begin, end))
        at += n
    flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
    if not len(flat):
        return
    cuts = np.append(np.arange(0, len(flat), size), len(flat))
    least, most = np.minimum.reduceat(flat, cuts[:-1]), np.maximum.reduceat(flat, cuts[:-1])
    k = len(cuts) - 1
    columns = [pa.array([where] * k), pa.array([channel] * k), pa.array(np.full(k, fs_, np.int32)), pa.array(np.arange(first, first + k, dtype=np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(least), pa.array(most)]
    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))], names=NAMES)


def tasks_for(size: int, pieces: int, range_bytes: int, least: int) -> int:
    """Tasks for so many ranges of so many bytes in all: ranges under RANGE_BYTES share one; at least ``least``, if there are as many ranges."""
    return max(min(-(-(size + pieces * OPENING) // max(range_bytes, RANGE_BYTES)), 1_000_000), min(least, pieces), 1)


def blocks(chosen: DataFrame, channels: list[str] | None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Blocks of the named channels of each file of a catalog; without channels all signals of a file, one after another, are
    the channel of the file's name. The catalog should be a table: its sizes are summed up first."""
    spark = chosen.sparkSession
    good = chosen.where("error IS NULL AND records > 0")
    pieces = F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1)).cast("int")
    total = good.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(pieces), F.lit(0))).first()
    parts = tasks_for(total[0], total[1], range_bytes, spark.sparkContext.defaultParallelism)
    ranges = good.select("*", F.posexplode(F.sequence(F.lit(1), pieces)).alias("piece", "nth")).withColumn("pieces", pieces)
    names = [c.split()[0] for c in CATALOG.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    reader, own = Ranges(file, row), signals_of(row, channels)
                    most = max((epochs_of(row, s) for _, s in own), default=0)
                    first, last = most * row["piece"] // row["pieces"], most * (row["piece"] + 1) // row["pieces"]
                    for channel, s in own if first < last else ():
                        yield from blocks_between(reader, row["src_path"], channel, s, first, last)

    return ranges.repartition(parts, "path", "piece").select(*names, "piece", "pieces").mapInArrow(run, BLOCKS)


def signals_of(h: dict, channels: list[str] | None) -> list[tuple[str, list[int]]]:
    """The channels to read of a file, each with its signals; without channels all signals are the channel of the file's name."""
    labels = h["labels"]
    own = [(c, [i]) for i, c in enumerate(labels) if c in channels] if channels is not None else [(h["file"].rpartition(".")[0], list(range(len(labels))))]
    return [(c, s) for c, s in own if h["per_record"][s[0]] > 0]


def together(chosen: DataFrame, channels: list[str] | None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The blocks of blocks(), all those of one place of a night in one row: the night's files are read side by side, so channels
    meet where they are decoded and no sample is shuffled for it. The catalog should be a table: its sizes are summed up first."""
    spark = chosen.sparkSession
    names = [c.split()[0] for c in CATALOG.split(", ")]
    nights = chosen.where("error IS NULL AND records > 0").groupBy("src_path").agg(F.collect_list(F.struct(*names)).alias("files"), F.sum("bytes").alias("bytes"))
    pieces = F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1)).cast("int")
    with shuffles_removed(spark):
        total = nights.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(pieces), F.lit(0))).first()
    parts = tasks_for(total[0], total[1], range_bytes, spark.sparkContext.defaultParallelism)
    ranges = nights.select("*", F.posexplode(F.sequence(F.lit(1), pieces)).alias("piece", "nth")).withColumn("pieces", pieces)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with ExitStack() as opened:
                    own = [(Ranges(opened.enter_context(open_file(h["path"])), h), h) for h in row["files"]]
                    own = [(reader, c, s) for reader, h in own for c, s in signals_of(h, channels)]
                    most = max((epochs_of(reader.h, s) for reader, _, s in own), default=0)
                    first, last = most * row["piece"] // row["pieces"], most * (row["piece"] + 1) // row["pieces"]
                    step = max(AT_ONCE // max(sum(rate(reader.h, s[0]) * BLOCK_SECONDS for reader, _, s in own), 1), 1)
                    for at in range(first, last, step):
                        found = [x for reader, c, s in own for x in blocks_between(reader, row["src_path"], c, s, at, min(at + step, last))]
                        if found:
                            yield side_by_side(found)

    return ranges.repartition(parts, "src_path", "piece").select("src_path", "files", "piece", "pieces").mapInArrow(run, TOGETHER)


def side_by_side(found: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Blocks of a night's channels as rows of TOGETHER."""
    rows = pa.concat_batches(found)
    rows = rows.take(pa.array(np.argsort(rows.column("epoch_idx").to_numpy(), kind="stable")))
    epochs = rows.column("epoch_idx").to_numpy()
    starts = np.flatnonzero(np.append(True, epochs[1:] != epochs[:-1]))
    ends = pa.array(np.append(starts, len(epochs)), pa.int32())
    lists = ["channel", "fs", "n", "least", "most", "samples"]
    heads = rows.select(["src_path", "epoch_idx"]).take(pa.array(starts))
    return pa.RecordBatch.from_arrays([*heads.columns, *(pa.ListArray.from_arrays(ends, rows.column(c)) for c in lists)], names=["src_path", "epoch_idx", *lists])


def combined(found: DataFrame, channels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The files to read where each night is one file with all channels, and the faults (src_path, code) of other nights."""
    faults = faults_of_combined(found, channels, found)
    return found.join(faults.select("src_path"), "src_path", "left_anti"), faults


def per_channel(found: DataFrame, channels: list[str], nights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The files to read where each channel is a file of its name, and the faults (src_path, code, channels) of nights.

    Of files that differ in their ending only, the first that can be read counts: .edf, .EDF, .bdf, .BDF.
    """
    from noctua.sources.edf import _of_channels

    faults = faults_of_channels(found, channels, nights, found)
    best = _of_channels(found.where("error IS NULL"), channels).groupBy("src_path", "channel").agg(F.min_by("file", "ending").alias("file"))
    chosen = found.join(best.select("src_path", "file"), ["src_path", "file"], "left_semi")
    return chosen.join(faults.select("src_path"), "src_path", "left_anti"), faults


class EdfPartition(InputPartition):
    """Ranges of files: path, number of the range, ranges of the file."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(len(ranges))
        self.ranges = ranges


class EdfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        system, root = (fs.LocalFileSystem(), "/" + self.path[5:].lstrip("/")) if self.path.startswith("file:") else fs.FileSystem.from_uri(self.path)
        scheme = self.path[: self.path.index(root)] if root in self.path else "file://"
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.is_file and f.path.lower().endswith((".edf", ".bdf"))]
        sizes = [(f, max(math.ceil(f.size / self.range_bytes), 1)) for f in files]
        pieces = sum(n for _, n in sizes)
        parts = tasks_for(sum(f.size for f in files), pieces, self.range_bytes, LEAST_PARTS)
        ranges = [(scheme + f.path, i, n) for f, n in sizes for i in range(n)]
        return [EdfPartition(ranges[pieces * k // parts : pieces * (k + 1) // parts]) for k in range(parts)] if ranges else []

    def read(self, partition):
        for path, piece, pieces in partition.ranges:
            with open_file(path) as file:
                h = facts_of(file, file.size())
                reader, where = Ranges(file, h), path.rpartition("/")[0]
                for i, label in enumerate(h["labels"]):
                    most = epochs_of(h, [i]) if h["per_record"][i] else 0
                    first, last = most * piece // pieces, most * (piece + 1) // pieces
                    if first < last:
                        yield from blocks_between(reader, where, label, [i], first, last)


class EdfSource(DataSource):
    """``spark.read.format("edf").option("rangeBytes", n).load(folder)``: blocks of all signals of all recordings below it.

    Small ranges share a partition. A file that cannot be read fails the query; a catalog tells which are.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdfSource)
