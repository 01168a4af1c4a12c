"""EDF and BDF recordings as signal rows: the files are read by Spark and decoded by a numpy helper.

A file is one row of at most 2 GB; it leaves its task as blocks of samples, so nothing of a night's length goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a block that the decoder emits.
BLOCK_SECONDS = 10
SCHEMA = "src_path string, channel string, fs int, epoch_idx int, samples array<float>"


def header(data: bytes) -> dict:
    """The fixed and the signals' fields of a file's header."""
    text = data[:256].decode("latin-1")
    count = int(text[252:256])
    body = data[256 : 256 * (count + 1)].decode("latin-1")
    at, fields = 0, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        fields[name] = [body[at + i * width : at + (i + 1) * width].strip() for i in range(count)]
        at += count * width
    return fields | {"start": int(text[184:192]), "records": int(text[236:244]), "seconds": float(text[244:252]), "wide": data[0] == 0xFF}


def checked(data: bytes) -> dict:
    """The header's fields, if the file has all samples that they promise."""
    h = header(data)
    record = sum(map(int, h["samples"])) * (3 if h["wide"] else 2)
    if not record or not h["seconds"] or len(data) < h["start"] + max(h["records"], 0) * record:
        raise ValueError("the file is shorter than its header says")
    for k in ("low", "high", "digital_low", "digital_high"):
        list(map(float, h[k]))
    return h


def signals(data: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
    """label, rate and physical samples of each signal; 16-bit samples in EDF, 24-bit in BDF."""
    h = header(data)
    width = 3 if h["wide"] else 2
    sizes = [int(n) for n in h["samples"]]
    raw = np.frombuffer(data, np.uint8, offset=h["start"])
    records = len(raw) // (sum(sizes) * width) if h["records"] < 0 else h["records"]
    raw = raw[: records * sum(sizes) * width].reshape(records, sum(sizes) * width)
    at = 0
    for i, n in enumerate(sizes):
        part = np.ascontiguousarray(raw[:, at : at + n * width])
        at += n * width
        if width == 2:
            digital = part.view("<i2").astype(np.float64)
        else:
            b = part.reshape(records, n, 3).astype(np.int32)
            digital = ((b[..., 0] | b[..., 1] << 8 | b[..., 2] << 16) ^ 0x800000).astype(np.float64) - 0x800000
        low, high, dl, dh = (float(h[k][i]) for k in ("low", "high", "digital_low", "digital_high"))
        yield h["label"][i], int(n / h["seconds"]), ((digital.ravel() - dl) * ((high - low) / (dh - dl)) + low).astype(np.float32)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """src_path, file, content of the recordings below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower("path").rlike(r"\.(edf|bdf)$"))
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("src_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")


def _blocks(where: str, channel: str, fs: int, x: np.ndarray) -> pd.DataFrame:
    n = max(fs * BLOCK_SECONDS, 1)
    parts = [x[i : i + n] for i in range(0, len(x), n)]
    return pd.DataFrame({"src_path": where, "channel": channel, "fs": fs, "epoch_idx": range(len(parts)), "samples": parts})


def probe(files: DataFrame) -> DataFrame:
    """src_path, file, labels, error of each file: its header is read, and that the samples it promises are there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, file, content in zip(batch["src_path"], batch["file"], batch["content"]):
                try:
                    rows.append((where, file, checked(content)["label"], None))
                except (ValueError, IndexError, ZeroDivisionError) as e:
                    rows.append((where, file, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["src_path", "file", "labels", "error"])

    return files.select("src_path", "file", "content").mapInPandas(run, "src_path string, file string, labels array<string>, error string")


def decoded(files: DataFrame, channels: list[str] | None) -> DataFrame:
    """Blocks of the named channels of readable files; without channels all signals of a file are one after another.

    Their channel then is the file's name, their rate that of the first signal.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, file, content in zip(batch["src_path"], batch["file"], batch["content"]):
                found = list(signals(content))
                if channels is None:
                    yield _blocks(where, file.rpartition(".")[0], found[0][1], np.concatenate([x for _, _, x in found]))
                else:
                    for label, fs, x in found:
                        if label in channels:
                            yield _blocks(where, label, fs, x)

    return files.select("src_path", "file", "content").mapInPandas(run, SCHEMA)


def _of_channels(files: DataFrame, channels: list[str]) -> DataFrame:
    """Files named after a channel, with the place of their ending in the order of preference."""
    own = files.withColumn("channel", F.regexp_extract("file", r"^(.*)\.[^.]*$", 1)).where(F.col("channel").isin(channels))
    return own.withColumn("ending", F.array_position(F.array(*map(F.lit, ("edf", "EDF", "bdf", "BDF"))), F.regexp_extract("file", r"([^.]*)$", 1)))


def read_per_channel(files: DataFrame, channels: list[str], probed: DataFrame | None = None) -> DataFrame:
    """Blocks of each channel from the file of its name; all signals of a file are one after another.

    Of files that differ only in their ending, .edf comes before .EDF, .bdf, .BDF, and the first that can be read counts.
    Nights of which a channel has none give no rows; per_channel_faults() names them. ``probed``: probe(files), if it
    is at hand.
    """
    good = _of_channels((probed or probe(files)).where("error IS NULL"), channels)
    best = good.groupBy("src_path", "channel").agg(F.min_by("file", "ending").alias("file"))
    whole = best.groupBy("src_path").agg(F.countDistinct("channel").alias("n")).where(F.col("n") == len(set(channels))).select("src_path")
    chosen = files.join(best.select("src_path", "file"), ["src_path", "file"], "left_semi").join(whole, "src_path", "left_semi")
    return decoded(chosen, None)


def per_channel_faults(files: DataFrame, channels: list[str], nights: DataFrame | None = None, probed: DataFrame | None = None) -> DataFrame:
    """src_path, code, channels: a channel that cannot be read (1), and that has no file at all (13, besides 1).

    nights: src_path of all nights; by default those that have any recording.
    """
    every = (nights if nights is not None else files).select("src_path").distinct().withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    own = _of_channels(probed or probe(files), channels).groupBy("src_path", "channel").agg(F.count_if(F.col("error").isNull()).alias("good"))
    lacking = every.join(own, ["src_path", "channel"], "left").where(F.coalesce("good", F.lit(0)) == 0)
    coded = lacking.select("src_path", "channel", F.explode(F.when(F.col("good").isNull(), F.array(F.lit(1), F.lit(13))).otherwise(F.array(F.lit(1)))).alias("code"))
    return coded.groupBy("src_path", "code").agg(F.sort_array(F.collect_list("channel")).alias("channels"))


def read_combined(files: DataFrame, channels: list[str], probed: DataFrame | None = None) -> DataFrame:
    """Blocks of the named channels of the one file of each night. Nights with a fault (combined_faults()) give no rows."""
    faults = combined_faults(files, channels, probed).select("src_path").distinct()
    return decoded(files.join(faults, "src_path", "left_anti"), channels)


def combined_faults(files: DataFrame, channels: list[str], probed: DataFrame | None = None) -> DataFrame:
    """src_path, code: several files (3), unreadable (1), a channel missing (13); at most one for each night."""
    night = (probed or probe(files)).groupBy("src_path").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.first("labels").alias("labels"))
    lacking = F.size(F.array_except(F.array(*map(F.lit, channels)), "labels")) > 0
    code = F.when(F.col("n") > 1, 3).when(F.col("bad") > 0, 1).when(lacking, 13)
    return night.select("src_path", code.cast("int").alias("code")).where("code IS NOT NULL")
