"""Shared helpers: cluster-visible folders, lineage cuts, skew-proof lookups, file access from tasks."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot from this share of the rows; there are at most HOT_SHARE hot groups, so they may be broadcast.
HOT_SHARE = 1000
#: The six characters that separate words: space, tab, newline, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def slices(batches, rows: int = 500, most: int | None = None):
    """The Arrow batches of a task in pieces of at most so many rows, so few are held as Python objects.

    With ``most``, pieces of more bytes are halved down to single rows. Spark bounds the bytes of a batch
    (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default).
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield from halved(batch.slice(i, rows), most)


def halved(batch, most: int | None):
    if most is None or batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), most)
        yield from halved(batch.slice(half), most)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, as Spark resolves spark.checkpoint.dir; where that is unset, one below the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/noctua-checkpoints"
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, as a URI."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared checkpoint folder and read from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), for large tables: compressed, as Parquet below the shared folder."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups (one row for each key, of which column ``size`` counts the rows).

    Groups of over total / HOT_SHARE rows number below HOT_SHARE, so those are broadcast and their rows
    are not shuffled; all other rows are joined by a shuffle in which no key has more rows than that. Keys are
    not null.
    """
    least = max(total // HOT_SHARE, 1000)
    hot = F.broadcast(groups.where(F.col(size) > least))
    rest = groups.where(F.col(size) <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """Rows from the least count ``c`` on, in steps of 1/16 of a power of two, that leaves at most so many: a filter, no sort."""
    level = F.floor(F.log2("c") * 16)
    least, left = None, most
    for at, n in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # about a thousand rows at most
        if n > left:
            break
        least, left = at, left - n
    return words.where(level >= least) if least is not None else words.limit(0)


def only(docs: DataFrame, key: str, text: str, rows: DataFrame) -> DataFrame:
    """The rows of docs that ``rows`` (id, exact, kept: one row for each row of docs) keeps, once each.

    Rows are known by their key and the hash of their text. Of repeated rows, equal in both, one is returned.
    """
    known = rows.groupBy("id", "exact").agg(F.count("*").alias("copies"), F.max("kept").alias("kept")).where("kept")
    known = cut(known.select(F.col("id").alias("__id"), F.col("exact").alias("__exact"), "copies"))
    here = F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text}`") == F.col("__exact"))
    found = docs.join(known.where("copies = 1"), here, "left_semi")
    repeated = known.where("copies > 1")
    if repeated.isEmpty():
        return found
    again = docs.join(repeated, here, "left_semi")
    # a row of each from each task, then one: no task gets all repetitions
    one = again.groupBy(quoted(key).alias("__k"), F.xxhash64(quoted(text)).alias("__h")).agg(F.first(F.struct(*map(quoted, docs.columns))).alias("__row"))
    return found.unionByName(one.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns)))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI; for use inside tasks. Local folders given as file:/x or file:///x."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> None:
    """Writes byte strings to one file under an attempt's own name, then moves it: a retried task replaces it whole."""
    system, path = open_fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    system.move(attempt, path)


def unsigned(hash_column: Column) -> Column:
    """A 64-bit hash as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(hash_column), 16, "0"))
