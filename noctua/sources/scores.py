"""Sleep scores and usability scores as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stages(spark: SparkSession, path: str, skip: int = 5, separator: str = "\t") -> DataFrame:
    """path, epoch_idx, stage of each file: the first column after ``skip`` lines; null where it is not a number.

    A file is one row until it is split, which keeps the order of its lines; a night has about a thousand. Blank
    lines at the end do not count.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.rtrim(F.regexp_replace("value", r"\s+$", "")).alias("value"))
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where(F.col("line") >= skip)
    first = F.trim(F.split_part("text", F.lit(separator), F.lit(1)))
    return lines.select("path", (F.col("line") - skip).alias("epoch_idx"), first.try_cast("double").cast("int").alias("stage"))


#: A comma outside double quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells (column to text) of each row of score tables with # comments, by each file's own header.

    Files may differ in columns and their order. The two columns of times are left out if the last one is an end time.
    Cells that a row lacks are null; quotes around a cell are taken off. A file is one row until it is split into lines;
    a night has a few thousand.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.filter(F.split("value", "\r?\n"), lambda x: ~x.startswith("#") & (F.trim(x) != "")).alias("lines"))
    cells = lambda line: F.transform(F.split(line, COMMA), lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))
    headed = lines.where(F.size("lines") > 0).select("path", cells(F.col("lines")[0]).alias("names"), F.slice("lines", 2, F.size("lines")).alias("lines"))
    timed = F.element_at("names", -1).contains("End")
    headed = headed.withColumn("names", F.when(timed, F.slice("names", 1, F.greatest(F.size("names") - 2, F.lit(0)))).otherwise(F.col("names")))
    rows = headed.select("path", "names", F.posexplode("lines").alias("row", "line")).withColumn("own", cells(F.col("line")))
    values = F.transform("names", lambda c, i: F.struct(c.alias("key"), F.nullif(F.get("own", i), F.lit("")).alias("value")))
    return rows.select("path", "row", F.map_from_entries(values).alias("cells"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """path, epoch_idx (the place of the row), channel, label: score tables in long form, each by its own header."""
    rows = read_tables(spark, path).select("path", F.col("row").alias("epoch_idx"), F.explode("cells").alias("channel", "label"))
    return rows.withColumn("label", F.expr("try_cast(label AS INT)"))


def read_wide_scores(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A column (text) for each of ``columns``, null in rows of files that lack it, and path.

    Without ``columns``: those of all files, found by a job over the headers, in the order in which files name them.
    """
    tables = read_tables(spark, path)
    if columns is None:
        named = tables.where("row = 0").select(F.posexplode(F.map_keys("cells")).alias("at", "name"))
        columns = [r.name for r in named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]  # names of channels
    return tables.select(*(F.col("cells").getItem(c).alias(c) for c in columns), "path")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """path, comment of each line that starts with #."""
    return spark.read.text(path).where(F.col("value").startswith("#")).select(F.col("_metadata.file_path").alias("path"), F.trim(F.substring("value", 2, 1 << 20)).alias("comment"))


def to_long(wide: DataFrame, channels: list[str], keys: tuple[str, ...] = ("night_id", "epoch_idx")) -> DataFrame:
    """night_id, epoch_idx, channel, label from a column for each channel."""
    return wide.select(*keys, *(F.col(c).cast("int").alias(c) for c in channels)).unpivot(list(keys), channels, "channel", "label")
