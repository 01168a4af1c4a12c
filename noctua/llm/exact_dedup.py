"""Exact duplicates of whole texts by a tree merge of sorted digest runs.

Texts are equal when identical after deleting white space (space and the five controls). Of equal texts the row
with the most code points stays, then the one with the smallest key (null keys are the largest), then the first read.

Each task turns what it read into sorted runs of digests, one for each range of the digest's first bytes. Runs meet in
rounds: in each, runs whose numbers agree but for the next four bits (four binomial rounds at once) are merged, and of
equal digests the best row and the count go on. Copies collapse in the first run that sees them, so a group of any
size is at most one row in each run; ranges keep a merge at about RANGE_ROWS rows at every size of the input.

A digest is the SHA-256 and the length of the normalised text: rows merge only if both agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.common import WHITE, cut, look_up, only, slices, table

#: Rows of all runs of a range, about, before equal ones collapse.
RANGE_ROWS = 50_000
#: Runs, and runs merged at once: 256 runs take two rounds.
RUNS, FAN_IN = 256, 16
LARGEST = (1 << 63) - 1
RUN = "place int, run int, digest binary, points bigint, id bigint, row bigint, n bigint"


def digest_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, id, exact (a hash of the text as it is), points (code points) and digest of each text, written once."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            points, digests = [], []
            for x in batch.column(1).to_pylist():
                data = (x or "").encode()
                bare = data.translate(None, WHITE)
                digests.append(hashlib.sha256(bare).digest() + len(bare).to_bytes(8, "big"))
                points.append(len(x or ""))
            rows = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(2), pa.array(points, pa.int64()), pa.array(digests, pa.binary())], names=["row", "id", "exact", "points", "digest"])

    return cut(docs.select(F.col(key).cast("bigint"), F.col(text), F.xxhash64(text)).mapInArrow(run, "row bigint, id bigint, exact bigint, points bigint, digest binary"))


def merged(digest: np.ndarray, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """One sorted run of several: of equal digests the best row, and the sum of n."""
    order = np.lexsort((rows, ids, -points, digest))  # a stable merge: the parts are sorted by digest already
    digest = digest[order]
    first = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
    best = order[first]
    return [digest[first], points[best], ids[best], rows[best], np.add.reduceat(n[order], first)]


def as_batch(place: np.ndarray, run: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    digest, *numbers = columns
    flat = np.ascontiguousarray(digest).view(np.uint8).reshape(len(digest), 40)
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(40), len(digest), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(np.full(len(digest), run, np.int32)), digests, *map(pa.array, numbers)], names=["place", "run", "digest", "points", "id", "row", "n"])


def as_arrays(data: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    digests = np.frombuffer(b"".join(data.column("digest").to_pylist()), "V40").view("S40")
    ids = data.column("id").fill_null(LARGEST).to_numpy()
    rows = data.column("row").to_numpy()
    n = data.column("n").to_numpy() if "n" in data.schema.names else np.ones(len(rows), np.int64)
    return [digests, data.column("points").to_numpy(), ids, rows, n]


def best_rows(rows: DataFrame, total: int) -> DataFrame:
    """digest, points, id, row and n of the row that stays, for each digest."""
    places = max(1, -(-total // RANGE_ROWS))

    def first_runs(batches):
        found = [as_arrays(b) for b in batches if b.num_rows]
        if found:
            columns = merged(*map(np.concatenate, zip(*found)))
            lead = np.ascontiguousarray(columns[0]).view(np.uint8).reshape(-1, 40)[:, :4].copy().view(">u4").ravel()
            yield as_batch(lead.astype(np.int64) * places >> 32, TaskContext.get().partitionId() % RUNS, columns)

    def merge_runs(data: pa.Table) -> pa.Table:
        columns = merged(*as_arrays(data))
        place, run = (data.column(c)[0].as_py() for c in ("place", "run"))
        return pa.Table.from_batches([as_batch(np.full(len(columns[0]), place), run, columns)])

    runs, left = rows.mapInArrow(first_runs, RUN), RUNS
    while left > 1:
        left = -(-left // FAN_IN)
        runs = runs.withColumn("run", (F.col("run") / FAN_IN).cast("int")).groupBy("place", "run").applyInArrow(merge_runs, RUN)
    return runs.drop("place", "run")


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, exact, points, digest, keep_id, group_size, kept.

    Null texts count as empty; all empty texts are one group. Of repeated rows (equal in key and text) one is kept.
    """
    rows = digest_rows(docs, key, text)
    total = rows.count()
    best = best_rows(rows, total).select("digest", F.expr(f"nullif(id, {LARGEST})").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    found = look_up(rows, cut(best), "digest", "group_size", total)
    return found.select("id", "exact", "points", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return only(docs, key, text, annotate(docs, key, text).select("id", "exact", "kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, those dropped too."""
    found = annotate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, bare, row_number() OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM r
"""
