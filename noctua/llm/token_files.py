"""Token ids as flat files: unsigned little-endian ids, with 64-bit document offsets beside them, read by memory map.

Part p of a set holds three files: ``p.ids`` (the ids of its documents, 16 bits each if the vocabulary allows it, else
32), ``p.idx`` (for each document the number of ids before it in the whole set, 64 bits, and last the number after
them), ``p.doc`` (the key of each document, 64 bits). Parts are in ascending order of the key, as are documents in a part.

Writing: the ranges of keys come from quantiles, texts are encoded where they are read, and only ids are shuffled. A
first pass writes ids and counts them; the prefix sums of the parts' counts are the bases that a second pass adds to
the offsets. Each file is written under a name of the attempt's own and then moved, so a lost task is simply run again.
"""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm import bpe
from noctua.llm.common import open_fs, shared_folder, slices, table, write_file

MODEL = "byte_bpe_50k.json"
#: Stands for a null key, which comes first.
NULL_KEY = -(1 << 63)
#: Parts of one set, at most: their bounds and bases are known to each task.
MOST_PARTS = 20_000


@dataclass(frozen=True)
class TokenSet:
    """What a reader must know: the folder, the type of an id, and documents and ids before each part (and after all)."""

    folder: str
    kind: str
    doc_bases: np.ndarray
    bases: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.bases) - 1


def bounds_of(docs: DataFrame, key: str) -> list[int]:
    """Keys that cut the documents into as many parts as the scan has. Reads the key only.

    A key that fills several parts is a bound several times; those without a key come first, as NULL_KEY.
    """
    n = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    parts = min((n or 0) + 1, MOST_PARTS)
    if parts < 2:
        return []
    rows, known = docs.agg(F.count("*"), F.count(key)).first()
    blank = round(parts * (rows - known) / max(rows, 1))
    left = parts - blank
    shares = [(i + 1) / left for i in range(left - 1)]
    found = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * parts)))).first()[0] if shares else None
    return [NULL_KEY] * min(blank, parts - 1) + sorted(found or [])


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 2, model: str | None = None) -> TokenSet:
    """Encodes all documents and writes the set. Null texts are empty: the end id alone. Keys are integers, in ascending
    order. Documents of one key are in the order of their ids; if they fill several parts, of a hash of these, then that.
    An empty table gives a set without documents."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model or bpe.model_from_file(public_tokenizers.path(MODEL)))
    bounds = np.array(bounds_of(docs, key), np.int64)
    parts = len(bounds) + 1

    def encode(batches):
        coder = bpe.loaded(shipped.value, public_tokenizers.PATTERN)
        end = np.array([end_id], coder.kind)
        for batch in slices(batches, 1000):
            keys = batch.column(0).cast(pa.int64()).fill_null(NULL_KEY)
            ids = [np.concatenate([x, end]).tobytes() for x in coder.encode_batch(batch.column(1).to_pylist())]
            part, after = (np.searchsorted(bounds, keys.to_numpy(), side).astype(np.int32) for side in ("left", "right"))
            for i in np.flatnonzero(after - part > 1).tolist():
                part[i] += zlib.crc32(ids[i]) % int(after[i] - part[i])
            yield pa.RecordBatch.from_arrays([pa.array(part), keys, pa.array(ids, pa.binary())], names=["part", "key", "ids"])

    def put(batches):
        kind = bpe.loaded(shipped.value, public_tokenizers.PATTERN).kind
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        attempt, out, part, keys, sizes = f"{path}/{uuid.uuid4().hex}", None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            out = out or system.open_output_stream(attempt)
            for ids in batch.column(2).to_pylist():
                out.write(ids)
                sizes.append(len(ids) // kind.itemsize)
            keys.append(batch.column(1).to_numpy())
        if out:
            out.close()
            system.move(attempt, f"{path}/{part}.ids")
            write_file(f"{folder}/{part}.doc", [np.concatenate(keys).astype("<i8").tobytes()])
            write_file(f"{folder}/{part}.len", [np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(sizes)], "ids": [sum(sizes)], "kind": [kind.str]})

    encoded = docs.select(F.col(key), F.col(text)).mapInArrow(encode, "part int, key bigint, ids binary")
    dealt = encoded.repartitionById(parts, "part").sortWithinPartitions("part", "key", "ids")
    counts = np.zeros((2, parts + 1), np.int64)
    kind = "<u2"
    for row in dealt.mapInArrow(put, "part bigint, docs bigint, ids bigint, kind string").toLocalIterator():
        counts[:, row.part + 1] = row.docs, row.ids
        kind = row.kind
    bases = counts.cumsum(axis=1)
    written = TokenSet(folder, kind, bases[0], bases[1])

    def rebase(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if bases[0, part] < bases[0, part + 1]:
                    local = read_array(f"{folder}/{part}.len", "<i8")
                    write_file(f"{folder}/{part}.idx", [(local + bases[1, part]).astype("<i8").tobytes()])
                    yield pa.RecordBatch.from_pydict({"part": [part]})

    spark.range(0, parts, 1, parts).mapInArrow(rebase, "part bigint").count()
    return written


def read_array(uri: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the folder is mounted, read otherwise."""
    system, path = open_fs(uri)
    if os.path.exists(path) and os.path.getsize(path):
        return np.memmap(path, kind, "r")
    with system.open_input_stream(path) as file:
        return np.frombuffer(file.read(), kind)


def read(spark: SparkSession, tokens: TokenSet) -> DataFrame:
    """One row per document, from the files: key, start, n_tokens, ids_crc32 (of its ids as unsigned 32-bit)."""

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if tokens.doc_bases[part] == tokens.doc_bases[part + 1]:
                    continue
                ids, index, keys = (read_array(f"{tokens.folder}/{part}.{e}", k) for e, k in (("ids", tokens.kind), ("idx", "<i8"), ("doc", "<i8")))
                for a in range(0, len(keys), 4096):
                    b = min(a + 4096, len(keys))
                    at = index[a : b + 1] - index[0]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:])]
                    own = np.asarray(keys[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_KEY), pa.array(np.asarray(index[a:b])), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["key", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, tokens.parts, 1, tokens.parts).mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    tokens = write(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"))
    return read(spark, tokens).withColumnRenamed("key", "doc_id")
