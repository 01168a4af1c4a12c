"""Encoding and decoding a column of texts: ids as arrays, with byte offsets, and back."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from noctua.llm import bpe
from noctua.llm.common import quoted, slices, table

RANKS = "byte_bpe_50k.tiktoken"


def rank_model(path: str | None = None) -> str:
    """The library's model for a file of ranks."""
    return bpe.model_from_ranks(bpe.read_ranks(path or public_tokenizers.path(RANKS)))


def encode(docs: DataFrame, text: str = "text", model: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``ids`` (array<int>) and ``ends`` (array<long>: the byte at which each token ends in the UTF-8 text).

    Null texts give empty arrays. Other columns pass through; a column named ids or ends is replaced. Narrow: no
    shuffle, one Arrow batch in memory.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or rank_model())
    kept = [c for c in docs.columns if c not in ("ids", "ends")]
    schema = docs.select(*map(quoted, kept)).schema.add("ids", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.LongType()))

    def run(batches):
        coder = bpe.loaded(shipped.value, pattern)
        for batch in slices(batches, 1000):
            ids = coder.encode_batch(batch.column(text).to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            ends = np.concatenate([np.empty(0, np.int64), *(coder.offsets(x)[1:] for x in ids)])
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind)) for x, kind in ((flat, pa.int32()), (ends, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], names=[*kept, "ids", "ends"])

    return docs.select(*map(quoted, kept)).mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """Adds ``decoded`` (string) from an array of ids; a null array decodes to the empty string."""
    shipped = tokens.sparkSession.sparkContext.broadcast(model or rank_model())
    kept = [c for c in tokens.columns if c != "decoded"]

    def run(batches):
        coder = bpe.loaded(shipped.value, public_tokenizers.PATTERN)
        for batch in slices(batches, 1000):
            texts = [coder.decode_text(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return tokens.select(*map(quoted, kept)).mapInArrow(run, tokens.select(*map(quoted, kept)).schema.add("decoded", "string"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, pattern: str = public_tokenizers.PATTERN, more: tuple[str, ...] = ()) -> DataFrame:
    """Encodes each text, decodes its ids, and returns key, n_tokens and the digests of both in the same pass.

    Ids of a document are not materialised as rows. Null and empty texts: no ids, the digests of nothing. Columns named in
    ``more`` pass through.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or rank_model())
    passed = docs.select(quoted(key), *map(quoted, more))
    schema = T.StructType([*passed.schema, *(T.StructField(n, k) for n, k in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])

    def run(batches):
        coder = bpe.loaded(shipped.value, pattern)
        decimal = [str(i).encode() for i in range(len(coder.bytes_of))]
        for batch in slices(batches, 1000):
            counts, written, back = [], [], []
            for ids in coder.encode_batch(batch.column(batch.num_columns - 1).to_pylist()):
                each = ids.tolist()
                counts.append(len(each))
                written.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, each))).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return docs.select(quoted(key), *map(quoted, more), quoted(text).alias("__text")).mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded by the rank file and decoded again."""
    return digests(table(spark, sf_dir, "documents"))
