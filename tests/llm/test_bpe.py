"""Byte-level BPE against the rank library, and token files against the tokenizer file."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noctua.llm import bpe, bpe_job, common, token_files
from tests.llm import edge

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.ByteBpe(bpe_job.rank_model(), P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAbs '’\n\t=-.,1é日🙂  \x85\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_as_the_rank_library(text):
    ids = CODER.encode_batch([text])[0]
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode() and CODER.decode_text(ids) == text


def test_runs_and_whole_batches():
    texts = ["=" * i for i in range(130)] + [" " * i + "x" for i in range(20)] + ["ab " * 5000, None, "", "\n \n", "<|endoftext|>"]
    for text, ids in zip(texts, CODER.encode_batch(texts)):
        assert ids.tolist() == LIBRARY.encode_ordinary(text or "")


def test_a_worker_that_forgets_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_UNITS", 3)
    coder = bpe.ByteBpe(bpe_job.rank_model(), P.PATTERN)
    for text in ("one two three four", "five six", "one two, seven"):
        assert coder.encode_batch([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_split_characters():
    ids = CODER.encode_batch(["🙂"])[0]
    assert len(ids) > 1 and CODER.decode_text(ids[:1]) == "�" and CODER.decode_text(ids) == "🙂"
    assert CODER.offsets(ids)[-1] == 4


FILE_LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
FILE_CODER = bpe.ByteBpe(bpe.model_from_file(P.path("byte_bpe_50k.json")), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "a", " b", "é", "'s", "1"]), max_size=12).map("".join))
def test_added_tokens_as_the_library_finds_them(text):
    ids = FILE_CODER.encode_batch([text])[0]
    assert ids.tolist() == FILE_LIBRARY.encode(text, add_special_tokens=False).ids
    assert FILE_CODER.decode(ids) == text.encode()


def test_queries_as_registered(spark, sf_dir):
    """op3 and op4 over the whole table, against both libraries as they come."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    found = {r.doc_id: r for r in token_files.op3_token_files(spark, sf_dir).collect()}
    assert set(found) == set(docs)
    for doc in sorted(docs):
        ids = FILE_LIBRARY.encode(docs[doc], add_special_tokens=False).ids + [2]
        assert (found[doc].start, found[doc].n_tokens, found[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in bpe_job.op4_byte_bpe(spark, sf_dir).collect():
        ids = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_digests_of_every_text(spark):
    docs = edge.documents(spark)
    found = Counter(map(tuple, bpe_job.digests(docs).collect()))
    wanted = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        wanted[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert found == wanted
    assert bpe_job.digests(edge.documents(spark, empty=True)).count() == 0


def test_columns_of_ids_and_back(spark):
    docs = edge.documents(spark).withColumn("ids", edge_column())
    back = bpe_job.decode(bpe_job.encode(docs))
    assert back.columns == [*(c for c in docs.columns if c != "ids"), "ids", "ends", "decoded"]
    for r in back.collect():
        assert r.decoded == (r.text or "") and len(r.ids) == len(r.ends) and (r.ends or [0])[-1] == len((r.text or "").encode())


def edge_column():
    from pyspark.sql import functions as F

    return F.lit("a clash")


def test_token_files(spark):
    docs = edge.documents(spark)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = common.shared_folder(spark, "tokens")
    tokens = token_files.write(docs, folder)
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    wanted, start = [], 0
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted(map(tuple, token_files.read(spark, tokens).collect()), key=lambda r: r[1])
    assert found == wanted and tokens.bases[-1] == start and tokens.parts >= 1
    # the files alone hold everything: offsets are those of the whole set
    index = np.concatenate([np.asarray(token_files.read_array(f"{folder}/{p}.idx", "<i8"))[:-1] for p in range(tokens.parts) if tokens.bases[p] < tokens.bases[p + 1]])
    assert index.tolist() == [w[1] for w in wanted]
    assert token_files.read(spark, token_files.write(edge.documents(spark, empty=True), folder + "0")).count() == 0


@pytest.mark.parametrize("hot", [5, None])
def test_documents_of_one_key_fill_several_parts(spark, hot):
    """Two thirds of the rows have one key, or none: no part holds them all, and keys still ascend."""
    rows = [(i, f"text {i}") for i in range(300)] + [(hot, f"copy {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    tokens = token_files.write(docs, common.shared_folder(spark, "tokens"))
    found = sorted(map(tuple, token_files.read(spark, tokens).collect()), key=lambda r: r[1])
    assert np.diff(tokens.doc_bases).max() < 250 and len(found) == 900
    assert [r[0] for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in found] == np.concatenate([[0], np.cumsum([r[2] for r in found])[:-1]]).tolist()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert Counter((r[0], r[3]) for r in found if r[0] == hot) == Counter((k, crc(t)) for k, t in rows if k == hot)
