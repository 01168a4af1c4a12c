"""Language identification: held-out accuracy, calibration, and what must not matter."""

import math
import zlib

import numpy as np
import pytest

from noctua.llm import langid
from tests.llm import edge


def test_held_out_accuracy_and_calibration(spark, sf_dir):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = langid.op1_langid(spark, sf_dir).collect()
    assert len(found) == len(labels)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    own = [r for r in found if r.held_out]
    right = [r.lang_pred == labels[r.doc_id] for r in own]
    assert np.mean(right) > 0.95
    assert abs(np.mean([r.score for r in own]) - np.mean(right)) < 0.1


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(langid.held_out("doc_id"), F.lit("zzz")).otherwise(F.col("text")))
    a, b = langid.fit(docs), langid.fit(changed)
    assert a.languages == b.languages and all((getattr(a, k) == getattr(b, k)).all() for k in ("weight", "language", "starts", "idf")) and a.temperature == b.temperature


def plain_prediction(text, model):
    """The language and its probability, n-gram by n-gram in plain Python."""
    whole = (1 << 64) - 1
    chars = [c if c.isalpha() else " " for c in (text or "").lower()]
    if not any(c != " " for c in chars):
        return "und", 0.0
    kept = [32, 32] + [ord(c) for i, c in enumerate(chars) if c != " " or (i and chars[i - 1] != " ")]
    found = {}

    def hashed(n, p):  # of the n characters that end at p
        if n == 1:
            return kept[p] * 0x9E3779B97F4A7C15 & whole
        return ((hashed(n - 1, p - 1) ^ hashed(n - 1, p) >> 31) * 0xD6E8FEB86659FD93 + kept[p] * (2 * n + 1)) & whole

    for p in range(2, len(kept)):
        for n in (1, 2, 3):
            b = (hashed(n, p) * 0xFF51AFD7ED558CCD & whole) >> 64 - langid.BUCKETS_LOG2
            found[b] = found.get(b, 0) + 1
    x = {b: math.log(1 + n) * model.idf[b] for b, n in found.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    z = [0.0] * len(model.languages)
    for b, v in x.items():
        for i in range(model.starts[b], model.starts[b + 1]):
            z[model.language[i]] += v / length * model.weight[i] / model.temperature
    p = [math.exp(v - max(z)) for v in z]
    return model.languages[z.index(max(z))], max(p) / sum(p)


def test_query_against_plain_loops(spark, sf_dir, monkeypatch):
    models, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    found = {r.doc_id: r for r in langid.op1_langid(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = sorted(rows, key=lambda r: len(r.text or ""))[: len(rows) * 3 // 4]
    assert len(rows) > 100
    for r in rows:
        lang, score = plain_prediction(r.text, models[0])
        assert found[r.doc_id].lang_pred == lang and found[r.doc_id].score == pytest.approx(score, rel=1e-9)


def test_edges(spark):
    docs = edge.documents(spark)
    model = langid.fit(docs)
    found = langid.predict(docs, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in found.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred == "und" or r.lang_pred in model.languages
    nothing = langid.fit(edge.documents(spark, empty=True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(edge.documents(spark, empty=True), model).count() == 0


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Ein Text, mit Wörtern -- und 123 Zeichen.  日本語!" * 40
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert (langid.ngram_counts(text) == whole).all()
    assert langid.ngram_counts("ÄB, c") is not None and (langid.ngram_counts("ÄB, c") == langid.ngram_counts("äb  C")).all()
    assert langid.ngram_counts(None) is None and langid.ngram_counts("12 !") is None


def test_weights_are_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 5 + i % 50]), np.array([0.9, 0.4]), y) for i, y in enumerate(rng.integers(0, 2, 200).tolist())]
    w = langid.fit_weights(rows, 2, langid.Penalties(l1=1.0))
    assert (w[[0, 1]] != 0).all() and (w[5:] == 0).mean() > 0.99
    logits = rng.standard_normal((4000, 3)) * 3
    p = langid.softmax(logits / 2.5)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert langid.fit_temperature(logits, y) == pytest.approx(2.5, rel=0.1)
