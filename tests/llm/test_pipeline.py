"""The pipeline against the same five decisions made by brute force, and each stage on awkward rows."""

import re

import corpus_pipeline
from noctua.llm import bpe_job, langid, mixing
from tests.llm import edge
from tests.llm.test_dedup import brute_similar


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    kept = [r for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE]
    best = {}
    for r in kept:
        bare = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        if bare not in best or (-len(r.text), r.doc_id) < (-len(best[bare].text), best[bare].doc_id):
            best[bare] = r
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    roots = brute_similar([r.text for r in rows])
    ids = [r.doc_id for i, r in enumerate(rows) if roots[i] == i]
    every = {r.doc_id: tuple(r) for r in bpe_job.digests(docs).collect()}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert len({r.doc_id for r in found}) == len(found) and all(every[r.doc_id] == (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found)
    # the place of each document is that of the mix of those that are kept
    left = docs.where(docs.doc_id.isin([r.doc_id for r in found]))
    slots = {r.doc_id: (r.slot, r.place) for r in mixing.mix(left).collect()}
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.mix_part, r.mix_row))] == sorted(slots, key=slots.get)
    # one document of each group of similar texts is left, and no other is lost
    assert {r.doc_id for r in found} == set(ids)
    assert len(ids) >= 150


def test_stages_on_awkward_rows(spark, tmp_path):
    for empty in (False, True):
        docs = edge.documents(spark, empty)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            path = f"file://{tmp_path}/{name}-{empty}"
            out.write.parquet(path)
            before, docs = docs.count(), spark.read.schema(out.schema).parquet(path)
            assert docs.count() <= before
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
        if not empty:
            texts = [r.text for r in docs.collect()]
            assert None not in texts and "Same text here, twice." not in [t for t in texts if texts.count(t) > 1]
