"""Documents to token digests in five stages; each reads what the last one kept, written as Parquet.

Language identification drops documents of no language (no letters, or no language likelier than LEAST_SCORE); exact
and near duplicates leave one document of each group; mixing puts the documents in the order in which sources come at
their target weights; the last stage encodes each text to byte-level ids, decodes them, and says where in the mix it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm import bpe_job, exact_dedup, langid, mixing, simhash
from noctua.llm.common import shared_folder, table

#: Least calibrated probability of the predicted language.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. Learns from all labelled documents that are not held out."""
    found = langid.predict(docs, langid.fit(docs), label="__lang", score="__score")
    kept = found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints propose, a similarity of 0.8 over five words decides."""
    return simhash.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mix."""
    return mixing.arranged(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, mix_part, mix_row, n_tokens, ids_sha256, decoded_sha256.

    mix_part and mix_row are the document's place in the mix: the number of the file of the stage before, and the row in it.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    placed = docs.select("doc_id", "text", part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    return bpe_job.digests(placed, more=("mix_part", "mix_row"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language identification cannot be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
