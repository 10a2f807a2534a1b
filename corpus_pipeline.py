"""A training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

Toxicity and language drop the documents that they reject, near-duplicate detection keeps one document of each group,
substring deduplication takes repeated passages out of texts, and packing returns the pieces of the sequences. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm import language, packing, simhash, substring, toxicity
from lithoscope.llm.common import read, remove, written

#: A document is rejected as toxic from this score on; as of no known language under this cosine.
TOXIC_FROM, LANGUAGE_FROM = 0.5, 0.05


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labels of documents still here, scores as clean."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.where(F.col("score") < TOXIC_FROM).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose profile is near some learnt language; a wrong ``lang`` alone rejects none."""
    profiles = language.fit(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    found = language.identify(docs, profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_FROM)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by similarity of five-word shingles: the one with the smallest id."""
    return simhash.one_of_each_group(docs, words=5, similarity=0.8).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a smaller document's window covers; untouched texts stay as they are."""
    done = substring.deduplicate(docs)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept"))
    return done.where(left).withColumns({"n_chars": n_chars.cast("long"), "text": text}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("substring dedup", remove_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and reread; a stage's table goes once it is used."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before:
            remove(spark, before)
        before = path
    return docs


#: SQL can't express the fits, fingerprints and packing; tests compare the stages with brute force.
ORACLE_SQL = None
