"""From raw documents to packed training sequences, in five stages.

Every stage but the last takes documents and returns documents with the same
columns; each is written and read again before the next one starts. A stage
works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from argloom.llm import jaccard, langid, packing, pii, quality
from argloom.session import materialize


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents whose id, or lack of one, has a verdict in ``kept`` that is true."""
    good = verdicts.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_kept"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts and the perplexity bands keep."""
    return _keep(docs, quality.quality_rules(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; their language is the predicted one.

    Rejected are texts without a letter, for which no language is predicted. The
    column ``lang`` takes the prediction, so later stages go by it.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "lang")]
    found = langid.language_id(docs, keep=carried)
    found = found.where(F.col("lang_pred") != langid.UNKNOWN).withColumnRenamed("lang_pred", "lang")
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    groups = jaccard.near_duplicates(docs)
    return _keep(docs, groups.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    carried = [c for c in docs.columns if c != "doc_id"]
    found = pii.scan(docs, keep=carried)
    text = pii.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1,024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", pack),
]

# Models and tokenizers are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
