"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from argloom.llm import (
    bpe, fim, jaccard, langid, licenses, lmtrie, packing, pii, quality, repair, secrets, sharding, topk,
)
from argloom.llm.oracle import FILL_IN_MIDDLE, REPAIR

TRIE_ORDER = 3


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(_table(spark, folder, "documents"))


def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Sources stand in for owners, and a source's documents of one language for a repository."""
    documents = _table(spark, folder, "documents")
    found = secrets.scan(documents, F.col("source"), F.concat_ws("/", "source", "lang"))
    return secrets.digest(found)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = langid.language_id(_table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree ``source/language/hundred/id``.

    The table has no licence files, so ids that end in 0 stand in for those of
    their directories, and ids that end in 00 for those of their sources.
    """
    documents = _table(spark, folder, "documents")
    name = F.col("doc_id").cast("string")
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    inside = F.concat_ws("/", "source", "lang", hundred, name)
    path = F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", name)).otherwise(inside)
    opens = F.col("doc_id") % 10 == 0
    return licenses.scan(documents, path, opens)


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, folder, "documents"), path)


def language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = lmtrie.language_model_scores(_table(spark, folder, "documents"), order=TRIE_ORDER)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, folder, "documents")))


def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), lambda key: key % 100 == 0)


def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip_digests(_table(spark, folder, "documents"), path)


def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(_table(spark, folder, "documents")))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"), shards=40)


def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, folder, "conversations"))


QUERIES = {
    "op1_quality_rules": quality_rules,
    "op2_ngram_jaccard_join": ngram_jaccard_join,
    "op3_secret_scan": secret_scan,
    "op4_language_id": language_id,
    "op5_license_scan": license_scan,
    "op6_best_fit_packing": best_fit_packing,
    "op7_language_model_scores": language_model_scores,
    "op8_personal_data": personal_data,
    "op9_exact_top_k": exact_top_k,
    "op10_byte_level_bpe": byte_level_bpe,
    "op11_fill_in_middle": fill_in_middle,
    "op12_sharding": shards,
    "op13_conversation_repair": conversation_repair,
}

ORACLE: dict[str, str] = {
    "op9_exact_top_k": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op13_conversation_repair": REPAIR,
}
