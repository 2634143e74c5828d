"""Queries of this folder's operators, each over its whole table."""

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import (
    forest,
    hard_negatives,
    host_trust,
    jaccard,
    language,
    merkle,
    packing,
    pieces,
    quality,
    simhash,
    sql,
    token_counts,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@_query("op1_quality_rules", sql.QUALITY_RULES)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"))


URL_RULES = (
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
)


@_query("op2_url_filters")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rules = [host_trust.parse_rule(r) for r in URL_RULES]
    return host_trust.judge_urls(_table(spark, folder, "pages"), rules)


@_query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return language.judge(_table(spark, folder, "documents"))


@_query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@_query("op6_warc", sql.WARC)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(_table(spark, folder, "pages"))


@_query("op7_nearest_neighbours")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return forest.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@_query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"))


@_query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


@_query("op10_sentencepiece")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(_table(spark, folder, "documents"))


@_query("op11_hard_negatives", sql.HARD_NEGATIVES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@_query("op12_simhash_near_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query("op13_merkle_manifest", sql.MERKLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = string.ascii_uppercase
    lowered = F.translate("text", upper, upper.lower())
    changed = merkle.leaf(*[lowered if c == "text" else F.col(c) for c in columns])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.manifest(docs, columns, carry={"tampered": F.when(hit, changed)})
    root = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    proof = merkle.proof_digest(F.col("proof"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof.alias("proof_sha256"),
        root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
