"""Retrieval metrics, reports, gates and the search for better settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.identity import document_id


def query_scores(golden: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """query_id, total, hits, recall, reciprocal_rank, ndcg of each golden query, also of those without results.

    golden: query_id, chunks, documents (arrays of what is relevant). results: query_id, rank, chunk_id, document_id.
    A row is a hit if its chunk or its document is relevant; recall counts hits against all distinct relevant ids."""
    asked = golden.select("query_id", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))
    asked = asked.withColumn("total", F.size(F.array_union("chunks", "documents")))
    rows = asked.join(results.filter(F.col("rank") <= k), "query_id", "left")
    hit = F.coalesce(F.array_contains("chunks", F.col("chunk_id")) | F.array_contains("documents", F.col("document_id")), F.lit(False))
    gain = F.when(hit, 1 / F.log2(F.col("rank") + 1.0))
    scored = rows.groupBy("query_id", "total").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("total", F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return scored.select(
        "query_id",
        "total",
        "hits",
        F.when(F.col("total") > 0, F.least(F.col("hits") / F.col("total"), F.lit(1.0))).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("total") > 0, F.least(F.col("dcg") / ideal, F.lit(1.0))).otherwise(0.0).alias("ndcg"),
    )


def report(scores: DataFrame, *by: str) -> DataFrame:
    """The means over queries that have something relevant, how many they are, and how many have nothing (adversarial)."""
    real = F.col("total") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(real, F.col(c))), F.lit(0.0)), 9)
    return scores.groupBy(*by).agg(F.count_if(real).alias("scored"), F.count_if(~real).alias("adversarial"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"), F.count_if(real & (F.col("hits") == 0)).alias("missed"))


def gate(current: DataFrame, baseline: DataFrame, enabled: bool = True, tolerance: float = 0.02) -> DataFrame:
    """current with passed and reason. Both: suite, model, config_hash, k, recall, ndcg."""
    b = baseline.select("suite", *[F.col(c).alias(f"base_{c}") for c in ("model", "config_hash", "k", "recall", "ndcg")])
    rows = current.join(b, "suite", "left")
    fell = lambda c: F.col(f"base_{c}") - F.col(c) > tolerance
    reason = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.col("base_model").isNull(), "no baseline")
        .when(F.col("base_model") != F.col("model"), "other model")
        .when(F.col("base_config_hash") != F.col("config_hash"), "other settings")
        .when(F.col("base_k") != F.col("k"), "other k")
        .when(fell("recall") & fell("ndcg"), "recall and ndcg fell")
        .when(fell("recall"), "recall fell")
        .when(fell("ndcg"), "ndcg fell")
        .otherwise("held")
    )
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason").isin("disabled", "held"))


def best(candidates: DataFrame) -> DataFrame:
    """The candidate with the best (ndcg, recall, mrr), the first of equals."""
    return candidates.orderBy(F.desc("ndcg"), F.desc("recall"), F.desc("mrr"), "candidate").limit(1)


def stratified(chunks: DataFrame, size: int, seed: str) -> DataFrame:
    """document_id, chunk_id, depth, position: one chunk of each document in turn, in an order that a hash deals, until there are size."""
    deal = lambda c: F.md5(F.concat(F.lit(seed), F.lit("|"), F.col(c).cast("string")))
    rows = chunks.select("document_id", "chunk_id").withColumn("depth", F.row_number().over(W.partitionBy("document_id").orderBy(deal("chunk_id"), "chunk_id")))
    picked = rows.orderBy("depth", deal("document_id"), "document_id").limit(size)
    return picked.withColumn("position", F.row_number().over(W.orderBy("depth", deal("document_id"), "document_id")))


def adversarial(sampled: DataFrame, share: float = 0.2) -> Column:
    """Whether a sampled row is among the share that loses its ground truth."""
    return F.row_number().over(W.orderBy(F.md5(F.concat(F.lit("adversarial|"), F.col("chunk_id").cast("string"))), "chunk_id")) <= F.floor(F.count("*").over(W.partitionBy()) * share)


def with_document_ids(golden: DataFrame, corpus: str) -> DataFrame:
    """golden with file names among its relevant_document_ids as the ids of the documents at corpus/name; ids (d_...) stay.

    The corpus path is taken as given: an id is the digest of the source as it was ingested."""
    named = lambda x: F.when(F.startswith(x, F.lit("d_")), x).otherwise(document_id(F.concat(F.lit(f"{corpus}/"), x)))
    return golden.withColumn("relevant_document_ids", F.transform("relevant_document_ids", named))


def numbered(asked: DataFrame) -> DataFrame:
    """id (q_0001 on, by position), question and the ids of what is relevant, of sampled rows (position, chunk_id, document_id,
    question, is_adversarial) that have a question; adversarial ones have nothing relevant. A sample is as small as a golden set,
    so its numbers come from one window."""
    rows = asked.filter(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("n", F.row_number().over(W.orderBy("position")))
    truth = lambda c: F.when(F.col("is_adversarial"), F.array().cast("array<string>")).otherwise(F.array(F.col(c).cast("string")))
    return rows.select(F.concat(F.lit("q_"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("id"), F.trim("question").alias("query"), truth("chunk_id").alias("relevant_chunk_ids"), truth("document_id").alias("relevant_document_ids"))


def baseline(report: DataFrame, suite: Column, model: str, config_hash: str, k: int) -> DataFrame:
    """A report as the record that later runs are held against by gate()."""
    return report.select(suite.alias("suite"), F.lit(model).alias("model"), F.lit(config_hash).alias("config_hash"), F.lit(k).alias("k"), *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "scored")


def deltas(winner: DataFrame, current: DataFrame, *by: str) -> DataFrame:
    """How far the winner's recall, mrr and ndcg are above those of the settings in use."""
    names = ("recall", "mrr", "ndcg")
    was = current.select(*by, *[F.col(c).alias(f"_{c}") for c in names])
    return winner.join(was, list(by)).select(*by, *[F.round(F.col(c) - F.col(f"_{c}"), 4).alias(c) for c in names])
