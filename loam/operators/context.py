"""Contexts: packing of ranked chunks into a token budget, citations, prompts and markers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.text import stripped, token_estimate

#: Words of two chunks in common from which the later one is left out; tokens of a context.
ALIKE, BUDGET = 0.9, 4000
#: Fixed value: chunks that a refusal offers at most.
OFFERED = 5


def packed(chunks: DataFrame, budget: int = BUDGET, alike: float = ALIKE, query_id: str = "query_id") -> DataFrame:
    """chunks (query_id, rank, chunk_id, text) with tokens and verdict: used, duplicate, budget or empty.

    In order of rank a chunk is left out if it is blank, equals a packed one, or shares most words with one; one that
    does not fit is skipped and smaller ones after it still go in. Each step depends on the ones before, and a query's
    shortlist is bounded by the retrieval depth, so a query is one group."""
    rows = chunks.select(query_id, "rank", "chunk_id", stripped(F.col("text")).alias("text"))
    rows = rows.withColumn("tokens", F.greatest(token_estimate(F.col("text")), F.lit(1)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "chunk_id"])
        tokens = group["tokens"].to_numpy()
        words = group["text"].str.lower().str.split().explode()
        _, word = np.unique(words.fillna("").to_numpy(str), return_inverse=True)
        holds = np.zeros((len(group), int(word.max(initial=0)) + 1), np.float32)
        holds[np.repeat(np.arange(len(group)), np.maximum(group["text"].str.split().str.len(), 1)), word] = 1
        both = holds @ holds.T
        sizes = both.diagonal()
        twins = both / (sizes[:, None] + sizes[None, :] - both) >= alike
        blank = (group["text"] == "").to_numpy()
        used, left = np.zeros(len(group), bool), budget
        verdicts = np.where(blank, "empty", "budget").astype(object)
        for i in np.nonzero(~blank)[0]:
            if twins[i] @ used:
                verdicts[i] = "duplicate"
            elif tokens[i] <= left:
                verdicts[i], used[i], left = "used", True, left - tokens[i]
        return group[[query_id, "rank", "chunk_id", "tokens"]].assign(verdict=verdicts)

    kinds = dict(rows.dtypes)
    return rows.groupBy(query_id).applyInPandas(pack, f"{query_id} {kinds[query_id]}, rank {kinds['rank']}, chunk_id {kinds['chunk_id']}, tokens long, verdict string")


def tallies(verdicts: DataFrame, query_id: str = "query_id") -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(query_id).agg(count("used").alias("used"), count("duplicate").alias("dropped_duplicate"), count("budget").alias("dropped_budget"), count("empty").alias("dropped_empty"), F.coalesce(F.sum(F.when(F.col("verdict") == "used", F.col("tokens"))), F.lit(0)).alias("tokens"))


def citation(chunk_id: Column, source: Column, page: Column, start: Column, end: Column, rerank: Column, fused: Column) -> Column:
    return F.struct(chunk_id.alias("chunk_id"), source.alias("source"), page.alias("page"), F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))).alias("span"), F.round(F.coalesce(rerank, fused), 6).alias("score"))


def block(chunk_id: Column, source: Column, page: Column, text: Column) -> Column:
    """A chunk as it stands in a prompt."""
    where = F.concat(F.lit("(source: "), source, F.when(page.isNotNull(), F.concat(F.lit(", page: "), page.cast("string"))).otherwise(F.lit("")), F.lit(")"))
    return F.concat(F.lit("[^"), chunk_id, F.lit("] "), where, F.lit("\n"), text)


def prompts(blocks: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, prompt: the blocks (query_id, rank, block) of each query in order."""
    return blocks.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("prompt"))


def resolved(answers: DataFrame, known: DataFrame, answer_id: str = "answer_id") -> DataFrame:
    """answer_id, chunk_id, position: the markers [^id] of known chunks in order of first appearance, each once. known: answer_id, chunk_id."""
    marks = answers.select(answer_id, F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[\^([^\]\s]+)\]"), 1)).alias("at", "chunk_id"))
    first = marks.groupBy(answer_id, "chunk_id").agg(F.min("at").alias("at")).join(known.select(answer_id, "chunk_id").distinct(), [answer_id, "chunk_id"])
    return first.select(answer_id, "chunk_id", F.row_number().over(W.partitionBy(answer_id).orderBy("at")).alias("position"))


def verdict(answer: Column) -> Column:
    """The score (0 to 1) of a grader's answer: a JSON object, bare or fenced; null if it has no numeric score."""
    found = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    score = F.try_variant_get(F.try_parse_json(F.nullif(found, F.lit(""))), "$.score", "variant")
    number = F.when(F.schema_of_variant(score).rlike("INT|DOUBLE|DECIMAL|FLOAT"), F.try_variant_get(score, "$", "double"))
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def grounded(score: Column, threshold: float) -> Column:
    """An ungraded answer passes; a graded one must reach the threshold."""
    return score.isNull() | (score >= threshold)


def grounded_or_refused(answers: DataFrame, chunks: DataFrame, threshold: float, offered: int = OFFERED, answer_id: str = "answer_id") -> DataFrame:
    """answers (answer_id, answer, score) with refused and candidates; a refused answer is null.

    An answer is refused if its score is under the threshold; one without a score was not graded, which is no evidence against it. A refusal
    offers the first chunks (answer_id, final_rank, chunk_id, source, rerank_score, rrf_score) in order, with their scores, so that
    a reader sees what evidence there was. Chunks of answers that stand are not ranked; a refusal without chunks has an empty list."""
    rows = answers.withColumn("refused", ~grounded(F.col("score"), threshold))
    short = chunks.join(rows.filter("refused").select(answer_id), answer_id, "left_semi")
    order = W.partitionBy(answer_id).orderBy("final_rank", "chunk_id")
    first = short.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= offered)
    offer = F.struct("place", F.struct("chunk_id", "source", F.round(F.coalesce("rerank_score", "rrf_score"), 6).alias("score")).alias("chunk"))
    listed = first.groupBy(answer_id).agg(F.transform(F.array_sort(F.collect_list(offer)), lambda x: x["chunk"]).alias("_found"))
    kind = listed.schema["_found"].dataType
    joined = rows.join(listed, answer_id, "left").withColumn("answer", F.when(~F.col("refused"), F.col("answer")))
    return joined.withColumn("candidates", F.when(F.col("refused"), F.coalesce("_found", F.array().cast(kind)))).drop("_found")


def answered(rows: DataFrame) -> DataFrame:
    """rows with answer and mode. rows: generated (null: the call failed), retryable (whether that may pass), reranked, context.

    full: a generated answer over reranked passages; hybrid_only: one over fused ones; extractive: the context itself, where the
    call failed for now; failed: a failure that no retry mends, so that the answer is null instead of passages for ever."""
    failed = F.col("generated").isNull()
    lasting = failed & ~F.coalesce("retryable", F.lit(False))
    mode = F.when(lasting, "failed").when(failed, "extractive").when(F.col("reranked"), "full").otherwise("hybrid_only")
    return rows.withColumn("mode", mode).withColumn("answer", F.when(~lasting, F.coalesce("generated", "context")))
