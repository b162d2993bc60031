"""Rank fusion of legs, reranking, and the composition of hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fused(legs: dict[str, tuple[DataFrame, float]], k: int = 60, id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """query_id, id, score, final_rank, and for each leg its rank and score. legs: name -> (query_id, id, rank, score), weight.

    An id counts once a leg, at its best rank; a leg of weight 0 adds nothing but shows its ranks for ids of other legs.
    Terms are added in the order of the legs, so that sums repeat."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = reduce(DataFrame.unionByName, [df.select(query_id, id, F.lit(name).alias("leg"), "rank", "score") for name, (df, _) in legs.items()])
    ranks = [F.min(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs]
    scores = [F.min_by("score", F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_score") for name in legs]
    one = rows.groupBy(query_id, id).agg(*ranks, *scores)
    used = [name for name, (_, weight) in legs.items() if weight > 0]
    if not used:
        return one.filter(F.lit(False)).select(query_id, id, F.lit(0.0).alias("score"), F.lit(0).alias("final_rank"), *[f"{n}_{x}" for n in legs for x in ("rank", "score")])
    part = lambda name: F.coalesce(F.lit(float(legs[name][1])) / (F.lit(k) + F.col(f"{name}_rank")), F.lit(0.0))
    score = reduce(lambda a, b: a + b, map(part, used))
    found = one.filter(reduce(lambda a, b: a | b, [F.col(f"{name}_rank").isNotNull() for name in used])).withColumn("score", F.round(score, 12))
    order = W.partitionBy(query_id).orderBy(F.col("score").desc(), id)
    return found.withColumn("final_rank", F.row_number().over(order)).select(query_id, id, "score", "final_rank", *[f"{n}_{x}" for n in legs for x in ("rank", "score")])


def from_both(legs: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{name}_rank").isNotNull() for name in legs])


def word_overlap(a: Column, b: Column) -> Column:
    """The share of words (lower-cased, by white space) that two texts have in common."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"(?U)\s+"), lambda w: w != "")) for t in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def reranked(rows: DataFrame, score: Column, top: int, query_id: str = "query_id") -> DataFrame:
    """rows of a shortlist by a new score (null counts as 0), the old final_rank deciding ties: rerank_score, final_rank, top rows a query."""
    order = W.partitionBy(query_id).orderBy(F.coalesce("rerank_score", F.lit(0.0)).desc(), "final_rank")
    scored = rows.withColumn("rerank_score", score)
    return scored.withColumn("new_rank", F.row_number().over(order)).drop("final_rank").withColumnRenamed("new_rank", "final_rank").filter(F.col("final_rank") <= top)


def depth(top_k: int, rerank_top_n: int, reranking: bool) -> int:
    """How many rows each leg gives."""
    return max(top_k, rerank_top_n) if reranking else top_k


Leg = Callable[[int, Column | None], DataFrame]


def hybrid(legs: dict[str, tuple[Leg | None, float]], top_k: int, rerank_top_n: int = 50, where: Column | None = None, score: Callable[[DataFrame], DataFrame] | None = None, k: int = 60, id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """The whole of hybrid retrieval: query_id, id, score, final_rank, each leg's rank and score, rerank_score, found_by_both, mode, degraded.

    A leg gives (query_id, id, rank, score) for a depth and a filter; both get the same ones. The fused shortlist goes to `score`,
    which adds rerank_score, and top_k rows a query stay. A query without reranking, or one of whose scores is null, keeps the
    fused order: its mode is hybrid_only. A leg that is None is down: the mode names the leg that is left. Any mode but full is degraded."""
    there = {name: leg for name, leg in legs.items() if leg[0] is not None}
    if not there:
        raise ValueError("no leg to search")
    n = depth(top_k, rerank_top_n, score is not None)
    short = fused({name: (leg(n, where), weight) for name, (leg, weight) in there.items()}, k, id, query_id).filter(F.col("final_rank") <= n)
    rows = score(short) if score else short.withColumn("rerank_score", F.lit(None).cast("double"))
    whole = W.partitionBy(query_id)
    failed = F.max(F.col("rerank_score").isNull()).over(whole)
    rows = rows.withColumn("unranked", failed)
    order = whole.orderBy(F.when(F.col("unranked"), 0.0).otherwise(F.col("rerank_score")).desc(), "final_rank")
    mode = F.lit(f"{next(iter(there))}_only") if len(there) < len(legs) else F.when(F.col("unranked"), "hybrid_only").otherwise("full")
    rows = rows.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= top_k).drop("final_rank").withColumnRenamed("new_rank", "final_rank")
    both = from_both(list(there)) if len(there) == len(legs) else F.lit(False)
    return rows.withColumn("found_by_both", both).withColumn("mode", mode).withColumn("degraded", mode != "full").drop("unranked")
