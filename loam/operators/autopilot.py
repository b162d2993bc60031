"""The search for better settings of retrieval: all candidates are fused, reranked and scored in one plan over legs that are searched once.

The grid is bounded (one row a candidate), so it is broadcast; what grows is the shortlist of each query, which the depth bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.operators import evals

#: Weights of the legs (dense, bm25) and constants of the fusion that are tried.
WEIGHTS = ((1.0, 0.5), (0.5, 1.0), (1.0, 0.25), (0.25, 1.0))
CONSTANTS = (10.0, 30.0, 60.0)


@dataclass(frozen=True)
class Retrieval:
    """Settings of retrieval in use, or of one candidate."""

    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    rrf_k: float = 60.0
    rerank: bool = True
    rerank_top_n: int = 50

    def depth(self, k: int) -> int:
        return max(k, self.rerank_top_n) if self.rerank else k


def candidates(now: Retrieval) -> list[Retrieval]:
    """The settings in use first, then what differs from them: other weights, other constants, no reranking. The most promising stand first."""
    tried = [replace(now, dense_weight=a, bm25_weight=b) for a, b in WEIGHTS] + [replace(now, rrf_k=c) for c in CONSTANTS] + [replace(now, rerank=False)]
    return [now, *(c for c in tried if c != now)]


def overrides(candidate: Retrieval, now: Retrieval) -> dict[str, str]:
    """What a candidate changes, as dotted keys and values as YAML writes them."""
    was = asdict(now)
    return {f"retrieval.{name}": str(value).lower() for name, value in sorted(asdict(candidate).items()) if value != was[name]}


def trials(dense: DataFrame, bm25: DataFrame, golden: DataFrame, documents: DataFrame, tried: list[Retrieval], k: int, score: Callable[[DataFrame], DataFrame], id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """candidate (its place in `tried`), scored, adversarial, recall, mrr, ndcg, missed.

    dense, bm25: query_id, id, rank, as deep as the deepest candidate asks for; golden: as in evals.query_scores; documents: id, document_id;
    score: gives pairs (query_id, id) a rerank_score, once for all candidates. A candidate sees the legs to its own depth; a leg of weight 0
    finds nothing; reranking orders its shortlist by rerank_score (null counts as 0), the fused rank deciding ties."""
    spark = dense.sparkSession
    rows = [(i, float(c.dense_weight), float(c.bm25_weight), float(c.rrf_k), c.rerank, c.depth(k)) for i, c in enumerate(tried)]
    grid = F.broadcast(spark.createDataFrame(rows, "candidate int, dense_weight double, bm25_weight double, rrf_k double, rerank boolean, depth int"))
    both = dense.select(query_id, id, F.lit("dense").alias("leg"), "rank").unionByName(bm25.select(query_id, id, F.lit("bm25").alias("leg"), "rank"))
    found = both.groupBy(query_id, id).agg(*[F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(leg) for leg in ("dense", "bm25")])
    part = lambda leg: F.when((F.col(leg) <= F.col("depth")) & (F.col(f"{leg}_weight") > 0), F.col(f"{leg}_weight") / (F.col("rrf_k") + F.col(leg)))
    fused = found.crossJoin(grid).withColumn("fused", F.when(part("dense").isNotNull() | part("bm25").isNotNull(), F.round(F.coalesce(part("dense"), F.lit(0.0)) + F.coalesce(part("bm25"), F.lit(0.0)), 12)))
    one = W.partitionBy("candidate", query_id)
    short = fused.filter("fused IS NOT NULL").withColumn("place", F.row_number().over(one.orderBy(F.desc("fused"), id))).filter(F.col("place") <= F.col("depth"))
    judged = score(found.select(query_id, id)).select(query_id, id, "rerank_score")
    by = F.when(F.col("rerank"), F.coalesce("rerank_score", F.lit(0.0)))
    ranked = short.join(judged, [query_id, id], "left").withColumn("final", F.row_number().over(one.orderBy(by.desc(), "place"))).filter(F.col("final") <= k)
    key = F.struct("candidate", F.col(query_id).alias("query")).alias("query_id")
    results = ranked.join(documents.select(id, "document_id"), id).select(key, F.col("final").alias("rank"), F.col(id).cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"))
    wanted = golden.crossJoin(grid.select("candidate")).select(key, "chunks", "documents")
    return evals.report(evals.query_scores(wanted, results, k).withColumn("candidate", F.col("query_id.candidate")), "candidate")


def suggestion(measured: DataFrame, tried: list[Retrieval], k: int) -> DataFrame:
    """One row: candidate, improves, recall, mrr, ndcg (the best one's measures less those of the settings in use), evaluated, skipped, yaml.

    measured: trials() of the first of `tried`, as many as were run. The best has the greatest (ndcg, recall, mrr), the first of equals, so that
    settings which measure the same never displace those in use; it improves them only if its ndcg is above theirs. The YAML fragment names
    what to change, and is {} where nothing improves; nothing is applied."""
    changes = measured.sparkSession.createDataFrame([(i, overrides(c, tried[0])) for i, c in enumerate(tried)], "candidate int, changes map<string,string>")
    names = ("recall", "mrr", "ndcg")
    base = measured.filter("candidate = 0").select(*[F.col(c).alias(f"base_{c}") for c in names])
    run = measured.agg(F.count("*").alias("evaluated"))
    best = evals.best(measured).select("candidate", *names)
    row = best.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(run)).join(F.broadcast(changes), "candidate").withColumn("improves", F.col("ndcg") > F.col("base_ndcg"))
    delta = {c: F.round(F.col(c) - F.col(f"base_{c}"), 4) for c in names}
    lines = F.transform(F.array_sort(F.map_entries("changes")), lambda e: F.concat(F.lit("  "), F.split_part(e["key"], F.lit("."), F.lit(2)), F.lit(": "), e["value"]))
    measures = lambda p: F.format_string(f"ndcg@{k} %.4f, recall %.4f, mrr %.4f", *[F.col(f"{p}{c}") for c in ("ndcg", "recall", "mrr")])
    head = F.concat(F.lit("# a suggestion, not applied; in use: "), measures("base_"))
    body = F.when(F.col("improves"), F.concat(F.lit("\n# suggested: "), measures(""), F.lit("\nretrieval:\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("\n# nothing measures better\n{}\n")
    return row.select("candidate", "improves", *[delta[c].alias(c) for c in names], "evaluated", (F.lit(len(tried)) - F.col("evaluated")).alias("skipped"), F.concat(head, body).alias("yaml"))
