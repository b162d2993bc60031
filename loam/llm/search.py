"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into equal segments; each has a mean and a deviation. Over a segment of length L the inner product of two
vectors is at most L * (mean * mean + deviation * deviation), which is what the lower bound of their distance says. A few
wide segments rule out most pairs, more and narrower ones most of the rest, and only what is left is computed exactly.

The queries are met with all rows in blocks: a query goes to each tile of rows, a row to each group of queries, and one
task sees one bounded tile and group. Each gives its best k per query; a window over these picks the k of all.

Defined results: a vector that is null or holds null or non-finite components takes no part, neither does a null id; only
vectors of equal length are compared; an id is no candidate of its own queries; rows that repeat an id and vector count
once; ties go to the smaller id; an empty table or a lone vector gives no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.shared import table, written

#: Vectors of a tile and queries of a group; the segments of the coarse and the fine level.
TILE, GROUP, LEVELS = 8192, 4096, (4, 16)


def _features(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, scaled so that an inner product of features bounds the one of vectors."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = v[:, a:b].astype(np.float64)
        out += [part.mean(axis=1) * math.sqrt(b - a), part.std(axis=1) * math.sqrt(b - a)]
    return np.stack(out, axis=1)


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query (by place) its k best of v, ties to the smaller id: places, ids, scores."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    q_levels, v_levels = [_features(q, s) for s in LEVELS], [_features(v, s) for s in LEVELS]
    slack = 0.5 + 1e-9 * max(1.0, float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1])
    best = np.full((len(q), k), np.iinfo(np.int64).min)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    for at in range(0, len(v), step):
        least = best[:, -1].astype(np.float64) - slack
        rows, cols = np.nonzero(q_levels[0] @ v_levels[0][at : at + step].T >= least[:, None])
        cols += at
        for a, b in zip(q_levels[1:], v_levels[1:], strict=True):
            keep = np.concatenate([np.einsum("ij,ij->i", a[rows[s : s + 65536]], b[cols[s : s + 65536]]) >= least[rows[s : s + 65536]] for s in range(0, len(rows), 65536)] or [np.zeros(0, bool)])
            rows, cols = rows[keep], cols[keep]
        other = q_ids[rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        if not len(rows):
            continue
        score = np.concatenate([np.einsum("ij,ij->i", q[rows[s : s + 65536]], v[cols[s : s + 65536]]) for s in range(0, len(rows), 65536)])
        touched = np.unique(rows)
        held = best[touched] > np.iinfo(np.int64).min
        rows = np.concatenate([rows, np.repeat(touched, held.sum(axis=1))])
        score = np.concatenate([score, best[touched][held]])
        found = np.concatenate([ids[cols], best_id[touched][held]])
        by = np.lexsort((found, -score, rows))
        rows, score, found = rows[by], score[by], found[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        top = rank < k
        best[touched], best_id[touched] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        best[rows[top], rank[top]], best_id[rows[top], rank[top]] = score[top], found[top]
    there = best > np.iinfo(np.int64).min
    place = np.nonzero(there)[0]
    return place, best_id[there], best[there]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id and v, an array of long without nulls."""
    vectors = written(vectors.select("vec_id", "v").dropDuplicates(), "search-rows")
    queries = written(queries.select("vec_id", "v").dropDuplicates(), "search-queries")
    tiles, groups = max(1, math.ceil(vectors.count() / tile)), max(1, math.ceil(queries.count() / group))
    key = F.xxhash64("vec_id", "v")
    part = lambda n: F.pmod(key, F.lit(n)).cast("int")  # noqa: E731  # both sides' keys need one type: partitions are dealt by its hash
    left = queries.select(F.size("v").alias("dim"), part(groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("t"), F.col("vec_id").alias("query_id"), key.alias("q_key"), F.col("v").alias("qv"))
    right = vectors.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), part(tiles).alias("t"), "vec_id", "v")

    def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim)

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows or not (dim := a.column("dim")[0].as_py()):
            return pa.table({"query_id": pa.array([], pa.int64()), "q_key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids, q_keys = np.asarray(a.column("query_id")), np.asarray(a.column("q_key"))
        place, ids, score = best_of_tile(q_ids, matrix(a.column("qv"), dim), np.asarray(b.column("vec_id")), matrix(b.column("v"), dim), k)
        return pa.table({"query_id": q_ids[place], "q_key": q_keys[place], "vec_id": ids, "score": score})

    by = ["dim", "g", "t"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scored, "query_id long, q_key long, vec_id long, score long")
    order = W.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x; vectors with anything but finite components are left out."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
