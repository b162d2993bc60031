"""Dense search: the nearest points of each query vector, exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.vectors import METRICS

#: Query rows, and components of their vectors, that a task holds at most; more are met in blocks by a shuffle, each with TILE points at a time.
MOST_QUERIES, MOST_COMPONENTS, TILE = 10_000, 10_000_000, 100_000
#: Scores that a task holds at once, and components of the pairs that it scores exactly at once.
SCORES, EXACT = 4_000_000, 2_000_000
_NEAR = 1e-9


def by_length(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length. Null and empty vectors, and those with null or non-finite components, are left out."""
    ends = array.offsets.to_numpy()
    sizes = np.where(array.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    values = array.values.to_numpy(zero_copy_only=False).astype(float)
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        matrix = values[ends[:-1][rows][:, None] + np.arange(n)]
        whole = np.isfinite(matrix).all(axis=1)
        yield rows[whole], matrix[whole]


def usable(vector: str) -> Column:
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def in_order(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, summed from left to right as functions.vectors does, so that they are the same numbers."""

    def summed(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    if metric == "euclid":
        return np.sqrt(summed((a - b) * (a - b)))
    dots = summed(a * b)
    if metric == "dot":
        return dots
    lengths = np.sqrt(summed(a * a)) * np.sqrt(summed(b * b))
    return np.divide(dots, lengths, out=np.zeros(len(dots)), where=lengths != 0)


def near_pairs(metric: str, points: np.ndarray, queries: np.ndarray, k: int, least: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of points and of queries, block by block, that hold each query's k best of the block: a matrix product says which, with room for its
    rounding. least: asked before each block, what a product must reach for each query (a squared distance is negative there)."""
    square = (queries * queries).sum(axis=1)
    step = max(1, SCORES // max(1, len(queries)))
    for at in range(0, len(points), step):
        block = points[at : at + step]
        own = (block * block).sum(axis=1)[:, None]
        scores = block @ queries.T
        if metric == "cosine":
            lengths = np.sqrt(own * square)
            scores = np.divide(scores, lengths, out=np.zeros_like(scores), where=lengths != 0)
            room = np.full(len(queries), _NEAR)
        elif metric == "dot":
            room = _NEAR * np.sqrt(own.max(initial=0) * square)
        else:
            scores, room = 2 * scores - own - square, _NEAR * (own.max(initial=0) + square)
        bar = np.partition(scores, len(block) - k, axis=0)[len(block) - k] if len(block) > k else np.full(len(queries), -np.inf)
        if least is not None:
            bar = np.maximum(bar, least())
        scores = (scores >= bar - room) | (bar == -np.inf)
        p, q = np.nonzero(scores)
        yield p + at, q


def best(found: pa.Table, k: int, higher: bool) -> pa.Table:
    """Of rows q, id and score the k best of each q; ties to the smaller id."""
    q, score, order = found["q"].to_numpy(), found["score"].to_numpy(), pc.sort_indices(found["id"]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    order = np.lexsort((place, -score if higher else score, q))
    q = q[order]
    return found.take(order[np.arange(len(q)) - np.searchsorted(q, q) < k])


def scored(metric: str, ids: pa.Array, points: np.ndarray, numbers: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[pa.Table]:
    """Tables q, id, score: for queries (with their numbers) at least their k best of these points; those under least, by number, may be missing."""
    pairs = max(1, EXACT // max(1, points.shape[1]))
    for p, q in near_pairs(metric, points, queries, k, None if least is None else lambda: least[numbers]):
        for at in range(0, len(p), pairs):
            i, j = p[at : at + pairs], q[at : at + pairs]
            yield best(pa.table({"q": numbers[j], "id": ids.take(pa.array(i)), "score": in_order(metric, points[i], queries[j])}), k, METRICS[metric][1])


def _empty(id_type: pa.DataType) -> pa.Table:
    return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], id_type), "score": pa.array([], pa.float64())})


def _searched(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k best of all batches (id, embedding) for each of asked (its first column names it, query_vector)."""
    queries = {m.shape[1]: (rows, m) for rows, m in by_length(asked["query_vector"].combine_chunks())} if asked.num_rows else {}
    held, waiting, least = None, [], np.full(asked.num_rows, -np.inf)  # least: the k-th score of each query so far

    def kept() -> pa.Table:
        made = best(pa.concat_tables([held, *waiting] if held else waiting), k, METRICS[metric][1])
        waiting.clear()
        number = np.bincount(made["q"].to_numpy(), minlength=len(least))
        full = number >= k
        kth = made["score"].to_numpy()[np.cumsum(number)[full] - 1]
        least[full] = -kth * kth if metric == "euclid" else kth
        return made

    for batch in batches:
        for rows, points in by_length(batch.column(1)):
            if points.shape[1] in queries and len(rows):
                for more in scored(metric, batch.column(0).take(pa.array(rows)), points, *queries[points.shape[1]], k, least):
                    waiting.append(more)
                    if sum(t.num_rows for t in waiting) >= (held.num_rows if held else 0):
                        held = kept()
    if waiting:
        held = kept()
    if held:
        yield from pa.table([asked[0].take(held["q"]).combine_chunks(), held["id"], held["score"]], names=[asked.column_names[0], "id", "score"]).combine_chunks().to_batches()


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """query_id, id, score, rank of the k best points a query. points: id and embedding; queries: query_id and query_vector.

    The stated queries meet all points, as matrices: small query sets travel to the points, larger ones by blocks, so that a
    task holds one block of queries and passes a tile of points by. A task hands on k rows a query. Vectors that are null or
    empty, or hold null or non-finite components, take no part; only vectors of one length meet."""
    rows = (points if where is None else points.filter(where)).select(id, "embedding")
    asked = queries.select(query_id, "query_vector")
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    schema = f"`{query_id}` {kinds[query_id]}, `{id}` {kinds[id]}, score double"

    def named(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.rename_columns([query_id, id, "score"]) for b in found)

    n, components = asked.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("query_vector"), F.lit(0))), F.lit(0))).first()
    if n <= MOST_QUERIES and components <= MOST_COMPONENTS:
        sent = points.sparkSession.sparkContext.broadcast(asked.toArrow())
        found = rows.mapInArrow(lambda batches: named(_searched(batches, sent.value, k, metric)), schema)
    else:
        blocks, tiles = max(-(-n // MOST_QUERIES), -(-components // MOST_COMPONENTS)), max(1, -(-rows.count() // TILE))
        numbers = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
        dealt = lambda key, most: F.pmod(F.xxhash64(key), F.lit(most)).cast("int")
        tiled = rows.withColumn("tile", dealt(id, tiles)).withColumn("block", numbers(blocks))
        met = asked.withColumn("block", dealt(query_id, blocks)).withColumn("tile", numbers(tiles))

        def both(points: pa.Table, asked: pa.Table) -> pa.Table:
            made = list(named(_searched(iter(points.to_batches()), asked, k, metric)))
            return pa.Table.from_batches(made) if made else pa.table([asked[query_id].slice(0, 0), points[id].slice(0, 0), pa.array([], pa.float64())], names=[query_id, id, "score"])

        found = tiled.groupBy("block", "tile").cogroup(met.groupBy("block", "tile")).applyInArrow(both, schema)
    return ranked(found, k, METRICS[metric][1], id, query_id)


def ranked(scored: DataFrame, k: int, higher: bool = True, id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    order = W.partitionBy(query_id).orderBy(F.col("score").desc() if higher else F.col("score").asc(), id)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def checked_dimensions(points: DataFrame, dimensions: int) -> DataFrame:
    """points; the query fails where a vector has other dimensions."""
    return points.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size("embedding").cast("string")))))
