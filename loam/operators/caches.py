"""Caches as tables: embeddings by text, answers by meaning, eviction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.vectors import cosine
from loam.operators.dense import by_length, in_order, usable
from loam.operators.lifecycle import upserted

#: Pivots of the entries of one vector length, and lengths that have pivots.
PIVOTS, LENGTHS = 64, 16
#: Threshold under which rings leave most pairs in, so that a tenant's vectors meet as matrices.
WIDE = 0.7
#: Entries of a tile, questions of a block, components of either and pairs scored at once, at most; what a product may be wrong by.
TILE, ASKED, COMPONENTS, PAIRS, NEAR = 50_000, 10_000, 4_000_000, 1 << 15, 3e-9


def embedding_key(model: str, version: str, text: Column) -> Column:
    return F.concat(F.lit(f"emb:{model}:{version}:"), F.sha2(text, 256))


def split_by_cache(texts: DataFrame, cache: DataFrame, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their cached vector, and the distinct keys and texts that have to be embedded."""
    keyed = texts.withColumn("key", embedding_key(model, version, F.col("text")))
    hits = keyed.join(cache.select("key", "vector"), "key", "left")
    misses = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    return hits, misses


def semantic_lookup(asked: DataFrame, entries: DataFrame, threshold: float = 0.95) -> DataFrame:
    """asked_id, entry_id, similarity: the most similar entry of the same tenant at or above the threshold, the first of equals.

    asked: asked_id, tenant, embedding; entries: entry_id, tenant, embedding. Every entry lies with its nearest pivot, in a ring by its
    angle to it. An entry within the threshold's angle of a question can lie only in the rings that the triangle inequality leaves, so a
    question goes to these alone, and pairs meet by tenant, pivot and ring. Under WIDE the rings leave nearly all pairs in: then a
    tenant's vectors of one length meet as matrices, tiles of entries by blocks of questions. A threshold of 0 or less lets vectors
    without direction and of other lengths in and has no such bound: then all of a tenant meet."""
    if 0 < threshold < WIDE:
        near = _met_in_tiles(asked, entries, threshold).withColumn("similarity", F.round("score", 9)).filter(F.col("similarity") >= threshold)
        return _best(near)
    if threshold <= 0:
        a, e = asked.select("asked_id", "tenant", F.col("embedding").alias("x")), entries.select("entry_id", F.col("tenant").alias("of"), F.col("embedding").alias("y"))
        met = a.join(e, F.col("tenant").eqNullSafe(F.col("of")))
    else:
        met = _met_in_rings(asked, entries, threshold)
    near = met.select("asked_id", "entry_id", F.round(cosine(F.col("x"), F.col("y")), 9).alias("similarity")).filter(F.col("similarity") >= threshold)
    return _best(near)


def _best(near: DataFrame) -> DataFrame:
    return near.groupBy("asked_id").agg(F.max("similarity").alias("similarity"), F.max_by("entry_id", F.struct("similarity", -F.col("entry_id"))).alias("entry_id"))


def _of() -> Column:
    """A tenant as text; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("tenant").cast("string")), F.lit(""))


def _met_in_tiles(asked: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """asked_id, entry_id, score: of each tile that a question meets, the entries that may be its most similar one, copies once."""
    key, size = ["of", "length"], F.size("embedding")
    q, e = (rows.filter(usable("embedding")).select(id, F.col("embedding").alias(vector), _of().alias("of"), size.alias("length")) for rows, id, vector in ((asked, "asked_id", "x"), (entries, "entry_id", "y")))
    parts = lambda rows, most, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(COMPONENTS) / F.col("length"))))).cast("int").alias(name))
    sizes = parts(q, ASKED, "blocks").join(parts(e, TILE, "tiles"), key)
    numbers = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    dealt = lambda id, most: F.pmod(F.xxhash64(id), F.col(most)).cast("int")
    q = q.join(sizes, key).select("asked_id", "x", *key, dealt("asked_id", "blocks").alias("block"), numbers("tiles").alias("tile"))
    e = e.join(sizes, key).select("entry_id", "y", *key, dealt("entry_id", "tiles").alias("tile"), numbers("blocks").alias("block"))
    kinds = dict(asked.dtypes) | dict(entries.dtypes)

    def alike(asked: pa.Table, entries: pa.Table) -> pa.Table:
        found = [pa.table({"asked_id": asked["asked_id"].slice(0, 0), "entry_id": entries["entry_id"].slice(0, 0), "score": pa.array([], pa.float64())})]
        if asked.num_rows and entries.num_rows:
            entries = entries.sort_by("entry_id")
            (rows, m), (own, n) = (next(by_length(v.combine_chunks())) for v in (asked["x"], entries["y"]))
            (m, _, which), (n, first, _) = _distinct(m), _distinct(n)  # an entry's copies are its first one by id, a question's have its answers
            by = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[by], np.arange(len(m) + 1))
            for i, j, score in _nearly_best(m, n, threshold):
                times = ends[i + 1] - ends[i]
                at = np.repeat(ends[i] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                found.append(pa.table({"asked_id": asked["asked_id"].take(pa.array(rows[by[at]])), "entry_id": entries["entry_id"].take(pa.array(own[first[np.repeat(j, times)]])), "score": np.repeat(score, times)}))
        return pa.concat_tables(found)

    return q.groupBy(*key, "block", "tile").cogroup(e.groupBy(*key, "block", "tile")).applyInArrow(alike, f"asked_id {kinds['asked_id']}, entry_id {kinds['entry_id']}, score double")


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, where each stands first, and which of them each row is."""
    _, first, which = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1])))[:, 0], return_index=True, return_inverse=True)
    return m[first], first, which


def _nearly_best(m: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of m and of n with their similarity, for each row of m those that may be its best above the threshold: a matrix product says which."""
    a, b = _directions(m), _directions(n).T
    step = max(1, COMPONENTS // len(n))
    for at in range(0, len(a), step):
        scores = a[at : at + step] @ b
        i, j = np.nonzero(scores >= np.maximum(scores.max(axis=1), threshold)[:, None] - NEAR)
        for k in range(0, len(i), PAIRS):
            x, y = at + i[k : k + PAIRS], j[k : k + PAIRS]
            yield x, y, in_order("cosine", m[x], n[y])


def _met_in_rings(asked: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """asked_id, x, entry_id, y of the pairs of a tenant that may be within the threshold."""
    reach = float(np.arccos(min(1.0, threshold - 1e-9))) + 1e-6
    width = reach / 2
    place = W.partitionBy(F.size("embedding")).orderBy(F.xxhash64(F.lit("pivot"), "entry_id"))
    found = entries.filter(usable("embedding")).withColumn("rn", F.row_number().over(place)).filter(F.col("rn") <= PIVOTS).select("embedding").limit(PIVOTS * LENGTHS).toArrow()
    pivots = {m.shape[1]: _directions(m) for _, m in by_length(found["embedding"].combine_chunks())} if found.num_rows else {}
    sent = asked.sparkSession.sparkContext.broadcast(pivots)

    def rings(everywhere: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, m in by_length(batch.column(2)):
                    if m.shape[1] not in sent.value:
                        at, pivot, low, high = rows, np.zeros(len(rows), int), np.zeros(len(rows), int), np.zeros(len(rows), int)  # lengths beyond LENGTHS: one ring
                    else:
                        angles = np.arccos(np.clip(_directions(m) @ sent.value[m.shape[1]].T, -1, 1))
                        nearest = angles.argmin(axis=1)
                        if everywhere:  # the entry's pivot is no farther from it than the question's own
                            i, pivot = np.nonzero(angles <= angles.min(axis=1)[:, None] + 2 * reach)
                            low, high = (np.floor((angles[i, pivot] + d) / width).astype(int) for d in (-reach, reach))
                            at = rows[i]
                        else:
                            at, pivot = rows, nearest
                            low = high = np.floor(angles[np.arange(len(rows)), nearest] / width).astype(int)
                    low, high = np.maximum(low, 0), np.minimum(high, int(np.pi / width) + 1)
                    times = high - low + 1
                    ring = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    own = batch.take(pa.array(np.repeat(at, times)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.repeat(pivot, times)), pa.array(ring)], names=[*batch.schema.names, "pivot", "ring"])

        return run

    def dealt(rows: DataFrame, id: str, vector: str, everywhere: bool) -> DataFrame:
        kinds = dict(rows.dtypes)
        ready = rows.select(id, "tenant", "embedding").filter(usable("embedding"))
        made = ready.mapInArrow(rings(everywhere), f"`{id}` {kinds[id]}, tenant {kinds['tenant']}, embedding {kinds['embedding']}, pivot long, ring long")
        return made.select(F.col(id), _of().alias("of"), F.size("embedding").alias("length"), "pivot", "ring", F.col("embedding").alias(vector))

    return dealt(asked, "asked_id", "x", True).join(dealt(entries, "entry_id", "y", False), ["of", "length", "pivot", "ring"])


def _directions(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def evicted(entries: DataFrame, now: Column, most: int) -> DataFrame:
    """Entries that stay: not past their deadline (0: none), the most recently used `most`."""
    alive = entries.filter((F.col("deadline") == 0) | (now < F.col("deadline")))
    return alive.orderBy(F.desc("last_used"), "key").limit(most)


def remembered(entries: DataFrame, answers: DataFrame, now: Column, ttl: int) -> DataFrame:
    """entries (key, response, deadline, last_used) with the answers of full mode put in, under sem:tenant:question.

    answers: tenant, question, response, mode. now: seconds. A deadline of 0 (ttl 0) never comes. Of several answers to one question any one stays."""
    key = F.concat(F.lit("sem:"), F.coalesce("tenant", F.lit("-")), F.lit(":"), F.col("question"))
    new = answers.filter("mode = 'full'").select(key.alias("key"), "response", (now + ttl if ttl else F.lit(0)).cast("double").alias("deadline"), now.cast("double").alias("last_used"))
    return upserted(entries, new, "key")


def invalidated(entries: DataFrame, namespace: str) -> DataFrame:
    """entries without those of a namespace (the first part of a key, up to its colon)."""
    return entries.filter(~F.startswith("key", F.lit(f"{namespace}:")))
