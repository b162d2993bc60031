"""An index for nearest neighbours: coarse cells, inverted lists with product codes, exact rescoring.

build() learns CELLS centroids by k-means rounds on Spark over a sample (TRAIN rows at most, picked by a hash of the id), and
for each of PARTS parts of a vector a book of 256 values of the residual, a group of bounded size each; then every row is
written to the list of its nearest centroid with a byte a part. Lists are sorted by (cell, id) ranges, so one that holds a
third of all rows is many files, and a search skips the row groups of other cells. The sizes are for recall, so tuned() measures them: how many cells, and how many rows by their
codes, hold the share asked for of the true neighbours of a sample of queries.

search() asks, of each query's `probes` nearest cells, the codes alone; the `depth` best are scored exactly. With
probes=None it is exact: a first pass over the nearest cells fixes a k-th score, a second looks into every cell whose bound
(score of the centroid, farthest row of the cell) reaches it, and no other. Rows without a usable vector (null, empty, another
length than most of the sample, null or non-finite components) are not indexed; an empty table makes an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.vectors import METRICS
from loam.operators import dense
from loam.operators.storage import written

#: Rows that centroids and books are learned from at most; rounds; centroids at most, and their components; parts of a code and values of a part.
TRAIN, ROUNDS, MOST_CELLS, MOST_COMPONENTS, PARTS, VALUES = 50_000, 8, 16_384, 10_000_000, 8, 256
#: Distinct cells up to which a search names them to the scan.
NAMED = 1_000
#: Rows found (queries by depth) that a task holds, rows that wait until they are ranked among these, and scores by codes made at once, at most.
HELD, WAITING, SCORED = 1_000_000, 250_000, 500_000


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _closest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how far it is."""
    half = (centroids * centroids).sum(axis=1) / 2
    at, step = np.zeros(len(m), np.int64), max(1, dense.SCORES // len(centroids))
    for i in range(0, len(m), step):
        at[i : i + step] = np.argmax(m[i : i + step] @ centroids.T - half, axis=1)
    return at, np.sqrt(((m - centroids[at]) ** 2).sum(axis=1))


def _means(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the rows nearest to each centroid."""
    at, sums = _closest(m, centroids)[0], np.zeros_like(centroids)
    np.add.at(sums, at, m)
    return sums, np.bincount(at, minlength=len(centroids))


def _matrices(batches: Iterator[pa.RecordBatch], size: int, unit: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches (with an embedding) without rows that have no vector of this size, and the vectors."""
    for batch in batches:
        for rows, m in dense.by_length(batch.column(batch.schema.get_field_index("embedding"))):
            if m.shape[1] == size and len(rows):
                yield batch.take(pa.array(rows)), _unit(m) if unit else m


@dataclass(frozen=True)
class Index:
    """What a search keeps in memory of an index at a path: the centroids with their lists' radius, and the books."""

    path: str
    metric: str
    id: str
    centroids: np.ndarray
    radius: np.ndarray
    books: np.ndarray

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def _learned(sample: DataFrame, size: int, cells: int, unit: bool) -> np.ndarray:
    """Centroids: the sample's first distinct vectors, moved by rounds of means. A task hands on a sum and a number a cell."""
    first = sample.dropDuplicates(["embedding"]).orderBy("h", "embedding").limit(cells).select("embedding").toArrow()
    centroids = np.concatenate([m for _, m in _matrices(iter(first.to_batches()), size, unit)])
    for _ in range(ROUNDS):
        sent = sample.sparkSession.sparkContext.broadcast(centroids)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, number = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)  # noqa: B023 - the round's own
            for _, m in _matrices(batches, size, unit):
                sums, n = _means(m, sent.value)  # noqa: B023
                total, number = total + sums, number + n
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(number)), pa.array(number[number > 0]), pa.array(list(total[number > 0]), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

        parts = sample.select("embedding").mapInArrow(partial, "cell long, n long, sums array<double>").orderBy("cell", "n", "sums").toArrow()
        total, number = np.zeros_like(centroids), np.zeros(len(centroids))
        np.add.at(number, parts["cell"].to_numpy(), parts["n"].to_numpy())
        for _, m in dense.by_length(parts["sums"].combine_chunks()):
            np.add.at(total, parts["cell"].to_numpy(), m)
        moved = np.where(number[:, None] > 0, total / np.maximum(number, 1)[:, None], centroids)
        sent.unpersist()
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def _books(sample: DataFrame, centroids: np.ndarray, parts: int, unit: bool) -> np.ndarray:
    """parts x VALUES x (size / parts): each part of the residuals is a group of TRAIN rows at most."""
    size = centroids.shape[1]
    width = size // parts
    sent = sample.sparkSession.sparkContext.broadcast(centroids)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m in _matrices(batches, size, unit):
            rest = m - sent.value[_closest(m, sent.value)[0]]
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(m), pa.int32()), pa.array(list(rest[:, p * width : (p + 1) * width]), pa.list_(pa.float64()))], names=["part", "embedding"])

    def learn(group: pa.Table) -> pa.Table:
        m = np.concatenate([m for _, m in dense.by_length(group["embedding"].combine_chunks())])
        m = m[np.lexsort(m.T[::-1])]  # the same whatever the order of arrival
        book = np.zeros((VALUES, width))
        own = np.unique(m[np.linspace(0, len(m) - 1, VALUES).astype(int)], axis=0)
        for _ in range(ROUNDS):
            sums, n = _means(m, own)
            own = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], own)
        book[: len(own)] = own
        book[len(own) :] = own[0]
        return pa.table({"part": pa.array([group["part"][0].as_py()] * VALUES, pa.int32()), "value": pa.array(range(VALUES), pa.int32()), "vector": pa.array(list(book), pa.list_(pa.float64()))})

    made = sample.select("embedding").mapInArrow(residuals, "part int, embedding array<double>").groupBy("part").applyInArrow(learn, "part int, value int, vector array<double>")
    found = made.orderBy("part", "value").toArrow()
    return np.array(found["vector"].to_pylist(), float).reshape(parts, VALUES, width)


def build(points: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, parts: int = PARTS, id: str = "point_id") -> Index:
    """Writes the index of points (id, embedding; other columns are left out) to a path that must not exist, and opens it."""
    unit, spark = metric == "cosine", points.sparkSession
    hashed = points.select(id, "embedding", F.xxhash64(F.lit("ann"), id).alias("h")).filter(dense.usable("embedding"))
    n = hashed.count()
    share = min(1.0, 2 * TRAIN / max(n, 1))
    picked = hashed.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).orderBy("h", id).limit(TRAIN)
    sample = written(picked.select("embedding", "h"), "ann-sample")
    common = sample.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 0
    if size % parts:
        parts = next(p for p in range(parts, 0, -1) if size % p == 0)
    most = max(1, min(MOST_CELLS, MOST_COMPONENTS // max(size, 1)))
    if size:
        centroids = _learned(sample.filter(F.size("embedding") == size), size, min(most, cells or max(1, round(n**0.5))), unit)
        books = _books(sample.filter(F.size("embedding") == size), centroids, parts, unit)
    else:
        centroids, books = np.zeros((0, 0)), np.zeros((0, VALUES, 0))
    sent, width = spark.sparkContext.broadcast((centroids, books)), size // parts
    kind = dict(points.dtypes)[id]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, books = sent.value
        for batch, m in _matrices(batches, size, unit):
            cell, far = _closest(m, centroids)
            rest = m - centroids[cell]
            codes = np.stack([_closest(rest[:, p * width : (p + 1) * width], books[p])[0] for p in range(parts)], axis=1).astype(np.uint8)
            coarse = centroids[cell] + np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((coarse * coarse).sum(axis=1)), pa.array(far), batch.column(1)], names=[id, "cell", "code", "square", "far", "embedding"])

    lists = points.select(id, "embedding").mapInArrow(coded, f"`{id}` {kind}, cell long, code binary, square double, far double, embedding {dict(points.dtypes)['embedding']}")
    lists.repartitionByRange("cell", id).sortWithinPartitions("cell", id).write.parquet(f"{path}/lists")
    radius = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell long, vector array<double>")
    rows.join(radius, "cell", "left").select("cell", "vector", F.coalesce("radius", F.lit(-1.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n")).coalesce(1).write.parquet(f"{path}/cells")
    flat = [(p, v, books[p, v].tolist()) for p in range(len(books)) for v in range(VALUES)]
    spark.createDataFrame(flat, "part int, value int, vector array<double>").coalesce(1).write.parquet(f"{path}/books")
    return load(spark, path, metric, id)


def load(spark: SparkSession, path: str, metric: str = "cosine", id: str = "point_id") -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    books = spark.read.parquet(f"{path}/books").orderBy("part", "value").toArrow()
    if not cells.num_rows:
        return Index(path, metric, id, np.zeros((0, 0)), np.zeros(0), np.zeros((0, VALUES, 0)))
    vectors, values = (np.array(t["vector"].to_pylist(), float) for t in (cells, books))
    return Index(path, metric, id, vectors, cells["radius"].to_numpy(), values.reshape(-1, VALUES, values.shape[1]))


def _to_cells(index: Index, queries: np.ndarray) -> np.ndarray:
    """How well each centroid scores for each query; cells without rows last."""
    dots = queries @ index.centroids.T
    if index.metric == "euclid":
        dots = 2 * dots - (index.centroids**2).sum(axis=1)
    return np.where(index.radius >= 0, dots, -np.inf)


def _bounds(index: Index, queries: np.ndarray) -> np.ndarray:
    """The best score that a row of each cell can have for each query."""
    dots, length = queries @ index.centroids.T, np.sqrt((queries * queries).sum(axis=1))
    if index.metric == "euclid":
        apart = np.sqrt(np.maximum((length**2)[:, None] + (index.centroids**2).sum(axis=1) - 2 * dots, 0))
        return -np.maximum(apart - index.radius, 0)
    return dots + length[:, None] * index.radius


def _passed(spark: SparkSession, index: Index, asked: pa.Table, queries: np.ndarray, wanted: np.ndarray, k: int, coded: bool) -> DataFrame:
    """q, id, cell, score of the k best a query in the cells it wants (a boolean matrix): by codes, or exactly."""
    lists, cells = index.lists(spark), np.flatnonzero(wanted.any(axis=0))
    if len(cells) <= NAMED:
        lists = lists.filter(F.col("cell").isin(cells.tolist()))
    by_cell = {c: np.flatnonzero(wanted[:, c]) for c in cells.tolist()}
    size = index.centroids.shape[1]
    exact = next((m for _, m in dense.by_length(asked["query_vector"].combine_chunks()) if m.shape[1] == size), np.zeros((0, size)))
    sent = spark.sparkContext.broadcast((index, queries, exact, by_cell))
    columns = [index.id, "cell", "code", "square"] if coded else [index.id, "cell", "embedding"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, queries, exact, by_cell = sent.value
        parts, _, width = index.books.shape
        tables = np.einsum("qpw,pvw->qpv", queries.reshape(len(queries), parts, width), index.books) if coded and len(queries) * parts * VALUES <= dense.MOST_COMPONENTS else None
        held, waiting, least = None, [], np.full(len(queries), -np.inf)  # least: the k-th score by codes of each query so far

        def kept() -> pa.Table:
            made = dense.best(pa.concat_tables([held, *waiting] if held else waiting), k, coded or METRICS[index.metric][1])
            waiting.clear()
            if coded:
                number = np.bincount(made["q"].to_numpy(), minlength=len(queries))
                full = number >= k
                least[full] = made["score"].to_numpy()[np.cumsum(number)[full] - 1]
            return made

        for batch in batches:
            own = batch.column(1).to_numpy()
            for c in np.unique(own).tolist():
                rows, q = np.flatnonzero(own == c), by_cell.get(c, ())
                if not len(q):
                    continue
                part = batch.take(pa.array(rows))
                if coded:
                    found = _by_codes(index, part, c, queries, q, tables, k, least)
                else:
                    usable = next((x for x in dense.by_length(part.column(2)) if x[1].shape[1] == exact.shape[1]), None)
                    found = dense.scored(index.metric, part.column(0).take(pa.array(usable[0])), usable[1], q, exact[q], k) if usable else ()
                for more in found:
                    waiting.append(more.append_column("cell", pa.array(np.full(more.num_rows, c, np.int64))))
                    if sum(t.num_rows for t in waiting) >= max(WAITING, held.num_rows if held else 0):
                        held = kept()
        if waiting:
            held = kept()
        if held:
            yield from held.select(["q", "id", "cell", "score"]).rename_columns(["q", index.id, "cell", "score"]).combine_chunks().to_batches()

    return lists.select(columns).mapInArrow(walk, f"q long, `{index.id}` {dict(lists.dtypes)[index.id]}, cell long, score double")


def _by_codes(index: Index, part: pa.RecordBatch, cell: int, queries: np.ndarray, q: np.ndarray, tables: np.ndarray | None, k: int, least: np.ndarray) -> Iterator[pa.Table]:
    """Scores by the centroid and, for each part of a code, a look into the query's table: the k best of the cell that are not under least."""
    codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
    step = max(1, min(SCORED // max(1, part.num_rows), SCORED // (index.books.shape[0] * VALUES)))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        scores = np.repeat((queries[some] @ index.centroids[cell])[:, None], part.num_rows, axis=1)
        own = tables[some] if tables is not None else np.einsum("qpw,pvw->qpv", queries[some].reshape(len(some), index.books.shape[0], -1), index.books)
        for p in range(codes.shape[1]):
            scores += own[:, p, codes[:, p]]
        if index.metric == "euclid":
            scores = 2 * scores - part.column(3).to_numpy()
        kth = np.partition(scores, part.num_rows - k, axis=1)[:, part.num_rows - k] if part.num_rows > k else -np.inf
        i, j = np.nonzero(scores >= np.maximum(least[some], kth)[:, None])
        yield pa.table({"q": some[i], "id": part.column(0).take(pa.array(j)), "score": scores[i, j]})


def search(index: Index, queries: DataFrame, k: int, probes: int | None = 8, depth: int | None = None, query_id: str = "query_id") -> DataFrame:
    """query_id, id, score, rank of the k best a query (query_id, query_vector): of `probes` cells by codes, `depth` (10 k) rescored; probes=None: exactly.

    Queries are sent to the lists, dense.MOST_QUERIES and HELD rows to be found at most a pass; larger sets go block by block, each over
    the cells it wants, and what the blocks found by codes is rescored together."""
    spark, size = queries.sparkSession, index.centroids.shape[1]
    asked = queries.select(query_id, "query_vector").filter((F.size("query_vector") == size) & dense.usable("query_vector"))
    depth = k if probes is None else depth or 10 * k
    n = asked.count()
    blocks = max(1, -(-n // min(dense.MOST_QUERIES, max(1, HELD // depth), max(1, dense.MOST_COMPONENTS // max(size, len(index.centroids), 1)))))
    out = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        found = _searched(spark, index, block.toArrow(), k, probes, depth, query_id)
        out = found if out is None else out.unionByName(found)
    if probes is None:
        return out
    few = F.broadcast(asked) if n <= dense.MOST_QUERIES and n * size <= dense.MOST_COMPONENTS else asked
    met = out.join(index.lists(spark).select(index.id, "cell", "embedding"), [index.id, "cell"]).join(few, query_id)
    scores = met.select(query_id, index.id, METRICS[index.metric][0](F.col("embedding"), F.col("query_vector")).alias("score"))
    return dense.ranked(scores, k, higher=METRICS[index.metric][1], id=index.id, query_id=query_id)


def _block(index: Index, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The queries' vectors as the index has them, and each one's cells in order."""
    raw = next((m for _, m in dense.by_length(asked["query_vector"].combine_chunks())), None) if asked.num_rows else None
    queries = np.zeros((0, index.centroids.shape[1])) if raw is None else _unit(raw) if index.metric == "cosine" else raw
    return queries, np.argsort(-_to_cells(index, queries), axis=1, kind="stable")


def _first(index: Index, order: np.ndarray, probes: int) -> np.ndarray:
    wanted = np.zeros(order.shape, bool)
    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
    return wanted & (index.radius >= 0)


def _exact(spark: SparkSession, index: Index, asked: pa.Table, k: int) -> DataFrame:
    """q, id, cell, score, rank of the k best of all rows."""
    (queries, order), higher = _block(index, asked), METRICS[index.metric][1]
    first = _first(index, order, 1)
    found = written(dense.ranked(_passed(spark, index, asked, queries, first, k, False), k, higher, index.id, "q"), "ann-first")
    kth = found.filter(F.col("rank") == k).select("q", "score").toArrow()
    reach = np.full(len(queries), -np.inf)
    reach[kth["q"].to_numpy()] = kth["score"].to_numpy() * (1 if higher else -1)
    room = 1e-9 * (1 + np.abs(np.nan_to_num(reach, neginf=0)))
    more = (_bounds(index, queries) >= (reach - room)[:, None]) & ~first & (index.radius >= 0)
    return dense.ranked(found.drop("rank").unionByName(_passed(spark, index, asked, queries, more, k, False)), k, higher, index.id, "q")


def _searched(spark: SparkSession, index: Index, asked: pa.Table, k: int, probes: int | None, depth: int, query_id: str) -> DataFrame:
    """Exactly: query_id, id, score, rank. By codes: query_id, id, cell of the `depth` best."""
    numbers = pa.table({"q": pa.array(range(asked.num_rows), pa.int64()), query_id: asked[query_id], "query_vector": asked["query_vector"]})
    named = F.broadcast(spark.createDataFrame(numbers))
    if probes is None:
        return _exact(spark, index, asked, k).join(named, "q").select(query_id, index.id, "score", "rank")
    queries, order = _block(index, asked)
    near = dense.ranked(_passed(spark, index, asked, queries, _first(index, order, probes), depth, True), depth, True, index.id, "q").select("q", index.id, "cell")
    return near.join(named.drop("query_vector"), "q").select(query_id, index.id, "cell")


def tuned(index: Index, queries: DataFrame, k: int, recall: float = 0.95, most: int = 100, query_id: str = "query_id") -> tuple[int, int]:
    """probes and depth that find this share of the true neighbours of a sample of queries (`most`, by a hash of the id): how far
    down the cells, then how far down the scores by codes, the exact search's rows stand."""
    spark = queries.sparkSession
    asked = queries.select(query_id, "query_vector").filter((F.size("query_vector") == index.centroids.shape[1]) & dense.usable("query_vector")).orderBy(F.xxhash64(F.lit("tune"), query_id), query_id).limit(most).toArrow()
    if not asked.num_rows or not len(index.centroids):
        return 1, k
    each = 1 - (1 - recall) / 2
    true = _exact(spark, index, asked, k).select("q", index.id, "cell").toArrow()
    queries_, order = _block(index, asked)
    place = np.argsort(order, axis=1)
    at = np.sort(place[true["q"].to_numpy(), true["cell"].to_numpy()])
    probes = int(at[min(len(at) - 1, int(np.ceil(each * len(at))))]) + 1 if len(at) else 1
    deep = max(10 * k, 2_000)
    coded = dense.ranked(_passed(spark, index, asked, queries_, _first(index, order, probes), deep, True), deep, True, index.id, "q")
    ranks = coded.join(F.broadcast(spark.createDataFrame(true).select("q", index.id)), ["q", index.id]).select("rank").toArrow()["rank"].to_numpy()
    ranks = np.sort(np.append(ranks, [deep] * (len(at) - len(ranks))))
    return probes, max(k, int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]))
