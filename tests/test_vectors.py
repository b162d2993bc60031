"""Dense search by matrices, the index of cells and codes, and late pooling, against plain versions."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.functions import vectors as V
from loam.operators import ann, chunking, dense, pooling
from loam.plans import catalogue, retrieval

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def plain(points, queries, k, metric):
    """Top k by the column expressions over all pairs."""
    score, higher = V.METRICS[metric]
    usable = lambda c: (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    met = points.filter(usable("embedding")).crossJoin(queries.filter(usable("query_vector"))).filter(F.size("embedding") == F.size("query_vector"))
    return dense.ranked(met.select("query_id", "point_id", score(F.col("embedding"), F.col("query_vector")).alias("score")), k, higher)


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, copies by the hundred, and rows that take no part."""
    g = np.random.Generator(np.random.PCG64(6))
    centres = g.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.15 * g.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(400)] + [(3000, None), (3001, []), (3002, [1.0, None] * 8), (3003, [float("nan")] * 16), (3004, [1.0] * 5), (3005, [0.0] * 16)]
    return spark.createDataFrame(rows, "point_id long, embedding array<double>").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(points):
    return points.filter("point_id % 100 = 7 OR point_id >= 3000").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_matrices_score_as_columns_do(points, queries, metric, monkeypatch):
    want = rows_of(plain(points, queries, 7, metric))
    assert rows_of(dense.nearest(points, queries, 7, metric)) == want
    monkeypatch.setattr(dense, "SCORES", 100)
    monkeypatch.setattr(dense, "MOST_QUERIES", 5)
    monkeypatch.setattr(dense, "TILE", 300)
    assert rows_of(dense.nearest(points, queries, 7, metric)) == want


def test_search_by_other_ids_and_nothing(spark, points, queries):
    named = points.select(F.concat(F.lit("p"), "point_id").alias("point_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    assert {r.point_id[0] for r in dense.nearest(named, queries, 3).collect()} == {"p"}
    assert rows_of(dense.nearest(points.limit(0), queries, 3)) == [] == rows_of(dense.nearest(points, queries.limit(0), 3))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_index(spark, points, queries, tmp_path, metric, monkeypatch):
    want = rows_of(plain(points, queries, 7, metric).filter("query_id != 3004"))
    index = ann.build(points, str(tmp_path / "index"), metric)
    lists = index.lists(spark)
    assert lists.count() == 1601 and lists.select("point_id").distinct().count() == 1601
    assert rows_of(ann.search(index, queries, 7, None)) == want
    found = ann.search(index, queries, 7, *ann.tuned(index, queries.filter("query_id < 600"), 7))
    pairs = {(q, p) for q, p, *_ in want if q != 3005}  # all rows are as near to a vector without direction
    assert len(pairs & {(r.query_id, r.point_id) for r in found.collect()}) >= 0.9 * len(pairs)
    again = ann.load(spark, str(tmp_path / "index"), metric)
    monkeypatch.setattr(dense, "MOST_QUERIES", 4)  # block by block
    assert rows_of(ann.search(again, queries, 7, None)) == want
    with pytest.raises(Exception, match="exist"):
        ann.build(points, str(tmp_path / "index"), metric)


def test_index_looks_into_few_rows(spark, tmp_path, monkeypatch):
    g = np.random.Generator(np.random.PCG64(7))
    centres = g.normal(size=(40, 16))
    rows = spark.createDataFrame([(i, (centres[i % 40] + 0.05 * g.normal(size=16)).tolist()) for i in range(4000)], "point_id long, embedding array<double>")
    asked = rows.filter("point_id % 400 = 3").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ann.build(rows, str(tmp_path / "index"))
    probes, depth = ann.tuned(index, asked, 10)
    seen, passed = [], ann._passed

    def counted(spark, index, asked, queries, wanted, k, coded):
        sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{index.path}/cells").collect()}
        seen.append(sum(sizes[c] for q in wanted for c in np.flatnonzero(q)) / len(queries))
        return passed(spark, index, asked, queries, wanted, k, coded)

    monkeypatch.setattr(ann, "_passed", counted)
    want = {(r.query_id, r.point_id) for r in dense.nearest(rows, asked, 10).collect()}
    got = {(r.query_id, r.point_id) for r in ann.search(index, asked, 10, probes, depth).collect()}
    assert len(want & got) >= 0.9 * len(want) and seen[-1] <= 0.25 * 4000
    seen.clear()
    assert {(r.query_id, r.point_id) for r in ann.search(index, asked, 10, None).collect()} == want and sum(seen) <= 0.5 * 4000


def test_index_of_nothing(spark, points, queries, tmp_path):
    index = ann.build(points.filter("point_id IN (3000, 3001, 3003)"), str(tmp_path / "none"))
    assert rows_of(ann.search(index, queries, 3)) == [] == rows_of(ann.search(index, queries, 3, None))
    one = ann.build(points.filter("point_id = 7"), str(tmp_path / "one"))
    assert {r.point_id for r in ann.search(one, queries, 3).collect()} == {7}


def test_approximate_query_recall(spark):
    want = {(r.query_id, r.point_id) for r in catalogue.QUERIES["dense_topk_cosine"](spark, SF).collect()}
    got = {(r.query_id, r.point_id) for r in catalogue.QUERIES["dense_topk_approximate"](spark, SF).collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert retrieval._asked(spark, SF).count() * 10 == len(got)


@pytest.mark.parametrize("total,size", [(0, 8), (5, 8), (8, 8), (9, 8), (100, 8), (7, 1), (50, 3)])
def test_windows(total, size):
    found = pooling.windows(total, size)
    assert found[0][0] == 0 and found[-1][1] == total and all(b - a <= size for a, b in found)
    assert all(a[1] >= b[0] and a[0] < b[0] for a, b in zip(found, found[1:])) and (len(found) == 1) == (total <= size)
    assert all(a[1] - b[0] >= size // 4 for a, b in zip(found, found[1:]))


def test_tokens_come_from_their_most_central_window():
    model = pooling.TokenModel(lambda t: [], lambda tokens: np.array([[len(tokens), i, int(t)] for i, t in enumerate(tokens)], float), 8)
    states = pooling.token_states(model, [str(i) for i in range(31)])
    assert states[:, 2].tolist() == list(range(31))
    for t, (n, i, _) in enumerate(states):
        best = max(min(t - a, b - 1 - t) for a, b in pooling.windows(31, 8) if a <= t < b)
        assert min(i, n - 1 - i) == best


def test_late_chunks(spark):
    r = random.Random(3)
    texts = [None, "", " \n ", "one", "!?", "word " * 400] + [" ".join(r.choice(["alpha", "beta", "gamma.", "d-e"]) for _ in range(r.randint(1, 900))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = chunking.chunked(docs, "late", 60, 10, pool=pooling.vectors_for(pooling.HASHED)).collect()
    bare = chunking.chunked(docs, "recursive", 60, 10).collect()
    assert [(x.doc_id, x.start, x.end, x.text) for x in made] == [(x.doc_id, x.start, x.end, x.text) for x in bare] and len(made) > 60
    for x in made:
        text = texts[x.doc_id]
        offsets = pooling.HASHED.offsets(text)
        states = pooling.token_states(pooling.HASHED, [text[a:b] for a, b in offsets])
        inside = [i for i, (a, b) in enumerate(offsets) if a < x.end and b > x.start] or list(range(len(offsets)))
        mean = states[inside].mean(axis=0)
        assert x.late_pooling and x.vector == pytest.approx((mean / math.sqrt((mean**2).sum())).tolist())
    assert {x.vector for x in chunking.chunked(docs, "late", 60, 10).collect()} == {None}


def test_stored_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, 5, [3.0, 0.0]), (1, 5, 9, [0.0, 4.0]), (1, 9, 9, [9.0, 9.0]), (1, 12, 13, None), (2, 0, 1, [0.0, 0.0]), (4, 3, 3, [1.0, 1.0])], "document long, start int, end int, vector array<double>")
    spans = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 4, 6), (1, "c", 50, 60), (2, "d", 0, 1), (3, "e", 0, 1), (4, "f", 0, 9)], "document long, span string, start int, end int")
    got = {r.span: r.vector for r in pooling.pooled_spans(spans, tokens).collect()}
    assert got == {"a": [1.0, 0.0], "b": pytest.approx([0.6, 0.8]), "c": pytest.approx([0.6, 0.8]), "d": [0.0, 0.0]}


def test_deep_searches_go_in_blocks(points, queries, tmp_path, monkeypatch):
    index = ann.build(points, str(tmp_path / "deep"))
    monkeypatch.setattr(dense, "SCORES", 1_000)
    want = rows_of(ann.search(index, queries, 7, 20, 300))
    passes, passed = [], ann._passed
    monkeypatch.setattr(ann, "_passed", lambda *a: passes.append(len(a[3])) or passed(*a))
    for name, value in (("HELD", 1_200), ("WAITING", 100), ("SCORED", 500)):
        monkeypatch.setattr(ann, name, value)
    assert rows_of(ann.search(index, queries, 7, 20, 300)) == want and want
    assert len(passes) > 1 and max(passes) <= 12  # a task holds 1,200 rows, save for uneven blocks


def test_later_points_must_reach_the_kth_score():
    g = np.random.Generator(np.random.PCG64(3))
    points, queries = g.normal(size=(4000, 8)), g.normal(size=(30, 8))
    asked = pa.table({"query_id": list(range(30)), "query_vector": pa.array(list(queries), pa.list_(pa.float64()))})
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(list(points[i : i + 100]), pa.list_(pa.float64()))], names=["id", "embedding"]) for i in range(0, 4000, 100)]
    for metric in ("cosine", "dot", "euclid"):
        pairs, exact = [], dense.in_order
        with pytest.MonkeyPatch.context() as m:
            m.setattr(dense, "in_order", lambda metric, a, b: pairs.append(len(a)) or exact(metric, a, b))
            found = pa.Table.from_batches(dense._searched(iter(batches), asked, 5, metric))
        assert sum(pairs) < 0.4 * 40 * 30 * 5  # without a bar, five of each block a query
        whole = exact(metric, np.repeat(points, 30, axis=0), np.tile(queries, (4000, 1))).reshape(4000, 30)
        best = np.argsort(whole if metric == "euclid" else -whole, axis=0, kind="stable")[:5]
        assert {(q, p) for q in range(30) for p in best[:, q].tolist()} == set(zip(found["query_id"].to_pylist(), found["id"].to_pylist()))
