"""Searches that leave out what a bound rules out: the same rows, and fewer pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions.vectors import cosine
from loam.operators import caches, keyword


def all_pairs(asked, entries, threshold):
    a, e = asked.select("asked_id", "tenant", F.col("embedding").alias("x")), entries.select("entry_id", F.col("tenant").alias("of"), F.col("embedding").alias("y"))
    near = a.join(e, F.col("tenant").eqNullSafe(F.col("of"))).select("asked_id", "entry_id", F.round(cosine(F.col("x"), F.col("y")), 9).alias("similarity")).filter(F.col("similarity") >= threshold)
    return near.groupBy("asked_id").agg(F.max("similarity").alias("similarity"), F.max_by("entry_id", F.struct("similarity", -F.col("entry_id"))).alias("entry_id"))


@pytest.fixture(scope="module")
def cache(spark):
    g = np.random.Generator(np.random.PCG64(9))
    centres = g.normal(size=(60, 24))
    near = lambda i: (centres[i % 60] * g.uniform(0.5, 2) + 0.1 * g.normal(size=24)).tolist()
    entries = [(i, f"t{i % 2}" if i % 7 else None, near(i)) for i in range(1500)] + [(2000, None, None), (2001, "t1", [0.0] * 24), (2002, "t1", [1.0, 2.0]), (2003, "t1", [1.0, None] * 12)]
    entries += [(3000 + i, "t1", entries[3][2]) for i in range(50)]
    asked = [(i, f"t{i % 2}" if i % 5 else None, near(i * 7)) for i in range(200)] + [(900, "t1", [0.0] * 24), (901, "t1", [1.0, 2.0]), (902, "t1", None), (903, "t1", entries[3][2]), (904, "none", near(1))]
    kinds = "tenant string, embedding array<double>"
    return spark.createDataFrame(asked, f"asked_id long, {kinds}").repartition(3), spark.createDataFrame(entries, f"entry_id long, {kinds}").repartition(4)


@pytest.mark.parametrize("threshold", [1.0, 0.99, 0.95, 0.7, 0.1, 0.0])
def test_semantic_lookup(cache, threshold):
    asked, entries = cache
    got, want = ({tuple(r) for r in f(asked, entries, threshold).select("asked_id", "similarity", "entry_id").collect()} for f in (caches.semantic_lookup, all_pairs))
    assert got == want and want
    assert caches.semantic_lookup(asked.limit(0), entries, threshold).count() == caches.semantic_lookup(asked, entries.limit(0), threshold).count() == 0


def test_few_pairs_are_scored(cache):
    asked, entries = cache
    met = caches._met_in_rings(asked, entries, 0.95)
    of_a_tenant = asked.alias("a").join(entries.alias("e"), F.col("a.tenant").eqNullSafe(F.col("e.tenant"))).count()
    assert met.count() <= 0.2 * of_a_tenant
    assert met.groupBy("asked_id", "entry_id").count().filter("count > 1").count() == 0  # no pair twice


def test_low_thresholds_meet_in_tiles(cache, monkeypatch):
    for name, value in (("TILE", 100), ("ASKED", 20), ("PAIRS", 50)):
        monkeypatch.setattr(caches, name, value)
    asked, entries = cache
    got, want = ({tuple(r) for r in f(asked, entries, 0.2).select("asked_id", "similarity", "entry_id").collect()} for f in (caches.semantic_lookup, all_pairs))
    assert got == want and want
    tiles = entries.filter("tenant = 't1'").count() // 100 + 1
    met = caches._met_in_tiles(asked, entries, 0.2)
    assert met.groupBy("asked_id").count().agg(F.max("count")).first()[0] <= 2 * tiles  # not a row a pair


@pytest.fixture(scope="module")
def posted(spark):
    r = random.Random(12)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}" for i in range(400)]
    texts = [(i, " ".join(r.choices(common, k=r.randint(0, 40)) + r.choices(rare, k=r.randint(0, 3)))) for i in range(3000)] + [(9000, None), (9001, "")]
    asked = [(q, " ".join(r.choices(rare, k=2) + r.choices(common, k=3))) for q in range(12)] + [(50, "common1"), (51, "nowhere"), (52, None), (53, "common1 common2 common3")]
    chunks = spark.createDataFrame(texts, "point_id long, text string")
    return keyword.postings(chunks, stems=False), keyword.query_terms(spark.createDataFrame(asked, "query_id long, text string"), False), chunks


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_stored_postings(spark, posted, tmp_path, k):
    rows, asked, chunks = posted
    keyword.store(rows, str(tmp_path / "p"), chunks.count())
    got = {tuple(r) for r in keyword.search_stored(spark, str(tmp_path / "p"), asked, chunks.count(), k).select("query_id", "point_id", "rank", "score").collect()}
    want = {tuple(r) for r in keyword.search(rows, asked, chunks.agg(F.count("*").alias("n")), k).select("query_id", "point_id", "rank", "score").collect()}
    assert got == want and want


def test_few_postings_are_scored(spark, posted, tmp_path, monkeypatch):
    rows, asked, chunks = posted
    keyword.store(rows, str(tmp_path / "p"), chunks.count())
    scored = []
    ranked = keyword.ranked
    monkeypatch.setattr(keyword, "ranked", lambda df, *a: scored.append(df) or ranked(df, *a))
    keyword.search_stored(spark, str(tmp_path / "p"), asked.filter("query_id < 12"), chunks.count(), 5).count()
    looked = sum(df.count() for df in scored[:2])
    everything = rows.join(asked.filter("query_id < 12"), "term").select("query_id", "point_id").distinct().count()
    assert looked <= 0.5 * everything, (looked, everything)


def test_a_stored_block_is_one_row_a_term_in_one_file(spark, posted, tmp_path):
    rows, _, chunks = posted
    keyword.store(rows, str(tmp_path / "p"), chunks.count())
    held = spark.read.parquet(str(tmp_path / "p" / "postings")).withColumn("file", F.input_file_name())
    assert held.groupBy("term", "block").count().agg(F.max("count")).first()[0] == 1
    assert held.groupBy("block").agg(F.count_distinct("file").alias("files")).agg(F.max("files")).first()[0] == 1
    assert held.select("term", F.inline("points")).join(rows, ["term", "point_id", "weight"]).count() == rows.count() == held.agg(F.sum("n")).first()[0]
