"""Locks that are stored: field by field, range by range."""

from pyspark.sql import functions as F

from loam.operators import locks


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, content_hash string")


def test_drift_of_documents(spark, tmp_path):
    rows = [(f"d{i}", f"h{i}") for i in range(3000)]
    path = str(tmp_path / "lock")
    locks.write(docs(spark, rows), path, chunk_size=200)
    same = locks.detect(docs(spark, rows[::-1]), path, chunk_size=200)
    assert (same.state, same.fields, same.ranges, same.detected) == ("found", {}, [], False) and same.documents.count() == 0
    live = [(d, "new" if d == "d5" else h) for d, h in rows if d != "d9"] + [("e1", "x"), ("e2", None)]
    found = locks.detect(docs(spark, live), path, chunk_size=200)
    assert {tuple(r) for r in found.documents.collect()} == {("d5", "changed"), ("d9", "removed"), ("e1", "added"), ("e2", "added")}
    assert found.detected and len(found.ranges) == 4  # of 4096
    swapped = [("d1", "h2"), ("d2", "h1"), *rows[:1], *rows[3:]]
    assert {tuple(r) for r in locks.detect(docs(spark, swapped), path, chunk_size=200).documents.collect()} == {("d1", "changed"), ("d2", "changed")}
    read = found.documents._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read
    folders = {r.f for r in spark.read.parquet(f"{path}/documents").filter(F.col("folder").isin([x[:2] for x in found.ranges])).select(F.col("folder").alias("f")).distinct().collect()}
    assert len(folders) <= 4


def test_tree_adds_up(spark):
    made = {r.prefix: r for r in locks._tree(locks._digests(docs(spark, [(f"d{i}", "h") for i in range(500)] + [(None, "h"), ("n", None)]))).collect()}
    assert made[""].n == 502 and sum(r.n for p, r in made.items() if len(p) == 2) == 502
    for p, r in made.items():
        children = [c for q, c in made.items() if len(q) == len(p) + 1 and q.startswith(p)]
        if children:
            mixed = 0
            for c in children:
                mixed ^= c.mixed
            assert (r.n, r.total, r.mixed) == (sum(c.n for c in children), sum(c.total for c in children), mixed)


def test_drift_of_fields_and_locks_that_are_none(spark, tmp_path):
    path = str(tmp_path / "lock")
    none = locks.detect(docs(spark, []), path, chunk_size=1)
    assert (none.state, none.documents, none.detected) == ("missing", None, False)
    locks.write(docs(spark, []), path, chunk_size=200, overlap=20, embedding_model="m", contextual_enrichment=False)
    found = locks.detect(docs(spark, [("a", "h")]), path, chunk_size=100, overlap=20, contextual_enrichment=False)
    assert found.fields == {"chunk_size": (200, 100)} and [tuple(r) for r in found.documents.collect()] == [("a", "added")]
    assert locks.detect(docs(spark, []), path, chunk_size=200, overlap=20, contextual_enrichment=False, embedding_model="n").fields == {"embedding_model": ("m", "n")}
    assert locks.detect(None, path, chunk_size=200, overlap=20, contextual_enrichment=False).detected is False
    spark.createDataFrame([("lock_version", "99")], "name string, value string").write.mode("overwrite").parquet(f"{path}/fields")
    assert locks.detect(docs(spark, []), path).state == "malformed"
    spark.createDataFrame([("chunk_size", "{")], "name string, value string").write.mode("overwrite").parquet(f"{path}/fields")
    assert locks.detect(docs(spark, []), path).state == "malformed"
