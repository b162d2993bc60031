"""Archives, snapshots, backups and names by hand-computed cases."""

import glob

import pytest
from pyspark.sql import functions as F

from loam.operators import caches, context, indexing, lifecycle


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame([("d1", "x"), ("d1", "again"), ("d2", "y")], "document_id string, source string")
    chunks = spark.createDataFrame([("c1", "d1", "one"), ("c2", "d2", "two")], "chunk_id string, document_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0])], "chunk_id string, vector array<double>")
    return docs, chunks, vectors


MADE_BY = {"model": "m", "version": "1", "dimensions": "1"}


def test_archive_import(spark, parts, tmp_path):
    path = str(tmp_path / "a")
    lifecycle.export_archive(*parts, path, embedding=MADE_BY)
    assert rows_of(lifecycle.import_archive(spark, path, MADE_BY).select("chunk_id", "document_id", "vector")) == [("c1", "d1", [1.0]), ("c2", "d2", [2.0])]
    assert lifecycle.open_archive(spark, path)["documents"].count() == 2
    with pytest.raises(ValueError, match="differ in version"):
        lifecycle.import_archive(spark, path, MADE_BY | {"version": "2"})
    again = lifecycle.import_archive(spark, path, {}, lambda c: c.withColumn("vector", F.array(F.length("text").cast("double"))))
    assert rows_of(again.select("chunk_id", "vector")) == [("c1", [3.0]), ("c2", [3.0])]


def test_archive_refuses(spark, parts, tmp_path):
    docs, chunks, vectors = parts
    lifecycle.export_archive(docs, chunks, None, str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="no vectors"):
        lifecycle.import_archive(spark, str(tmp_path / "plain"), MADE_BY)
    lifecycle.export_archive(docs, chunks, vectors.filter("chunk_id = 'c1'"), str(tmp_path / "short"), embedding=MADE_BY)
    with pytest.raises(ValueError, match="no vector"):
        lifecycle.import_archive(spark, str(tmp_path / "short"), MADE_BY)
    lifecycle.export_archive(docs.filter("document_id = 'd1'"), chunks, None, str(tmp_path / "orphans"))
    with pytest.raises(ValueError, match="does not hold"):
        lifecycle.open_archive(spark, str(tmp_path / "orphans"))
    lifecycle.export_archive(docs, chunks, None, str(tmp_path / "major"), version="2.0")
    with pytest.raises(ValueError, match="not supported"):
        lifecycle.open_archive(spark, str(tmp_path / "major"))
    torn = next(f for f in glob.glob(str(tmp_path / "plain" / "chunks" / "*.json")) if open(f).read())
    with open(torn, "a") as f:
        f.write('{"chunk_id":"c9","document_id":"d1","text":"slipped in"}\n')
    for crc in glob.glob(str(tmp_path / "plain" / "chunks" / ".*.crc")):
        open(crc, "w").close()
    with pytest.raises(Exception, match="changed|[Cc]hecksum"):
        lifecycle.open_archive(spark, str(tmp_path / "plain"))


def test_snapshots_and_backups(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.range(5)
    assert lifecycle.snapshots(spark, path) == []
    lifecycle.snapshot(df, path, "a")
    lifecycle.snapshot(df.limit(2), path, "b")
    (tmp_path / "s" / "half").mkdir()  # a write that did not end
    assert lifecycle.snapshots(spark, path) == ["a", "b"]
    assert lifecycle.restore(spark, path, "b").count() == 2
    assert lifecycle.delete_snapshot(spark, path, "a") and not lifecycle.delete_snapshot(spark, path, "a")
    assert lifecycle.snapshots(spark, path) == ["b"]
    with pytest.raises(Exception, match="already exists"):
        lifecycle.snapshot(df, path, "b")
    lifecycle.back_up({"points": df, "names": df.limit(0)}, path, "all")
    tables, wrong = lifecycle.restored(spark, path, "all")
    assert wrong == {} and tables["points"].count() == 5 and tables["names"].count() == 0
    df.limit(1).write.mode("append").parquet(f"{path}/all/points")
    assert lifecycle.restored(spark, path, "all")[1] == {"points": (5, 6)}


def test_names(spark):
    aliases = spark.createDataFrame([("x", "old"), ("y", "old"), ("z", "new")], "alias string, collection string")
    collections = spark.createDataFrame([("old",), ("new",)], "name string")
    changes = spark.createDataFrame([("x", "new"), ("y", None), ("old", "new"), ("w", "nowhere")], "alias string, collection string")
    after, judged = lifecycle.pointed(aliases, collections, changes)
    assert rows_of(after) == [("x", "new"), ("z", "new")]
    assert {r.alias: r.verdict for r in judged.collect()} == {"x": "set", "y": "deleted", "old": "conflict", "w": "missing"}
    left = lifecycle.dropped(collections, aliases, spark.createDataFrame([("old",)], "name string"))
    assert rows_of(left[0]) == [("new",)] and rows_of(left[1]) == [("z", "new")]
    first = lifecycle.rolled_back(spark.createDataFrame([("n", "n-v20240101000000")], aliases.schema), spark.createDataFrame([("n-v20240101000000",), ("n-x",)], "name string"))
    assert [r.restored for r in first.collect()] == [None]


def test_embedding_outcomes(spark):
    rows = spark.createDataFrame([(i, "t" * i, "a" if i % 2 else "b") for i in range(1, 8)], "id int, text string, kind string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def embed(model, texts):
        calls.add(1)
        if model == "slow":
            raise TimeoutError
        return [[float(len(t))] for t in texts]

    out = {r.id: r for r in indexing.embedded(rows, [({"kind": "b"}, "slow")], "fast", embed, size=2, attempts=3).collect()}
    assert [out[i].vector for i in (1, 2, 3)] == [[1.0], None, [3.0]]
    assert out[2].error == "TimeoutError" and out[2].attempts == 3 and out[1].error is None
    assert calls.value == 2 + 2 * 3
    assert indexing.embedded(rows.limit(0), [], "fast", embed).count() == 0


def test_caches_and_answers(spark):
    entries = spark.createDataFrame([("sem:-:q", "r", 0.0, 1.0), ("emb:m:1:h", "v", 0.0, 1.0)], "key string, response string, deadline double, last_used double")
    assert [r.key for r in caches.invalidated(entries, "sem").collect()] == ["emb:m:1:h"]
    failed = spark.createDataFrame([(None, False, True, "c")], "generated string, retryable boolean, reranked boolean, context string")
    rows = failed.unionByName(spark.createDataFrame([("said", False, True, "c"), (None, True, False, "c"), (None, None, False, "c")], failed.schema))
    assert rows_of(context.answered(rows).select("mode", "answer")) == [("extractive", "c"), ("failed", None), ("failed", None), ("full", "said")]  # one failure ends no other
