"""Streams whose state lives by the clock, over restarts."""

import time

import pytest

from loam.operators import indexing, telemetry
from loam.streaming import pipeline, stateful


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def until(spark, made, folder, done, seconds=60):
    """Runs a stream into folder until done(its rows); the rows."""
    query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(processingTime="0 seconds").start()
    rows, end = [], time.time() + seconds
    try:
        while not done(rows) and time.time() < end and query.isActive:
            time.sleep(0.5)
            rows = spark.read.schema(made.schema).parquet(f"{folder}/out").collect() if (query.lastProgress or {}).get("batchId", 0) else []
    finally:
        query.stop()
    assert done(rows), (query.exception(), rows)
    return rows


def test_first_jobs_over_a_restart(rocks, tmp_path):
    def add(rows):
        rocks.createDataFrame(rows, "key string, job string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    add([("a", "j2"), ("a", "j1"), ("b", "j3"), (None, "j4"), (None, "j4")])
    made = stateful.first_jobs(rocks.readStream.schema("key string, job string").parquet(f"{tmp_path}/in"), 3_600_000)
    first = {(r.key, r.job, r.first, r.repeated) for r in until(rocks, made, tmp_path, lambda rows: len(rows) == 5)}
    assert first == {("a", "j1", "j1", False), ("a", "j2", "j1", True), ("b", "j3", "j3", False), (None, "j4", "j4", False)}
    add([("a", "j9"), ("c", "j8"), ("b", "j3")])  # asked again, and late
    again = {(r.key, r.job, r.first, r.repeated) for r in until(rocks, made, tmp_path, lambda rows: len(rows) == 8)} - first
    assert again == {("a", "j9", "j1", True), ("c", "j8", "j8", False), ("b", "j3", "j3", True)}


def test_first_jobs_are_forgotten(rocks, tmp_path):
    schema = "key string, job string"
    rocks.createDataFrame([("a", "j1")], schema).write.parquet(f"{tmp_path}/in")
    made = stateful.first_jobs(rocks.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1_000)
    until(rocks, made, tmp_path, lambda rows: len(rows) == 1)
    time.sleep(1.5)
    rocks.createDataFrame([("a", "j2")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert {(r.job, r.first) for r in until(rocks, made, tmp_path, lambda rows: len(rows) == 2)} == {("j1", "j1"), ("j2", "j2")}


def test_retries(rocks, tmp_path):
    folder = str(tmp_path / "tries")

    def work(payload):
        import os

        os.makedirs(folder, exist_ok=True)
        n = sum(f.startswith(f"{payload}-") for f in os.listdir(folder)) + 1
        open(f"{folder}/{payload}-{n}", "w").close()
        if payload == "wrong":
            raise ValueError("no such model")
        if payload == "down" or (payload == "late" and n < 3):
            raise ConnectionError("gone")
        return payload.upper()

    rocks.createDataFrame([("1", "fine"), ("2", "late"), ("3", "wrong"), ("4", "down")], "id string, payload string").coalesce(1).write.parquet(f"{tmp_path}/in")
    made = stateful.retrying(rocks.readStream.schema("id string, payload string").parquet(f"{tmp_path}/in"), work, attempts=3, base_ms=400)
    until(rocks, made, tmp_path, lambda rows: len(rows) >= 4)  # stopped while two wait
    rows = until(rocks, made, tmp_path, lambda rows: sum(r.status != "waiting" for r in rows) == 4)
    ended = {r.id: (r.status, r.result, r.error, r.attempts) for r in rows if r.status != "waiting"}
    assert ended == {"1": ("indexed", "FINE", None, 1), "2": ("indexed", "LATE", None, 3), "3": ("dead_lettered", None, "no such model", 1), "4": ("dead_lettered", None, "gone", 3)}
    assert sorted((r.id, r.attempts) for r in rows if r.status == "waiting") == [("2", 1), ("2", 2), ("4", 1), ("4", 2)]


def test_delays():
    assert [stateful.delay_ms("x", n, 100, 1000) <= min(100 * 2 ** (n - 1), 1000) for n in range(1, 8)] == [True] * 7
    assert all(50 <= stateful.delay_ms(str(i), 1, 100) <= 100 for i in range(50)) and len({stateful.delay_ms(str(i), 1, 100) for i in range(50)}) > 20


class Refused(Exception):
    def __init__(self, status):
        super().__init__(str(status))
        self.status = status


@pytest.mark.parametrize("error,kind", [(TimeoutError(), "timeout"), (ConnectionError(), "retryable"), (ValueError(), "fatal"), *[(Refused(s), k) for s, k in ((401, "fatal"), (403, "fatal"), (404, "fatal"), (408, "timeout"), (504, "timeout"), (429, "retryable"), (503, "retryable"))]])
def test_kinds(error, kind):
    assert telemetry.kind_of(error) == kind


def test_embedding_stops_at_what_cannot_pass(spark, tmp_path):
    def embed(model, texts):
        raise ValueError("no key")

    rows = spark.createDataFrame([(i, "t") for i in range(5)], "doc_id long, text string").coalesce(1)
    began = time.time()
    out = indexing.embedded(rows, [], "m", embed, attempts=5, base_ms=60_000).collect()
    assert {(r.error, r.attempts) for r in out} == {("no key", 1)} and time.time() - began < 30
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def late(model, texts):
        raise TimeoutError("slow")

    pipeline.ingest(stream, lambda b: indexing.embedded(b, [], "m", late, attempts=2, base_ms=1), f"{tmp_path}/out", f"{tmp_path}/dlq", f"{tmp_path}/cp").awaitTermination()
    assert {(r.error, r.attempts) for r in spark.read.parquet(f"{tmp_path}/dlq").collect()} == {("slow", 2)}


def test_once_within_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:00:10")], "key string, at string").selectExpr("key", "timestamp(at) AS at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = pipeline.once(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "key", "at", "1 hour")
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
