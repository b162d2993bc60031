"""Streams: ingest with upserts and dead letters, breakers and windowed telemetry on unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.telemetry import breaker_step


def ingest(stream: DataFrame, index: Callable[[DataFrame], DataFrame], target: str, dead_letters: str, checkpoint: str, failed: str = "error"):
    """Runs a stream of documents through `index` into Parquet at `target`, one folder a micro-batch, so that a batch that runs
    again replaces what it wrote; rows with an error go to dead_letters the same way, with the attempts that `index` made (its column attempts; 1
    if it has none). `index` runs once a batch: its rows are written aside first, so both outputs come from the same ones. Returns the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        aside = f"{target}/_indexed/batch={batch_id}"
        index(batch).write.mode("overwrite").parquet(aside)
        made = batch.sparkSession.read.parquet(aside)
        bad = F.col(failed).isNotNull()
        made.filter(~bad).drop(failed).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        made.filter(bad).select("doc_id", failed, F.col("attempts") if "attempts" in made.columns else F.lit(1).alias("attempts")).write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(target: DataFrame, id: str) -> DataFrame:
    """The rows of the last batch of each id of an ingested table (column batch)."""
    last = target.groupBy(id).agg(F.max("batch").alias("batch"))
    return target.join(last, [id, "batch"], "left_semi")


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose idempotency key has not come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, size: str, late: str, value: str, *by: str) -> DataFrame:
    """n and sum of a value by event-time window and key."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))


def breakers(stream: DataFrame, threshold: int, reset_seconds: int) -> DataFrame:
    """provider, ts, state of each call (provider, ts, outcome), with the breaker kept as state a provider."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        name, failures, opened = state.get if state.exists else ("closed", 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, outcome in zip(rows["ts"], rows["outcome"], strict=True):
            name, failures, opened, _ = breaker_step(name, failures, opened, int(ts.value // 1000), outcome, threshold, reset_seconds * 1_000_000)
            out.append((key[0], ts, name))
        state.update((name, failures, opened))
        yield pd.DataFrame(out, columns=["provider", "ts", "state"])

    return stream.groupBy("provider").applyInPandasWithState(step, "provider string, ts timestamp, state string", "name string, failures int, opened long", "append", "NoTimeout")
