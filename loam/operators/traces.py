"""Traces: what each question did, as rows of a table by days, kept for as long as the retention says.

A trace is written once an answer is out. The table is partitioned by the day of created_at, so that pruning deletes whole days and
reading the newest traces opens the newest days alone. A trace that is written again replaces the one before: readers take an id's latest.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.identity import visible_to

#: Sections of the settings that a trace keeps whole, and single settings of others.
WHOLE = ("chunking", "retrieval", "generation")
SINGLE = ("embeddings.provider", "embeddings.model", "embeddings.dimensions", "llm.provider", "llm.model", "llm.temperature", "llm.max_tokens")
#: What a trace keeps of each chunk; every leg's rank and score, so that a moved chunk can be explained.
CHUNK = ("chunk_id", "text", "source", "document_id", "dense_rank", "dense_score", "bm25_rank", "bm25_score", "rrf_score", "rerank_score", "final_rank")


def snapshot(settings: Column) -> Column:
    """The settings (a map of dotted keys) that bear on an answer."""
    return F.map_filter(settings, lambda k, _: F.split_part(k, F.lit("."), F.lit(1)).isin(*WHOLE) | k.isin(*SINGLE))


def timeline(steps: DataFrame) -> DataFrame:
    """trace_id, spans: the steps (trace_id, name, began, ended: timestamps) of each trace in the order in which they ended, in milliseconds from the trace's first start, so that all lie on one line."""
    ms = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1000
    grouped = steps.groupBy("trace_id").agg(F.min(ms("began")).alias("origin"), F.array_sort(F.collect_list(F.struct(ms("ended").alias("end_ms"), ms("began").alias("start_ms"), "name"))).alias("steps"))
    return grouped.select("trace_id", F.transform("steps", lambda s: F.struct(s["name"].alias("name"), (s["start_ms"] - F.col("origin")).alias("start_ms"), (s["end_ms"] - F.col("origin")).alias("end_ms"))).alias("spans"))


def recorded(questions: DataFrame, retrieved: DataFrame, steps: DataFrame) -> DataFrame:
    """A row a trace: questions (trace_id, query, collection, tenant, filters, settings, prompt, response, created_at) with config, retrieved, spans and day.

    retrieved: trace_id and the columns CHUNK, whose rows a query's depth bounds; missing ones are null. steps: as in timeline()."""
    there = set(retrieved.columns)
    chunk = F.struct("final_rank", F.struct(*[F.col(c) if c in there else F.lit(None).cast("string").alias(c) for c in CHUNK]).alias("chunk"))
    listed = retrieved.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["chunk"]).alias("retrieved"))
    rows = questions.join(listed, "trace_id", "left").join(timeline(steps), "trace_id", "left")
    return rows.withColumn("config", snapshot(F.col("settings"))).drop("settings").withColumn("day", F.to_date("created_at"))


def store(traces: DataFrame, path: str) -> None:
    """Appends traces, a folder a day. Rows of a day lie together by tenant and id, so that one is found by few row groups."""
    traces.repartitionByRange("day", "trace_id").sortWithinPartitions("day", "tenant", "trace_id").write.partitionBy("day").mode("append").parquet(path)


def _latest(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("trace_id").orderBy(F.desc("created_at"), F.xxhash64("query", "prompt", "response"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def kept(spark: SparkSession, path: str, now: datetime, days: int, tenant: str | None = None) -> DataFrame:
    """The latest of each trace no older than the retention, as far as a tenant sees them: another tenant's trace is absent, not refused."""
    since = now - timedelta(days=days)
    rows = spark.read.parquet(path)
    young = (F.col("day") >= F.lit(since.date())) & (F.col("created_at") >= F.lit(since.isoformat(sep=" ")).cast(rows.schema["created_at"].dataType))
    return _latest(rows.filter(young & visible_to(tenant, F.col("tenant"))))


def newest(spark: SparkSession, path: str, n: int, tenant: str | None = None) -> DataFrame:
    """The last n traces that a tenant sees, newest first. Days (as many as the retention has) are counted, and only as many of the newest
    are opened as hold n ids; as an id may stand in several days, more are opened until they do."""
    rows = spark.read.parquet(path).filter(visible_to(tenant, F.col("tenant")))
    days = rows.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day")).collect()
    if not days:
        return rows.limit(0)
    need = n
    while True:
        held = accumulate(d.n for d in days)
        last = next((i for i, sum_ in enumerate(held) if sum_ >= need), len(days) - 1)
        found = rows.filter(F.col("day") >= F.lit(days[last].day))
        if last == len(days) - 1 or found.select("trace_id").distinct().count() >= n:
            return _latest(found).orderBy(F.desc("created_at"), "trace_id").limit(n)
        need *= 2


def prune(spark: SparkSession, path: str, now: datetime, days: int) -> int:
    """Deletes the days that lie wholly before the retention, and says how many went. What is past it on its own first day goes a day later; kept() leaves it out till then."""
    first = (now - timedelta(days=days)).date().isoformat()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in system.listStatus(folder) if system.exists(folder) else ():
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < first and name[4:5].isdigit():
            gone += bool(system.delete(status.getPath(), True))
    return gone
