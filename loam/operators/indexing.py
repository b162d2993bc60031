"""From chunks to stored rows: row builder, embedding by routed model, outcome log, dead letters and retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import identity
from loam.functions.filters import routed
from loam.operators.telemetry import kind_of


def chunk_rows(chunks: DataFrame, documents: DataFrame, model: str, version: str, strategy: str, chunk_size: int, overlap: int, tenant: str | None = None) -> DataFrame:
    """The rows that are stored, a chunk each. chunks: as chunking.chunked makes them; documents: doc_id, source, text, metadata (map).

    Chunks meet their document by doc_id; only the document's hash crosses that join, not its text."""
    owner = F.lit(tenant).cast("string")
    about = documents.select("doc_id", identity.document_id(F.col("source"), owner).alias("document_id"), identity.normalise_source(F.col("source")).alias("source_uri"), identity.content_hash(F.col("text")).alias("content_hash"), "metadata")
    id = identity.chunk_id(F.col("document_id"), F.col("chunk_index"), identity.chunker_hash(strategy, chunk_size, overlap))
    constants = {"chunker_strategy": strategy, "embedding_model": model, "embedding_model_version": version}
    return chunks.join(about, "doc_id").select(id.alias("chunk_id"), "document_id", "source_uri", "content_hash", "text", F.struct("start", "end").alias("span"), "chunk_index", "token_count", *[F.lit(v).alias(k) for k, v in constants.items()], "section", owner.alias("tenant"), "metadata")


def embedded(rows: DataFrame, rules: list[tuple[dict, str]], default: str, embed: Callable[[str, list[str]], list[list[float]]], size: int = 64, attempts: int = 3, base_ms: int = 100, most_ms: int = 5_000) -> DataFrame:
    """rows with model, vector, error and attempts. The first rule that a row fits names its model; a task's rows go to
    embed(model, texts) by model, `size` at a time, without a shuffle. A call that fails is made again, up to `attempts` times
    and after a wait that doubles from base_ms up to most_ms, unless telemetry.kind_of calls the error fatal; then its rows have a null
    vector and the error's text, and belong to the dead letters with the attempts made. Waits hold up a task; streaming.stateful.retrying does not wait."""
    routed_rows = rows.withColumn("model", routed(rules, default))
    text_at = routed_rows.columns.index("text")

    def tried(model: str, texts: list[str]) -> tuple[list, str | None, int]:
        for attempt in range(1, attempts + 1):
            try:
                return embed(model, texts), None, attempt
            except Exception as e:  # noqa: BLE001 - whatever an embedder raises is the rows' outcome
                error = str(e) or type(e).__name__
                if kind_of(e) == "fatal" or attempt == attempts:
                    return [None] * len(texts), error, attempt
                time.sleep(min(base_ms * 2 ** (attempt - 1), most_ms) / 1000)
        raise ValueError("at least one attempt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("model")
            for model in pc.unique(models).to_pylist():
                own = batch.filter(pc.equal(models, model))
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    vectors, error, n = tried(model, [t or "" for t in part.column(text_at).to_pylist()])
                    more = [pa.array(vectors, pa.list_(pa.float64())), pa.array([error] * part.num_rows, pa.string()), pa.array([n] * part.num_rows, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "vector", "error", "attempts"])

    return routed_rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in routed_rows.dtypes) + ", vector array<double>, error string, attempts int")


def outcomes(log: DataFrame) -> DataFrame:
    """job_id, source, status, error, seq: what the log (the same columns) says last of each document of a job."""
    last = log.groupBy("job_id", "source").agg(F.max_by(F.struct("status", "error", "seq"), F.struct("seq", "status")).alias("last"))
    return last.select("job_id", "source", "last.*")


def dead_letters(log: DataFrame, job_id: str | None = None) -> DataFrame:
    """The documents, of one job or of all, whose last outcome is dead_lettered."""
    last = outcomes(log if job_id is None else log.filter(F.col("job_id") == job_id))
    return last.filter("status = 'dead_lettered'").drop("status")


def retried(log: DataFrame, job_id: str, new_job: str) -> DataFrame:
    """The log's first rows of a job that takes up another job's dead letters."""
    return dead_letters(log, job_id).select(F.lit(new_job).alias("job_id"), "source", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("seq"))
