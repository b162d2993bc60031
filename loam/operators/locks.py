"""Index locks: what produced an index, and which documents are in it, stored so that drift costs what has changed.

A lock is a folder: `fields` (name, value as JSON), `documents` (document_id, content_hash, by the first two digits of the
id's hash) and `ranges`, a tree of digests over ranges of that hash. A range's digest is its number of documents with the
sum and the exclusive or of their hashes, so it adds up from parts of a range in any order, and a parent from its children.
Drift walks the tree from its root: a range whose digests agree is not looked into, and of the stored documents only the
folders of ranges that differ are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.lifecycle import drift

#: Digits of the id's hash that name a folder, and a range: at most 16 ** DIGITS ranges, whatever the corpus.
FOLDER, DIGITS = 2, 3
VERSION = 1
#: What is compared always; what only if the live value is known.
COMPARED = ("identity_version", "config_hash", "chunker_strategy", "chunk_size", "overlap", "contextual_enrichment")
IF_KNOWN = ("embedding_model", "embedding_model_version")


def _range(id: Column) -> Column:
    return F.substring(F.sha2(id, 256), 1, DIGITS)


def _number(hash: Column, start: int) -> Column:
    return F.conv(F.substring(hash, start, 15), 16, 10).cast("long")


def _digests(documents: DataFrame) -> DataFrame:
    """prefix, n, total, mixed of every range that has documents. A task hands on one row a range."""
    hash = F.sha2(F.concat(F.coalesce("document_id", F.lit("")), F.lit("\0"), F.coalesce("content_hash", F.lit("\1"))), 256)
    rows = documents.select(_range(F.coalesce("document_id", F.lit(""))).alias("prefix"), hash.alias("h"))
    return rows.groupBy("prefix").agg(F.count("*").alias("n"), F.sum(_number(F.col("h"), 1).cast("decimal(38,0)")).alias("total"), F.bit_xor(_number(F.col("h"), 16)).alias("mixed"))


def _level(digests: DataFrame, digits: int) -> DataFrame:
    parent = digests.groupBy(F.substring("prefix", 1, digits).alias("prefix"))
    return parent.agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed"))


def _tree(digests: DataFrame) -> DataFrame:
    out = digests
    for digits in range(DIGITS):
        out = out.unionByName(_level(digests, digits))
    return out


def write(documents: DataFrame, path: str, **fields) -> None:
    """Stores the lock of documents (document_id, content_hash; an id once) at a path, over one that is there."""
    spark = documents.sparkSession
    rows = documents.select("document_id", "content_hash").withColumn("folder", F.substring(_range(F.coalesce("document_id", F.lit(""))), 1, FOLDER))
    rows.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/documents")
    _tree(_digests(documents)).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    named = [(k, json.dumps(v)) for k, v in ({"lock_version": VERSION} | fields).items()]
    spark.createDataFrame(named, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")  # last: a lock without fields is none


def read_fields(spark: SparkSession, path: str) -> tuple[dict | None, str]:
    """The fields of the lock at a path, and what became of it: found, missing, or malformed (unreadable, or of another version)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/fields")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None, "missing"
    try:
        found = {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").parquet(f"{path}/fields").collect()}
    except Exception:  # noqa: BLE001 - whatever cannot be read is malformed
        return None, "malformed"
    return (found, "found") if found.get("lock_version") == VERSION else (None, "malformed")


@dataclass(frozen=True)
class Drift:
    """state: found, missing or malformed. fields: name, (locked, live). documents: document_id, change; None where there is nothing to compare."""

    state: str
    fields: dict[str, tuple]
    documents: DataFrame | None
    ranges: list[str]

    @property
    def detected(self) -> bool:
        return bool(self.fields) or bool(self.ranges)


def detect(documents: DataFrame | None, path: str, **live) -> Drift:
    """How live documents and settings differ from the lock at a path. A lock that is missing is no drift; a malformed one is reported as such."""
    spark = documents.sparkSession if documents is not None else SparkSession.getActiveSession()
    locked, state = read_fields(spark, path)
    if locked is None:
        return Drift(state, {}, None, [])
    names = [*COMPARED, *[n for n in IF_KNOWN if live.get(n) is not None]]
    fields = {n: (locked.get(n), live.get(n)) for n in names if (n in locked or n in live) and locked.get(n) != live.get(n)}
    if documents is None:
        return Drift(state, fields, None, [])
    ranges = _differing(spark.read.parquet(f"{path}/ranges"), _tree(_digests(documents)))
    inside = lambda id: _range(F.coalesce(id, F.lit(""))).isin(ranges)
    kinds = "document_id string, content_hash string, folder string"
    stored = spark.read.schema(kinds).parquet(f"{path}/documents").filter(F.col("folder").isin(sorted({r[:FOLDER] for r in ranges})) & inside(F.col("document_id")))
    return Drift(state, fields, drift(stored, documents.filter(inside(F.col("document_id"))), "document_id", "content_hash"), ranges)


def _differing(stored: DataFrame, live: DataFrame) -> list[str]:
    """The ranges whose digests differ, below those of their parents that differ: 16 ** DIGITS rows at most."""
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.total").eqNullSafe(F.col("b.total")) & F.col("a.mixed").eqNullSafe(F.col("b.mixed"))
    met = stored.alias("a").join(live.alias("b"), "prefix", "full_outer").filter(~same).select("prefix").collect()
    found = {r["prefix"] for r in met}
    return sorted(p for p in found if len(p) == DIGITS and all(p[:k] in found for k in range(DIGITS)))
