"""Writing and comparing tables: upserts, merges, deletes, dedup, drift, diffs, archives, aliases, snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.identity import visible_to


def _one_of_each(new: DataFrame, *ids: str) -> DataFrame:
    if "seq" not in new.columns:
        return new.dropDuplicates(list(ids))
    return new.withColumn("_rn", F.row_number().over(W.partitionBy(*ids).orderBy(F.desc("seq")))).filter("_rn = 1").drop("_rn", "seq")


def upserted(stored: DataFrame, new: DataFrame, *ids: str) -> DataFrame:
    """stored with rows of new in place of rows of the same ids; running it again changes nothing. Of several new rows of an id the last written (column seq, if there is one) stays, else any one. A null id is an id like others."""
    new = _one_of_each(new, *ids)
    names = [f"_new_{i}" for i in ids]
    same = [F.col(i).eqNullSafe(F.col(n)) for i, n in zip(ids, names, strict=True)]
    return stored.join(new.select(*[F.col(i).alias(n) for i, n in zip(ids, names, strict=True)]), same, "left_anti").unionByName(new.select(*stored.columns))


def replaced_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with all chunks of the new documents replaced, so that a document that shrinks leaves nothing behind."""
    return stored.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def merged(stored: DataFrame, updates: DataFrame, id: str, payload: str = "payload") -> DataFrame:
    """stored with the updates' keys put over the payload's (maps); other columns stay. Of several updates of an id the last written (column seq, if there is one) counts, else any one."""
    u = _one_of_each(updates, id).select(id, F.col(payload).alias("_new"))
    kept = F.map_filter(F.col(payload), lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    return stored.join(u, id, "left").withColumn(payload, F.when(F.col("_new").isNull(), F.col(payload)).otherwise(F.map_concat(kept, "_new"))).select(*stored.columns)


def deleted(stored: DataFrame, where: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """stored without the rows of a filter or of ids; one of them must be given, and a filter without conditions is refused."""
    if where is None and ids is None:
        raise ValueError("a delete needs a filter or ids")
    if where is not None and where._jc.toString() == F.lit(True)._jc.toString():
        raise ValueError("a filter without conditions would delete everything")
    if where is not None:
        stored = stored.filter(~F.coalesce(where, F.lit(False)))
    return stored if ids is None else stored.join(ids, ids.columns, "left_anti")


def first_of_content(docs: DataFrame, known: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """The first document of each content (column content_hash), unless the content is known already."""
    firsts = docs.groupBy("content_hash").agg(F.min(order).alias(order))
    if known is not None:
        firsts = firsts.join(known.select("content_hash"), "content_hash", "left_anti")
    return docs.join(firsts, ["content_hash", order], "left_semi")


def last_hashes(remembered: DataFrame) -> DataFrame:
    """document_id, content_hash: what was remembered last (by seq) of each document."""
    return remembered.groupBy("document_id").agg(F.max_by("content_hash", "seq").alias("content_hash"))


def drift(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed or changed) of rows that differ."""
    rows = before.select(key, F.col(value).alias("was"), F.lit(True).alias("in_was")).join(now.select(key, F.col(value).alias("is"), F.lit(True).alias("in_is")), key, "full_outer")
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return rows.select(key, change.alias("change")).filter("change IS NOT NULL")


def retrieval_diff(before: DataFrame, now: DataFrame, id: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """Rows that came, went or moved between two rankings (query_id, id, rank); a score alone is no finding."""
    rows = before.select(query_id, id, F.col("rank").alias("was")).join(now.select(query_id, id, F.col("rank").alias("now")), [query_id, id], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "reordered")
    return rows.withColumn("change", change).filter("change IS NOT NULL")


def config_diff(before: DataFrame, now: DataFrame, *by: str) -> DataFrame:
    """key, was, now (and by, what names a configuration) of settings (map column settings, dotted keys) that differ."""
    a, b = before.select(*by, F.explode("settings").alias("key", "was")), now.select(*by, F.explode("settings").alias("key", "now"))
    return a.join(b, [*by, "key"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Children whose parent is missing: an archive with any is refused."""
    return child.join(parent.select(on).distinct(), on, "left_anti")


def checked_envelopes(files: DataFrame) -> DataFrame:
    """name, body: the current copy if its checksum holds, else the previous one. files: name, body, checksum, previous, previous_checksum."""
    holds = F.sha2("body", 256).eqNullSafe(F.col("checksum"))
    before = F.sha2("previous", 256).eqNullSafe(F.col("previous_checksum"))
    return files.select("name", F.when(holds, F.col("body")).when(before, F.col("previous")).alias("body"), F.when(holds, "current").when(before, "previous").otherwise("lost").alias("copy"))


def resolved_names(asked: DataFrame, collections: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (name) with target: the collection of that name, else what the alias points to, else null."""
    return asked.join(collections.select(F.col("name"), F.lit(True).alias("is_name")), "name", "left").join(aliases.select(F.col("alias").alias("name"), "collection"), "name", "left").select("name", F.when(F.col("is_name"), F.col("name")).otherwise(F.col("collection")).alias("target"))


def created(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, dimensions, distance, sparse) with verdict and differs: created where no collection has the name, kept where one
    fits, conflict where one has other dimensions, distance or sparse vectors (differs names these). Of several that ask for one name the
    first (by seq, if there is such a column, else by what they ask) is created and the others are held against it."""
    fields = ("dimensions", "distance", "sparse")
    has = collections.select("name", F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in fields])
    order = W.partitionBy("name").orderBy(*(["seq"] if "seq" in wanted.columns else []), *fields)
    asked = wanted.withColumn("_rn", F.row_number().over(order)).withColumn("_asked", F.first(F.struct(*fields)).over(order))
    held = lambda c: F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(f"_asked.{c}"))
    differs = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(held(c)), c) for c in fields]), lambda c: c.isNotNull())
    rows = asked.join(has, "name", "left").withColumn("differs", F.array_join(differs, ","))
    verdict = F.when(F.col("_has").isNull() & (F.col("_rn") == 1), "created").when(F.col("differs") == "", "kept").otherwise("conflict")
    return rows.select("name", *fields, verdict.alias("verdict"), "differs")


def dropped(collections: DataFrame, aliases: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """collections (name) and aliases (alias, collection) without the named collections and what points to them."""
    gone = names.select("name").distinct()
    return collections.join(gone, "name", "left_anti"), aliases.join(gone.withColumnRenamed("name", "collection"), "collection", "left_anti").select(*aliases.columns)


def pointed(aliases: DataFrame, collections: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases after changes (alias, collection; a null collection deletes), and changes with their verdict: set, deleted, missing
    (no such collection) or conflict (a collection has the alias's name). Only set and deleted ones take effect, and of several of an alias
    the last (by seq, if there is such a column, else by collection, deletes first); the others are superseded."""
    is_name = collections.select(F.col("name").alias("alias"), F.lit(True).alias("_clash"))
    there = collections.select(F.col("name").alias("collection"), F.lit(True).alias("_there"))
    deletes = F.col("collection").isNull()
    verdict = F.when(deletes, "deleted").when(F.col("_there").isNull(), "missing").when(F.col("_clash"), "conflict").otherwise("set")
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    judged = changes.withColumn("_seq", seq).join(is_name, "alias", "left").join(there, "collection", "left").withColumn("_verdict", verdict)
    takes = F.col("_verdict").isin("set", "deleted")
    last = F.row_number().over(W.partitionBy("alias", takes).orderBy(F.desc("_seq"), F.desc("collection")))
    judged = judged.withColumn("_last", last).select("alias", "collection", F.when(takes & (F.col("_last") > 1), "superseded").otherwise(F.col("_verdict")).alias("verdict"))
    effective = judged.filter("verdict IN ('set', 'deleted')")
    after = aliases.select("alias", "collection").join(effective.select("alias"), "alias", "left_anti").unionByName(effective.filter("verdict = 'set'").select("alias", "collection"))
    return after, judged


def green_name(alias: Column, at: Column) -> Column:
    """The name of a build of an alias made at a time (UTC as the session has it)."""
    return F.concat(alias, F.lit("-v"), F.date_format(at, "yyyyMMddHHmmss"))


def swapped(aliases: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases after plans (alias, green, gated, passed), and what became of each plan: alias, swapped, gate_ran, reason.

    A gate that failed blocks the swap; one that could not run (passed null) lets it through and is reported."""
    blocked = F.col("gated") & F.coalesce(~F.col("passed"), F.lit(False))
    ran = F.col("gated") & F.col("passed").isNotNull()
    reason = F.when(blocked, "gate failed").when(F.col("gated") & ~ran, "gate could not run").otherwise("")
    judged = plans.withColumn("swapped", ~blocked)
    new = judged.filter("swapped").select("alias", F.col("green").alias("collection"))
    return upserted(aliases.select("alias", "collection"), new, "alias"), judged.select("alias", "swapped", ran.alias("gate_ran"), reason.alias("reason"))


def rolled_back(aliases: DataFrame, builds: DataFrame) -> DataFrame:
    """alias, restored, replaced: the last retained build (name) of each alias but for the one it points to; restored is null where none is left."""
    made = builds.select("name", F.regexp_extract("name", r"^(.*)-v\d{14}$", 1).alias("alias")).filter("alias <> ''")
    rows = aliases.select("alias", F.col("collection").alias("replaced")).join(made, "alias", "left")
    return rows.groupBy("alias", "replaced").agg(F.max(F.when(~F.col("name").eqNullSafe(F.col("replaced")), F.col("name"))).alias("restored"))


def replayed(traces: DataFrame, reruns: DataFrame, before: DataFrame, now: DataFrame, settings: DataFrame) -> DataFrame:
    """query_id, config_changes, moved, answer_changed, deterministic of each stored trace whose question was asked again.

    traces, reruns: query_id, answer. before, now: the rankings, as in retrieval_diff. settings: query_id, was, now (maps of dotted keys)."""
    keys = F.array_union(F.map_keys("was"), F.map_keys("now"))
    changes = settings.select("query_id", F.size(F.filter(keys, lambda k: ~F.try_element_at("was", k).eqNullSafe(F.try_element_at("now", k)))).alias("config_changes"))
    moved = retrieval_diff(before, now).groupBy("query_id").agg(F.count("*").alias("moved"))
    rows = traces.select("query_id", F.col("answer").alias("_was")).join(reruns.select("query_id", F.col("answer").alias("_is")), "query_id").join(changes, "query_id", "left").join(moved, "query_id", "left")
    rows = rows.select("query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("config_changes", "moved")], (~F.col("_was").eqNullSafe(F.col("_is"))).alias("answer_changed"))
    return rows.withColumn("deterministic", (F.col("config_changes") == 0) & (F.col("moved") == 0))


def _flat(text: str | None) -> dict[str, str | None]:
    """Dotted keys and values, whatever the depth, in the text's order. A stack, so that deep texts need no recursion of ours."""
    try:
        top = json.loads(text or "", parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return {}
    out: dict[str, str | None] = {}
    stack = [("", top)] if isinstance(top, dict) else []
    while stack:
        key, value = stack.pop()
        if isinstance(value, dict) and (value or not key):
            stack.extend((f"{key}.{k}" if key else k, v) for k, v in reversed(value.items()))
        else:
            out[key] = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return out


def flattened(settings: Column) -> Column:
    """A JSON object as a map of dotted keys, however deep: scalars as their text (strings bare, null null), arrays and empty sections
    as JSON (numbers inside as strings). What is no object has no keys; of a key that repeats the last counts."""

    @F.pandas_udf("map<string,string>")
    def flat(texts: pd.Series) -> pd.Series:
        return texts.map(_flat)

    return flat(settings)


def recent(traces: DataFrame, n: int, tenant: str | None = None) -> DataFrame:
    """The last n traces (trace_id, ts, tenant), newest first, that a tenant sees."""
    return traces.filter(visible_to(tenant, F.col("tenant"))).orderBy(F.desc("ts"), "trace_id").limit(n)


def within_days(traces: DataFrame, now: Column, days: int) -> DataFrame:
    """Traces (ts) no older than the retention."""
    return traces.filter(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def page(rows: DataFrame, id: str, size: int, after=None) -> DataFrame:
    """The next `size` rows by id behind `after`: a scan in pages asks with the last id of the page before."""
    return (rows if after is None else rows.filter(F.col(id) > after)).orderBy(id).limit(size)


def retired(builds: DataFrame, current: str, cutoff: str) -> DataFrame:
    """Builds (name, like alias-vYYYYMMDDHHMMSS) whose stamp is before cutoff, but for the current one."""
    stamp = F.regexp_extract("name", r"-v(\d{14})$", 1)
    return builds.filter((stamp != "") & (stamp < cutoff) & (F.col("name") != current))


def pruned(sets: DataFrame, keep: int, order: str = "name") -> DataFrame:
    """Sets beyond the newest `keep`."""
    return sets.withColumn("_rn", F.row_number().over(W.orderBy(F.desc(order)))).filter(F.col("_rn") > keep).drop("_rn")


def lock(documents: DataFrame, **settings: str) -> DataFrame:
    """The lock of a corpus, a row for each document: document_id, content_hash and the settings. drift() compares two of them."""
    return documents.select("document_id", "content_hash", *[F.lit(v).alias(k) for k, v in settings.items()])


def export_archive(documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None, path: str, version: str = "1.0", embedding: dict[str, str] | None = None) -> None:
    """Writes documents (the first row of an id), chunks and vectors as JSON lines, the SHA-256 of each file, and a manifest with the
    parts' counts and what made the vectors (embedding: model, version, dimensions)."""
    parts = {"documents": documents.dropDuplicates(["document_id"]), "chunks": chunks} | ({"vectors": vectors} if vectors is not None else {})
    for name, df in parts.items():
        df.select(*sorted(df.columns)).write.mode("overwrite").json(f"{path}/{name}")
    spark = documents.sparkSession
    _checksums(spark, path, list(parts)).write.mode("overwrite").json(f"{path}/checksums")
    counts = {name: spark.read.json(f"{path}/{name}", schema=df.schema).count() for name, df in parts.items()}
    spark.createDataFrame([(version, counts, embedding or {})], _MANIFEST).write.mode("overwrite").json(f"{path}/manifest")


_MANIFEST = "version string, counts map<string,long>, embedding map<string,string>"


def _checksums(spark, path: str, parts: list[str]) -> DataFrame:
    """file, sha256 of the parts' files; a file is one task's output, so it is read where it is hashed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load([f"{path}/{name}" for name in parts])
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def open_archive(spark, path: str, major: int = 1) -> dict[str, DataFrame]:
    """The parts of an archive, once its version, members, checksums, counts and references have been checked."""
    manifest = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()
    if int(manifest["version"].split(".")[0]) != major:
        raise ValueError(f"archive version {manifest['version']} is not supported")
    if not {"documents", "chunks"} <= set(manifest["counts"]):
        raise ValueError("the archive lacks documents or chunks")
    listed = spark.read.schema("file string, sha256 string").json(f"{path}/checksums")
    bad = drift(listed, _checksums(spark, path, list(manifest["counts"])), "file", "sha256").head(1)
    if bad:
        raise ValueError(f"{bad[0]['file']}: {bad[0]['change']}")
    parts = {name: spark.read.json(f"{path}/{name}") for name in manifest["counts"]}
    for name, n in manifest["counts"].items():
        if parts[name].count() != n:
            raise ValueError(f"{name}: the manifest counts {n}")
    if orphans(parts["chunks"], parts["documents"], "document_id").head(1) or "vectors" in parts and orphans(parts["vectors"], parts["chunks"], "chunk_id").head(1):
        raise ValueError("the archive refers to rows that it does not hold")
    return parts


def import_archive(spark, path: str, embedding: dict[str, str], embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The archive's chunks with a vector each. Without embed the archive's vectors are taken, which must come from the same
    embedding (model, version, dimensions), and a chunk without one is an error; else embed adds the column vector."""
    parts = open_archive(spark, path)
    if embed is not None:
        return embed(parts["chunks"])
    if "vectors" not in parts:
        raise ValueError("the archive has no vectors: embed its chunks anew")
    made_by = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()["embedding"]
    other = sorted(k for k in {*made_by, *embedding} if made_by.get(k) != embedding.get(k))
    if other:
        raise ValueError(f"the archive's vectors differ in {', '.join(other)}")
    if orphans(parts["chunks"], parts["vectors"], "chunk_id").head(1):
        raise ValueError("a chunk has no vector")
    return parts["chunks"].join(parts["vectors"].select("chunk_id", "vector"), "chunk_id")


def snapshot(df: DataFrame, path: str, name: str) -> None:
    """A named copy of a table; restore() reads it back. A name is used once."""
    df.write.mode("error").parquet(f"{path}/{name}")


def restore(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def _folder(spark, path: str):
    """The file system of a path, by Hadoop as the session is set up, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def snapshots(spark, path: str) -> list[str]:
    """The names of the snapshots at a path that were written to their end."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    done = lambda f: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory() and done(f))


def delete_snapshot(spark, path: str, name: str) -> bool:
    """Whether there was such a snapshot; it is gone now."""
    if name not in snapshots(spark, path):
        return False
    files, at = _folder(spark, f"{path}/{name}")
    return files.delete(at, True)


def back_up(tables: dict[str, DataFrame], path: str, name: str) -> None:
    """Snapshots of tables under one name, and a manifest with the counts of what was written."""
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        snapshot(df, f"{path}/{name}", table)
    counts = [(table, spark.read.parquet(f"{path}/{name}/{table}").count()) for table in tables]
    spark.createDataFrame(counts, "table string, n long").write.json(f"{path}/{name}/manifest")


def restored(spark, path: str, name: str) -> tuple[dict[str, DataFrame], dict[str, tuple[int, int]]]:
    """A backup's tables, and those whose count is not the manifest's: table -> (manifest's, found)."""
    counts = {r["table"]: r["n"] for r in spark.read.schema("table string, n long").json(f"{path}/{name}/manifest").collect()}
    tables = {table: restore(spark, f"{path}/{name}", table) for table in counts}
    found = {table: df.count() for table, df in tables.items()}
    return tables, {table: (n, found[table]) for table, n in counts.items() if found[table] != n}
