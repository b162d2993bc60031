"""Merkle manifest of a dataset: every row is a leaf, every source a tree, the sources' roots a tree of their own.

A level is a window: partitioned by group and parent index, its ordered full-frame collect_list is at once the preimage of
the parent and the list of siblings. A parent stays on the first row of its run alone (null on the others, which
collect_list passes over), so each node is hashed once and is there once for the next level. LEVELS levels share one
exchange, by group and block of FAN ** LEVELS rows, since a parent never crosses a block; the blocks' tops are the rows of
the next pass. Paths come down by joins on group and block, so no source is ever one task, however large.

Rows are numbered within their source without a task that sees a source: they are sorted by ranges, each range's rows
count from the first of the source in it, and the ranges before are added up.

Defined results: a null doc_id stands first and is not tampered with; rows of equal source and doc_id stand by leaf, rows
that agree in all five columns are leaves of their own with equal digests; null and empty sources are two sources; null
text stays null; texts of any length are hashed whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.shared import crc32_sql, discard, table, written

FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    return sha256(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, step: sha256(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def _over(value: Column, by: int) -> Column:
    return ((value - value % by) / by).cast("long")


def numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """nodes with `at` (from 0, by order within the group) and `n` (rows of the group)."""
    keys = [*group, *order]
    placed = written(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "placed")
    rows = placed.withColumns({"part": F.shiftright("place", 33), "row": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = rows.groupBy(*group, "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    whole = W.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*group, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return rows.join(ranges, [*group, "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("place", "part", "row", "shift")


def _climbed(nodes: DataFrame, group: list[str]) -> DataFrame:
    """nodes with `block`, `path` (the siblings of LEVELS levels; fewer where one node is left) and `top` (what stands above the block)."""
    at, out = F.col("at"), nodes.withColumn("block", _over(F.col("at"), FAN**LEVELS)).repartition(*group, "block").withColumn("top", F.col("digest"))
    for k in range(LEVELS):
        step = FAN**k
        window = W.partitionBy(*group, "block", "parent").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        place, more = (_over(at, step) % FAN).cast("int"), F.col("n") > step
        out = out.withColumn("parent", _over(at, step * FAN)).withColumn("run", F.collect_list("top").over(window))
        siblings = F.struct(F.concat_ws("", F.slice("run", F.lit(1), place)).alias("left"), F.concat_ws("", F.slice("run", place + 2, F.lit(FAN))).alias("right"))
        parent = F.when(at % (step * FAN) == 0, F.when(more, F.sha2(F.concat_ws("", "run"), 256)).otherwise(F.col("top")))
        out = out.withColumns({f"step{k}": F.when(more, siblings), "top": parent})
    path = F.filter(F.array(*[F.col(f"step{k}") for k in range(LEVELS)]), lambda step: step.isNotNull()).cast(PATH)
    out = out.withColumn("path", path).withColumn("top", F.max("top").over(W.partitionBy(*group, "block")))
    return out.drop("parent", "run", *[f"step{k}" for k in range(LEVELS)])


def tree(nodes: DataFrame, group: list[str], above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """nodes (group, at, n, digest and any others) with `subroot`, what remains of the node's group, and `path` up to it.

    above turns the groups' roots (group, digest) into rows of group, root and path_above, which carry every path on; it is
    asked where a group has no more than FAN ** LEVELS nodes."""
    climbed, most = _climbed(nodes, group), nodes.agg(F.max("n")).first()[0] or 0
    if most > FAN**LEVELS:
        up = climbed.filter(F.col("at") % FAN**LEVELS == 0).select(*group, F.col("block").alias("at"), _over(F.col("n") + (FAN**LEVELS - 1), FAN**LEVELS).alias("n"), F.col("top").alias("digest"))
        upper = tree(written(up, "nodes"), group, above).drop("digest", "n").withColumnsRenamed({"at": "block", "path": "rest"})
        return climbed.join(upper, [*group, "block"]).withColumn("path", F.concat("path", "rest")).drop("block", "top", "rest")
    ended = climbed.withColumnRenamed("top", "subroot").drop("block")
    if above is None:
        return ended
    roots = written(ended.filter("at = 0").select(*group, F.col("subroot").alias("digest")), "subroots")
    return ended.join(above(roots), group).withColumn("path", F.concat("path", "path_above")).drop("path_above")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and path of every row of docs (doc_id, source, lang, n_chars, text). tampered: a text to
    verify instead of the row's own; the further column tampered_leaf is its leaf, null where that text is the row's own."""
    group = ["has_source", "source_key"]
    other = F.when(~tampered.eqNullSafe(F.col("text")), leaf(text=tampered)) if tampered is not None else F.lit(None).cast("string")
    leaves = written(docs.select("doc_id", F.col("source").isNotNull().alias(group[0]), F.coalesce("source", F.lit("")).alias(group[1]), leaf().alias("digest"), other.alias("tampered_leaf")), "leaves")
    nodes = numbered(leaves, group, ["doc_id", "digest"])
    discard(leaves)

    def sources(roots: DataFrame) -> DataFrame:
        one = numbered(roots.withColumn("all", F.lit(0)), ["all"], group)
        return tree(one, ["all"]).select(*group, F.col("subroot").alias("root"), F.col("path").alias("path_above"))

    return tree(nodes, group, sources).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered_leaf")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    made = manifest(table(spark, sf_dir, "documents").select(*FIELDS), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    checked = made.withColumn("folded_root", folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF, _CHANGED = (" || ".join(_FIELD.format(c) for c in (*FIELDS[:-1], text)) for text in ("text", "changed"))
ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT *, CASE WHEN ({crc32_sql("doc_id")}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents
), leaves AS (
  SELECT doc_id, source, sha256({_LEAF}) AS leaf, sha256({_CHANGED}) AS changed_leaf FROM docs
), placed AS (
  SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), tree AS (
  SELECT 0 AS k, s, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT k + 1, s, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY k, s, n, pos // 3
), subroots AS (
  SELECT s AS pos, count(*) OVER () AS n, digest FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS k, pos, n, digest FROM subroots
  UNION ALL
  SELECT k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY k, n, pos // 3
), depth AS (
  SELECT s, max(k) AS depth FROM tree GROUP BY s
), siblings AS (
  SELECT rid, t.k, coalesce(string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos < p.pos // (3 ** t.k)::BIGINT), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos > p.pos // (3 ** t.k)::BIGINT), '') AS r
  FROM placed p JOIN tree t ON t.s = p.s AND t.n > 1 AND t.pos // 3 = p.pos // (3 ** (t.k + 1))::BIGINT GROUP BY rid, t.k
  UNION ALL
  SELECT rid, depth + u.k, coalesce(string_agg(digest, '' ORDER BY u.pos) FILTER (u.pos < p.s // (3 ** u.k)::BIGINT), ''),
    coalesce(string_agg(digest, '' ORDER BY u.pos) FILTER (u.pos > p.s // (3 ** u.k)::BIGINT), '')
  FROM placed p JOIN depth USING (s) JOIN upper u ON u.n > 1 AND u.pos // 3 = p.s // (3 ** (u.k + 1))::BIGINT GROUP BY rid, depth + u.k
), fold AS (
  SELECT rid, 0 AS k, changed_leaf AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(x.l || f.digest || x.r) FROM fold f JOIN siblings x ON x.rid = f.rid AND x.k = f.k
), proofs AS (
  SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM siblings GROUP BY rid
)
SELECT doc_id, leaf, b.digest AS subroot, root.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root.digest AS verified
FROM placed p JOIN subroots b ON b.pos = p.s JOIN (SELECT digest FROM upper WHERE n = 1) root ON true
  LEFT JOIN proofs USING (rid) JOIN (SELECT rid, arg_max(digest, k) AS digest FROM fold GROUP BY rid) f USING (rid)
"""
