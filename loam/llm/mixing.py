"""Mixing sources to target weights: systematic sampling by DataFrame operations only.

A document of a source is expected target / source_size times. Its prefix sum within the source is that number times its
rank, where documents stand by size (then a hash, then doc_id), so the words taken follow the target closely. With one
random offset a source, a document is emitted once for each integer that its stretch of the prefix sum crosses.

The rank needs no task that sees a whole source: documents are counted by (source, size, hash prefix), counts are summed
up over these small tables, and only the documents of one such cell are ranked together.

Defined results: null text has size 0; a source may be null (a source of its own, last); documents of size 0 are taken
0 words and count as documents; if all sizes are 0 every target is 0; repeated rows are documents of their own; an empty
table gives an empty mix; other columns stay as they are in `mix` and are not read by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.shared import WORD, table, written

#: The production parameters: weights by the sources' order, share of all words, words of a source at most, seed.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row a source (no_source, source_key): source_size and target. Works on one row a source.

    Sorted by cap over weight, sources are capped as long as the cap is within the share that falls to the source once
    the ones before are capped; the rest share what is left by weight. That is where resharing the excess ends."""
    sources = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    order = W.orderBy("no_source", "source_key")
    named = sources.withColumn("at", (F.row_number().over(order) - 1) % len(weights)).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("at")).cast("double"))
    named = named.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - before) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    leveled = named.select("no_source", "source_key", "source_size", "weight", "cap", F.row_number().over(by_ratio).alias("rn"), level.alias("level"))
    free = leveled.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct("rn", "level"))).over(W.partitionBy())
    return free.withColumn("first", first).select("no_source", "source_key", "source_size", F.when(F.col("free"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """A row a document: doc_id, source, size, text_hash, source_size, target, copies (times the mix holds it). Documents of equal doc_id and size stand by a hash of the text."""
    narrow = written(docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix")
    order_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = narrow.withColumn("order_hash", order_hash).withColumn("cell", F.substring("order_hash", 1, 3))
    source, cell = ["no_source", "source_key"], ["no_source", "source_key", "size", "cell"]
    goals = targets(narrow, weights, share, most)

    cells = keyed.groupBy(*cell).agg(F.count("*").alias("n"))
    in_size = cells.withColumn("before_cell", F.sum("n").over(W.partitionBy(*source, "size").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    by_size = cells.groupBy(*source, "size").agg(F.sum("n").alias("n_size"))
    by_size = by_size.withColumn("before_size", F.sum("n_size").over(W.partitionBy(*source).orderBy("size").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_size"))
    starts = in_size.join(by_size, [*source, "size"]).join(goals, source).select(*cell, (F.col("before_cell") + F.col("before_size")).alias("before"), "source_size", "target")

    ranked = keyed.withColumn("in_cell", F.row_number().over(W.partitionBy(*cell).orderBy("order_hash", "doc_id", "text_hash"))).join(starts, cell)
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col("no_source").cast("int").cast("string"), "source_key"), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("in_cell")
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return ranked.select("doc_id", F.when(F.col("no_source"), None).otherwise(F.col("source_key")).alias("source"), "size", "text_hash", "source_size", "target", F.least(crossed, F.ceil(F.lit(most))).cast("long").alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """docs with every row as often as the mix holds it, all columns kept. Needs doc_id, source and text. Which rows are taken depends on
    their doc_id, source and text alone, not on where they stand: only rows that agree in all three are dealt their numbers of copies
    among themselves, in the order of a hash of their other columns (of plain kinds)."""
    keys = ["__mix_id", "__mix_source", "__mix_size", "__mix_hash"]  # names that no table has
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias(keys[0]), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(keys[1])]
    found = copies(docs, **parameters).select(*key, F.col("size").alias(keys[2]), F.col("text_hash").alias(keys[3]), "copies")
    taken = found.groupBy(*keys).agg(F.array_sort(F.collect_list("copies")).alias("__mix_copies"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias(keys[2])
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key, size, F.xxhash64("text").alias(keys[3])).join(taken, keys)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "source", "text") and not any(x in kind for x in ("map<", "variant"))]
    # the join leaves rows sorted by its keys, so that numbering rows of equal keys sorts only what follows them
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*keys, F.xxhash64(*plain) if plain else F.lit(0)))
    numbered = rows.withColumn("__mix_n", F.get("__mix_copies", at - 1)).filter("__mix_n > 0")
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int"))).alias("__mix_copy")).drop("__mix_copy")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH narrow AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), sources AS (
  SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM narrow GROUP BY ALL
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3] AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM sources
), leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS rn
  FROM weighted WINDOW o AS (ORDER BY cap / weight, no_source, source_key)
), goals AS (
  SELECT no_source, source_key, source_size,
         CASE WHEN cap > level * weight THEN (SELECT arg_min(level, rn) FROM leveled WHERE cap > level * weight) * weight ELSE cap END AS target
  FROM leveled
), ranked AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY no_source, source_key ORDER BY size, h, doc_id) AS rank,
         ('0x' || left(sha256('mix-1' || no_source::INT::VARCHAR || source_key), 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM narrow JOIN goals USING (no_source, source_key)
)
SELECT doc_id, size, source_size, target, (least(floor(rank * rate + u) - floor((rank - 1) * rate + u), 2) * size)::BIGINT AS taken FROM ranked
"""
