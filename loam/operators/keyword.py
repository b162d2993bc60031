"""Keyword search: saturated term weights in a posting table, scored with the collection's document frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.text import term_index, terms
from loam.operators.dense import ranked
from loam.operators.storage import written

#: Fixed values of the weight: saturation, length normalisation, assumed mean length.
K1, B, MEAN_LENGTH = 1.2, 0.75, 256
#: Points of a block, about, and blocks that a search looks into before it knows a k-th score.
BLOCK, FIRST = 64, 4
#: Terms of queries up to which they are broadcast.
MOST_TERMS = 1_000_000


def postings(chunks: DataFrame, k1: float = K1, b: float = B, stems: bool = True, id: str = "point_id", only: DataFrame | None = None) -> DataFrame:
    """id, term, term_id, tf, weight: a row for each distinct term of a chunk. only: terms (column term) whose postings are wanted; those of
    others do not leave the task that reads the chunk, and weights and lengths are the same. Terms are counted where their chunk lies."""
    listed = chunks.select(id, F.array_sort(terms(F.col("text"), stems)).alias("terms"))
    counted = _runs(listed, id, lambda t: t).select(id, "length", F.col("run.first").alias("term"), F.col("run.n").cast("long").alias("tf"))
    if only is not None:
        counted = counted.join(_sent(only.select("term").distinct()), "term", "left_semi")
    counted = _once(counted, chunks, id, ["term"], [F.sum("tf").alias("tf")])
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / MEAN_LENGTH))
    return counted.select(id, "term", term_index(F.col("term")).alias("term_id"), "tf", weight.alias("weight"))


def encoded(chunks: DataFrame, k1: float = K1, b: float = B, stems: bool = True, id: str = "point_id", index=term_index) -> DataFrame:
    """id, term_id, term, tf, weight: the sparse vector of each chunk, a row an entry. Terms of one index are one entry: their frequencies are
    added before they saturate, as a store that knows indices alone must have it; term is the first of them by order."""
    listed = chunks.select(id, F.array_sort(F.transform(terms(F.col("text"), stems), lambda t: F.struct(index(t).alias("term_id"), t.alias("term")))).alias("terms"))
    counted = _runs(listed, id, lambda t: t["term_id"]).select(id, "length", "run.first.term_id", "run.first.term", F.col("run.n").cast("long").alias("tf"))
    one = _once(counted, chunks, id, ["term_id"], [F.min("term").alias("term"), F.sum("tf").alias("tf")])
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / MEAN_LENGTH))
    return one.select(id, "term_id", "term", "tf", weight.alias("weight"))


def _runs(listed: DataFrame, id: str, same: Callable[[Column], Column]) -> DataFrame:
    """id, length, run: first and n of each run of a sorted array (terms), by what is the same in it."""
    n, at = F.size("terms"), lambda i: F.get("terms", i)
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (same(at(i)) != same(at(i - 1))))
    ends = listed.filter(n > 0).select(id, n.alias("length"), "terms", last.alias("ends"))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    return ends.select(id, "length", F.explode(F.transform("ends", lambda e, i: F.struct(at(before(i)).alias("first"), (e - before(i)).alias("n")))).alias("run"))


def _once(counted: DataFrame, chunks: DataFrame, id: str, by: list[str], sums: list[Column]) -> DataFrame:
    """counted, a row for each id, length and by: only rows of ids that stand in several chunks have to meet for that."""
    again = chunks.groupBy(F.col(id).alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again")
    number = again.count()
    if not number:
        return counted
    again = F.broadcast(again) if number <= MOST_TERMS else again
    names, on = counted.columns, F.col(id).eqNullSafe(F.col("again"))
    met = counted.join(again, on, "left_semi").groupBy(id, "length", *by).agg(*sums)
    return counted.join(again, on, "left_anti").unionByName(met.select(names))


def query_terms(queries: DataFrame, stems: bool = True, query_id: str = "query_id") -> DataFrame:
    return queries.select(query_id, F.explode(F.array_distinct(terms(F.col("text"), stems))).alias("term"))


def search(posted: DataFrame, asked: DataFrame, total: DataFrame, k: int, allowed: DataFrame | None = None, id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """query_id, id, score, rank. posted: id, term, weight of the whole collection; asked: query_id, term; total: one row n, the
    number of points; allowed: ids that the filter leaves. Frequencies are those of the whole collection, also under a filter."""
    used = written(posted.select(id, "term", "weight").join(_sent(asked.select("term").distinct()), "term", "left_semi"), "postings")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    weighed = df.crossJoin(F.broadcast(total)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    rows = used if allowed is None else used.join(allowed.select(id), id, "left_semi")
    # a point's postings lie in one partition, so its scores are summed and all but the k best of a partition dropped there
    scored = rows.repartition(id).join(_sent(written(asked.join(weighed, "term"), "asked")), "term").groupBy(query_id, id).agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))
    return ranked(scored.withColumn("score", F.round("score", 9)), k, True, id, query_id)


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of queries, to be broadcast up to MOST_TERMS."""
    return F.broadcast(rows) if rows.count() <= MOST_TERMS else rows


def store(posted: DataFrame, path: str, total: int, id: str = "point_id") -> None:
    """Writes a posting table (id, term, weight) in blocks of some BLOCK points each, by a hash of the id: a row for each term of a block, with the
    greatest weight, the number, and the points with their weights. total: the number of points. A block lies in one file, sorted by term, so a
    frequent term is in many files; the postings are shuffled once."""
    blocks = max(1, -(-total // BLOCK))
    rows = posted.select(id, "term", "weight").withColumn("block", F.pmod(F.xxhash64(id), F.lit(blocks))).repartition("block")
    lists = rows.groupBy("term", "block").agg(F.max("weight").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct(id, "weight")).alias("points"))
    lists.sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")


def search_stored(spark: SparkSession, path: str, asked: DataFrame, total: int, k: int, id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """query_id, id, score, rank: the rows of search() over a stored table. A block's bound for a query is the sum of its terms' greatest
    weights there; the blocks with the highest bounds give a k-th score, and then only blocks whose bound reaches it are scored."""
    lists = spark.read.parquet(f"{path}/postings").join(_sent(asked.select("term").distinct()), "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    weighed = df.select("term", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    wanted = _sent(written(asked.join(weighed, "term"), "asked"))
    bounds = written(lists.select("term", "block", "most").join(wanted, "term").groupBy(query_id, "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")), "bounds")
    order = W.partitionBy(query_id).orderBy(F.desc("bound"), "block")
    first = written(bounds.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= FIRST).select(query_id, "block"), "first-blocks")

    def scored(met: DataFrame) -> DataFrame:
        each = met.select(query_id, "block", "idf", F.inline("points"))
        sums = each.groupBy(query_id, "block", id).agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))  # a point lies in one block
        return ranked(sums.select(query_id, id, F.round("score", 9).alias("score")), k, True, id, query_id)

    found = written(scored(lists.join(wanted, "term").join(_sent(first), [query_id, "block"])), "first-scores")
    kth = found.filter(F.col("rank") == k).select(query_id, F.col("score").alias("kth"))
    rest = bounds.join(_sent(first), [query_id, "block"], "left_anti").join(_sent(kth), query_id, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 1e-8))
    # a block's lists meet the queries that want it in one partition, where its points' scores are summed
    wanting = rest.groupBy("block").agg(F.collect_list(query_id).alias("wanting"))
    met = lists.repartition("block").join(wanting, "block").join(wanted, "term").filter(F.array_contains("wanting", F.col(query_id)))
    return ranked(found.drop("rank").unionByName(scored(met).drop("rank")), k, True, id, query_id)
