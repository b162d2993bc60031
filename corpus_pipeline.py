"""The corpus pipeline: stages that each call one operator of loam.llm, from raw documents to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import jaccard, languages, mixing, repeats, tokens
from loam.llm.shared import table, written

#: Bytes of the repeats that go: passages of over 50 words are longer in nearly all texts.
PASSAGE = 240


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts included) have no language and go; all others stay, repeated rows too, and a
    missing lang is filled in if one could be predicted. An empty table gives no row; further columns pass through whatever their names."""
    judged = languages.identify(docs, names=("__lang", "__score"))
    kept = judged.filter(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", F.when(F.col("__lang") != "und", F.col("__lang"))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (similarity 0.8 or more) hold together, the first by doc_id (null last) and a hash
    of its text stays; of rows that repeat both, one. Documents without words link with nothing and all stay. An empty table gives no
    row; further columns pass through whatever their names."""
    firsts = jaccard.labelled(docs).filter("first").groupBy(F.col("doc_id").alias("__kept"), F.col("th").alias("__kept_hash")).agg((F.max("n_shingles") * F.count("*")).alias("words"), F.count("*").alias("rows"))
    firsts = written(firsts.select("__kept", "__kept_hash", ((F.col("words") > 0) & (F.col("rows") > 1)).alias("several")), "firsts")
    on = F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.xxhash64("text") == F.col("__kept_hash"))
    once = docs.join(firsts.filter("NOT several"), on, "left_semi")
    repeated = docs.join(firsts.filter("several"), on, "left_semi").withColumn("__text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
    return once.unionByName(repeated)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of PASSAGE bytes or more that stand elsewhere too (repeated rows included) go out of the texts; every row stays,
    with an empty text if nothing is left. Null texts stay null; an empty table gives no row; further columns pass through."""
    return repeats.dedup(docs, PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them: not at all, once or twice. Null and empty texts have size 0; null is a source of
    its own; repeated rows are drawn each for itself; an empty table gives no row; further columns pass through."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row for each row of the mix, repeated ones included. Null is the empty
    text, which has no ids; an empty table gives no row; other columns are not read."""
    return tokens.encode(docs, tokens.model_path())


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot encode a text by this model; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
