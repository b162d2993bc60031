"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text, gives each document
a perplexity; a document is kept if it is below a quantile of its language's trusted documents.

Training. Strings of ORDER characters of all training documents are counted (in each task first). Lower
orders count in how many ways a string goes on to the left. Discounts come from how many strings occur one to four times.

Scoring. The strings of ORDER characters of all documents are counted the same way, so the corpus is gathered as its
distinct strings. Their probabilities come from joins, sharded by string, with the counts of each order: a string's own
count and its context's mass, on top of the probability of the string without its first character. The most frequent
strings, SHARD at most whatever the corpus, are broadcast and added up where a document lies. In the same pass each
document names its other strings; those meet their log-probabilities in a join by string, and both sums give its
perplexity. A string outside the broadcast is rarer than those in it, so no key of the join is a hot one.

Threshold. QUANTILE of the perplexities of the language's trusted documents. A text of few characters strays further from
its language's median by chance, as the root of its length says, so it has the QUANTILE of those distances times root of length,
divided by the root of its own, where that is more. Texts shorter than all that were measured have the threshold that this gives for their length. Documents that the model has
seen would look better than others, so trusted documents are halved by a hash of doc_id: one half trains, all of the other
is measured. A language with fewer than FEW measured documents has the threshold of all.

Defined results: a text that is null or empty has perplexity null and is not kept; documents of null language are a
language of their own; where there is no threshold (no trusted documents) texts are kept; labels of a doc_id that
repeat count once (trusted only if all say so); repeated documents repeat; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import mixed, slices, small_batches, table, written

#: SHARD: strings whose log-probabilities are broadcast at most. PIECE: rare strings that stand in one row at most.
ORDER, SHARD, PIECE = 5, 4_000_000, 1 << 16
QUANTILE, FEW = 0.99, 20
START = "\x02"
_STEPS = mixed(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_CACHED_START = np.full(ORDER - 1, ord(START), np.uint32)


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER - 1 start marks, and how many characters each text has."""
    parts, sizes = [], []
    for text in texts:
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        parts += [_CACHED_START, points]
        sizes.append(len(points))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(sizes, np.int64)


def _keys(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for the string that ends at each character, and where in points it starts."""
    if len(points) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = points.astype(np.uint64)
    n = len(points) - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for k in range(ORDER):
        keys += wide[k : n + k] * _STEPS[k]
    first = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)])[:-1]
    at = np.arange(int(sizes.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    return mixed(keys)[at], at


def strings(docs: DataFrame) -> DataFrame:
    """key, string, n: the strings of ORDER characters of all texts and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            points, sizes = _points(batch.column("text").to_pylist())
            keys, at = _keys(points, sizes)
            found, first, n = np.unique(keys, return_index=True, return_counts=True)
            text = points.tobytes().decode("utf-32-le")
            names = [text[i : i + ORDER] for i in at[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(names, pa.string()), pa.array(n)], names=["key", "string", "n"])

    small_batches(docs)
    return docs.select("text").mapInArrow(run, "key long, string string, n long").groupBy("key", "string").agg(F.sum("n").alias("n"))


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: strings with their own discounted share (g, own), and contexts with the mass they leave to the lower order (h, rest)."""
    counts = written(strings(trusted).select(F.col("string").alias("g"), F.col("n").alias("c")), "counts")
    by_order = [counts]
    for _ in range(ORDER - 1):
        longer = by_order[0]
        by_order.insert(0, written(longer.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")), "counts"))
    model = []
    for k, grams in enumerate(by_order, 1):
        n1, n2, n3, n4 = grams.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d1, d2, d3 = (min(i, max(0.0, i - (i + 1) * y * b / a)) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        context = F.substring("g", 1, k - 1)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(min(d3, 2.9))
        contexts = written(grams.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("rest")), "contexts")
        shares = grams.withColumn("h", context).join(contexts, "h").select("g", (F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total")).alias("own"))
        model.append((shares, contexts.select("h", "rest")))
    return model


def log_probabilities(corpus: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """key, n, log_p: the natural logarithm of the last character's probability after the others, for each string of corpus."""
    letters = model[0][0].count() + 1  # one for any other
    below = None
    for k, (shares, contexts) in enumerate(model, 1):
        grams = corpus.select("key", "n", F.col("string").alias("g")) if k == ORDER else corpus.select(F.expr(f"substring(string, {ORDER - k + 1})").alias("g")).distinct()
        rows = grams.withColumn("h", F.substring("g", 1, k - 1)).join(shares, "g", "left").join(contexts, "h", "left")
        if below is None:
            lower = F.lit(1 / letters)
        else:
            rows = rows.withColumn("short", F.expr("substring(g, 2)")).join(below, "short", "left")
            lower = F.col("p_short")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * lower
        if k == ORDER:
            return rows.select("key", "n", F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf"))).alias("log_p"))
        below = written(rows.select(F.col("g").alias("short"), p.alias("p_short")), "lower")
    raise AssertionError


class _Lookup:
    """Values by 64-bit key: keys stand sorted, and their leading bits say where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length())
        lead = self.keys >> np.uint64(64 - self.bits)
        self.starts = np.searchsorted(lead, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.starts).max(initial=0))

    def values_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where there is none, and the places where there is none."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        if not len(self.keys):
            return out, left
        at = self.starts[keys >> np.uint64(64 - self.bits)]
        for step in range(self.most):
            place = np.minimum(at[left] + step, len(self.keys) - 1)
            hit = self.keys[place] == keys[left]
            out[left[hit]] = self.values[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out, left


def _frequent(log_p: DataFrame) -> int:
    """The least n from which on at most SHARD strings occur that often. Counted in some hundred classes of n, so the driver sees no string."""
    size = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted(log_p.groupBy(size.alias("size")).agg(F.count("*").alias("strings"), F.min("n").alias("least")).collect(), key=lambda r: -r["size"])
    least, held = 2**62, 0
    for r in classes:
        held += r["strings"]
        if held > SHARD:
            break
        least = r["least"]
    return least


def perplexities(docs: DataFrame, log_p: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity. log_p: key, n, log_p. One pass over docs; rare strings meet log_p in a join."""
    log_p = written(log_p, "log-p")
    least = _frequent(log_p)
    part = log_p.filter(F.col("n") >= least).select("key", "log_p").toArrow()
    keys, values = np.asarray(part.column("key")).view(np.uint64), np.asarray(part.column("log_p")).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((keys, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None
        for batch in slices(batches, "text", 1 << 20):
            look = look or _Lookup(*sent.value)
            points, sizes = _points(batch.column("text").to_pylist())
            keys, _ = _keys(points, sizes)
            found, missing = look.values_of(keys)
            n = batch.num_rows
            of = np.repeat(np.arange(n), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("row"), pa.array(sizes), pa.array(np.bincount(of, found, n).astype(float)), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            rows, rare = of[missing], keys[missing].view(np.int64)
            for at in range(0, len(rare), PIECE):  # a row's rare strings follow it, in lists that stay short
                own, first = np.unique(rows[at : at + PIECE], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows[at : at + PIECE])), pa.int32()), pa.array(rare[at : at + PIECE]))
                m = len(own)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), batch.column("row").take(pa.array(own)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), lists], names=names)

    names = ["doc_id", "lang", "row", "n_chars", "sum", "rare"]
    rows = docs.select("doc_id", "lang", F.monotonically_increasing_id().alias("row"), "text")
    seen = written(rows.mapInArrow(run, "doc_id long, lang string, row long, n_chars long, sum double, rare array<long>"), "seen")
    sums = seen.filter("rare IS NULL").drop("rare")
    if log_p.filter(F.col("n") < least).head(1):
        rare = seen.filter("rare IS NOT NULL").select("row", F.explode("rare").alias("key"))
        more = rare.join(log_p.filter(F.col("n") < least).select("key", "log_p"), "key").groupBy("row").agg(F.sum("log_p").alias("more"))
        sums = sums.join(more, "row", "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    return sums.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-F.col("sum") / F.col("n_chars"))).alias("perplexity"))


def _bounds(trusted: DataFrame, of: Column) -> DataFrame:
    """of, n, middle, top, spread of each group: median and QUANTILE of the logarithms of perplexities, and QUANTILE of their distances from the median times root of length."""
    rows = trusted.select(of.alias("of"), F.log("perplexity").alias("x"), "n_chars", F.sqrt("n_chars").alias("root"))
    level = lambda x, q: F.percentile_approx(x, q, 10_000)
    levels = rows.groupBy("of").agg(F.count("*").alias("n"), level("x", 0.5).alias("middle"), level("x", QUANTILE).alias("top"))
    far = rows.alias("r").join(levels.alias("l"), F.col("r.of").eqNullSafe(F.col("l.of"))).select("r.of", ((F.col("x") - F.col("middle")) * F.col("root")).alias("y"))
    spreads = far.groupBy("of").agg(level("y", QUANTILE).alias("spread"))
    return levels.alias("l").join(spreads.alias("s"), F.col("l.of").eqNullSafe(F.col("s.of"))).select("l.of", "n", "middle", "top", "spread")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, keep of every document."""
    sure = written(labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).filter("quality = 1 AND toxic = 0").select("doc_id"), "trusted")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    log_p = log_probabilities(written(strings(docs), "strings"), train(docs.filter(half == 0).join(sure, "doc_id", "left_semi").select("text")))
    scored = written(perplexities(docs, log_p), "scored")
    trusted = scored.join(sure.filter(half == 1), "doc_id", "left_semi").filter("perplexity IS NOT NULL")
    bounds = _bounds(trusted, F.col("lang")).filter(F.col("n") >= FEW).drop("n")
    overall = _bounds(trusted, F.lit(0)).select(*[F.col(c).alias(f"all_{c}") for c in ("middle", "top", "spread")])
    judged = scored.alias("s").join(bounds.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.of")), "left").join(F.broadcast(overall), F.lit(True), "left")
    own = F.col("top").isNotNull()
    middle, top, spread = (F.when(own, F.col(c)).otherwise(F.col(f"all_{c}")) for c in ("middle", "top", "spread"))
    threshold = F.when(F.col("n_chars") > 0, F.exp(F.greatest(top, middle + spread / F.sqrt("n_chars"))))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return judged.select("doc_id", F.col("s.lang").alias("lang"), "n_chars", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
