"""Document fingerprints by a randomised edit embedding.

All texts share random bits, one for each step and character. A walk stands on a character and, at each step, writes it
and moves on if the bit of that step and character says so. Texts that differ by few edits fall into step again, so the
written strings differ in few places: edit distance has become Hamming distance. A fingerprint samples the written
string: at the same steps for all texts, up to SAMPLES in each stretch from a power of two to the next, four hashed bits
of the character each. The likeness of two fingerprints is the share of equal samples, each stretch weighed by its steps.

The random bits repeat after PERIOD steps, and characters beyond ASCII share 128 classes, so two of them may look alike.

`near_documents` bands sampled bits, meets documents of equal bands, and verifies the likeness.

Defined results: null text is empty; equal texts have equal fingerprints; two empty texts have likeness 1, an empty and
another one 0; documents stand by doc_id, null first, ties by a hash of the text, and the last one's next is the first; a
lone document is its own next; repeated rows are documents of their own; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.links import components
from loam.llm.shared import mixed, slices, small_batches, table, written

SAMPLES, PERIOD = 48, 64
#: Samples of a band at most, and bands that a fingerprint has at least where it is long enough; nodes of a group that are compared at once; tasks of a larger one.
WIDEST, BANDS, SMALL, SALTS = 8, 16, 32, 16
#: Rows of a stretch of doc_ids that one task sees in order; stretches at most, cut where a sample of 20 ids each says (they get longer beyond, and rows only pass by).
STRETCH, MOST_STRETCHES = 4096, 100_000


def _random(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _stays() -> list[list[int]]:
    """How many steps a walk stays on a character of each class, by the step (modulo PERIOD) at which it comes there."""
    bits = (_random(256 * PERIOD, 11) >> np.uint64(40) & np.uint64(1)).astype(bool).reshape(256, PERIOD)
    bits[:, 0] = True
    out = []
    for row in bits:
        on = np.nonzero(np.concatenate([row, row]))[0]
        out.append((on[np.searchsorted(on, np.arange(PERIOD))] - np.arange(PERIOD) + 1).tolist())
    return out


_STAY = _stays()
_NIBBLE = (_random(256, 23) >> np.uint64(17) & np.uint64(15)).astype(np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_steps: list[np.ndarray] = []


def sampled_steps(steps: int) -> np.ndarray:
    """The steps below `steps` that are sampled."""
    while not _steps or 1 << (len(_steps) - 1) < steps:
        low = (1 << len(_steps)) >> 1
        size = max(1, low)
        _steps.append(np.arange(low, low + size) if size <= SAMPLES else low + np.sort(np.random.Generator(np.random.PCG64(len(_steps))).choice(size, SAMPLES, replace=False)))
    all_steps = np.concatenate(_steps)
    return all_steps[: np.searchsorted(all_steps, steps)]


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


class Walk:
    """The walk over a text: at which step it comes to each character, and where it ends."""

    def __init__(self, text: str, before: Walk | None = None, same: int = 0):
        """before: the walk over a text with the same first `same` characters."""
        self.classes = _classes(text) if before is None else np.concatenate([before.classes[:same], _classes(text[same:])])
        times = before.times[: same + 1] if before else [0]
        t, add = times[-1], times.append
        for c in self.classes[same:].tobytes():
            t += _STAY[c][t & 63]
            add(t)
        self.times = times

    def fingerprint(self) -> str:
        """Steps in hexadecimal, a colon, and a digit a sample."""
        steps = self.times[-1]
        at = sampled_steps(steps)
        on = np.searchsorted(np.asarray(self.times), at, side="right") - 1
        return f"{steps:x}:{_HEX[_NIBBLE[self.classes[on]]].tobytes().decode()}"


def likeness(a: str, b: str) -> float:
    (n, x), (m, y) = (p.split(":") for p in (a, b))
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return float(n == m)
    x, y = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    both = min(len(x), len(y))
    longer = max(n, m)
    at = sampled_steps(longer)
    equal = np.zeros(len(at))
    equal[:both] = x[:both] == y[:both]
    stretch = np.frexp(at.astype(float))[1]
    total = np.bincount(stretch)
    same = np.bincount(stretch, equal)
    low = np.array([(1 << k) >> 1 for k in range(len(total))])
    width = np.minimum(np.maximum(low, 1), np.maximum(0, longer - low))
    there = total > 0
    return float(np.sum(same[there] / total[there] * width[there]) / np.sum(width[there]))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([Walk(t or "").fingerprint() for t in batch.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    small_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_stretches(docs: DataFrame, size: int = STRETCH) -> DataFrame:
    """doc_id, th, text, stretch, guest: rows by stretches of doc_id, each with the first row of the next stretch as a guest (the last one's is the first of all)."""
    small_batches(docs)
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    n = min(MOST_STRETCHES, -(-total // size))
    sample = rows.select("doc_id").sample(min(1.0, 20 * n / total), seed=5).toPandas()["doc_id"].sort_values().to_numpy() if n > 1 else np.zeros(0, np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(sample[len(sample) // n :: max(1, len(sample) // n)]) if len(sample) else sample)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, ids, side="right"))

    rows = rows.withColumn("stretch", place("doc_id"))
    heads = written(rows.groupBy("stretch").agg(F.min(F.struct("doc_id", "th")).alias("head")), "heads")
    order = W.orderBy("stretch")
    first = F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    guests = heads.withColumn("guest_head", F.coalesce(F.lead("head").over(order), first)).select(F.col("stretch").alias("host"), F.col("guest_head.doc_id").alias("doc_id"), F.col("guest_head.th").alias("th"))
    guest_rows = rows.join(F.broadcast(guests), ["doc_id", "th"]).dropDuplicates(["host"]).select("doc_id", "th", "text", F.col("host").alias("stretch"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guest_rows)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # stretch, doc_id, text, walk, fingerprint of the row before
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for doc_id, text, stretch in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("stretch").to_pylist(), strict=True):
                walk = Walk(text)
                mark = walk.fingerprint()
                if last and last[0] == stretch:
                    _, before_id, before, before_walk, before_mark = last
                    n = len(before)
                    keep = n - n // 4
                    edited = before[:keep] + text[: n // 4]
                    edited_mark = Walk(edited, before_walk, keep).fingerprint()
                    rows.append((before_id, n, hashlib.sha256(edited.encode()).hexdigest(), before_mark, edited_mark, likeness(before_mark, edited_mark), likeness(before_mark, mark)))
                last = stretch, None if doc_id == -(2**63) else doc_id, text, walk, mark
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    rows = in_stretches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ordered = rows.repartition("stretch").sortWithinPartitions("stretch", "guest", "doc_id", "th")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id: documents whose fingerprints are alike by `least`, met in bands of samples; class_id is the smallest doc_id that links lead to. Null ids are left out.

    Equal fingerprints are one node. A band is a few neighbouring samples, WIDEST at most and fewer in short fingerprints, so
    that each has about BANDS or more of them; near a change of width a document has bands of both. Nodes with an equal band are
    a group, and groups of equal members are one. All of a group are compared: small groups at once; in a larger one each node
    first with the group's first node, which settles those that are alike to it, and then the rest with all that do not hang
    together with it yet, dealt over SALTS tasks a group. Banding meets alike documents with a probability that grows with the
    bands, not surely: tests/llm measure at least 0.9 of the pairs on short, long and template texts."""
    marks = written(fingerprint(docs.filter(F.col("doc_id").isNotNull())), "marks")
    one = written(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "marks-once")
    digits = F.substring_index("fingerprint", ":", -1)
    n = F.length(digits)
    width = lambda n: F.when(n >= BANDS * WIDEST, WIDEST).when(n >= BANDS * WIDEST // 2, WIDEST // 2).otherwise(WIDEST // 4)
    of_width = one.select("node", digits.alias("digits"), n.alias("n"), F.explode(F.array_distinct(F.array(width(n - BANDS), width(n), width(n + BANDS)))).alias("w"))
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.col("w")), F.lit(1)).cast("int") - 1)
    bands = of_width.select("node", "w", F.posexplode(F.transform(places, lambda i: F.substring(F.col("digits"), i * F.col("w") + 1, F.col("w")))).alias("at", "bits"))
    groups = bands.select("node", F.xxhash64("w", "at", "bits").alias("group"))
    sizes = groups.groupBy("group").agg(F.min("node").alias("first"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")).filter("size > 1")
    kept = sizes.groupBy("first", "size", "members").agg(F.min("group").alias("group"))
    held = written(groups.join(kept.select("group", "first", "size"), "group"), "bands")
    marks_of = lambda node, mark: one.select(F.col("node").alias(node), F.col("fingerprint").alias(mark))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array([likeness(x, y) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(marks_of("a", "x"), "a").join(marks_of("b", "y"), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"), "links")

    large = F.col("size") > SMALL
    links = linked(held.filter(large & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b")))
    labels = components(links)
    named = held.join(labels, "node", "left").select("group", "node", F.coalesce("label", "node").alias("label"), F.when(large, F.lit(SALTS)).otherwise(1).alias("salts"))
    left = named.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).select("group", "salt", F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("group", "salt", F.col("node").alias("b"), F.col("label").alias("label_b"))
    rest = left.join(right, ["group", "salt"]).filter((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")))
    labels = components(links.unionByName(linked(rest.select("a", "b"))))
    return marks.join(one, "fingerprint").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
