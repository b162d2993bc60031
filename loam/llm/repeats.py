"""Suffix-array dedup: removal of bytes that stand in a string of some width (400 bytes) which also starts elsewhere.

How the suffixes are shared out. Each window of that width belongs to the bucket of the least hash among its strings of a
quarter of it, so equal windows share a bucket wherever they stand. Neighbouring windows of one bucket travel as one run. Runs
that are equal as a whole are counted first: if there are several, all their windows repeat and none has to be compared, so
copies of any number cost a count. Only buckets with differing runs, one of them single, are looked into.

Within a bucket, bucket-pointer refinement sorts the suffixes of its runs: the first buckets are those of equal short
strings; a bucket is refined by sorting on the bucket identifiers of the suffixes that start as many bytes later as the
order reaches already, so each update serves the next, at twice the depth (25, 50, 100, 200, 400). Suffixes that are alone
in their bucket drop out. Buckets of more than HOT bytes are not gathered in a task: their windows are counted by two
64-bit hashes in a shuffled aggregation instead, which is exact in the same way for any size.

From coarse to fine. A string that repeats is made of shorter ones that repeat. The query looks for strings of SHORT bytes in
all texts, which tells the passages of over 50 words, and for those of 400 bytes in what it found only.

Text is compared by 64-bit hashes in pairs (bucket and run, or two hashes of a window); within a bucket the first order
is by a 64-bit hash of a short string.

Defined results: null text is empty; documents are told apart by doc_id and text, and rows that repeat both count as
further occurrences; null ids are allowed; texts shorter than the width lose nothing; an empty table gives no row; further
columns pass through dedup() whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.shared import bytes_of, discard, gram_hash, hash_map, in_map, mixed, prefix_hash, slices, small_batches, span_hash, table, value_sums, written

WIDTH, SHORT, WORDS = 400, 240, 50
#: Window starts of a piece of a long text; bytes of a bucket that one task takes, and of buckets that it takes at once.
STRIDE, HOT, AT_ONCE = 1 << 18, 1 << 20, 1 << 19
#: Documents, and spans in them, that are broadcast at most; beyond that the texts that may have some are shuffled.
MOST_DOCS, MOST_SPANS = 200_000, 2_000_000


def _sliding(a: np.ndarray, w: int, best: np.ufunc, rest: int) -> np.ndarray:
    """best over a[i:i+w] for each i, from running bests of blocks of w."""
    n = len(a) - w + 1
    blocks = np.full(-(-len(a) // w) * w, rest, np.uint64)
    blocks[: len(a)] = a
    blocks = blocks.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[w - 1 : w - 1 + n])


def window_runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one bucket, of texts laid one after another: row, start in data, number of windows, bucket, hash of the run's bytes, whether the bucket's string comes several times in it."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    gram = width // 4
    w = width - gram + 1
    grams = gram_hash(prefix_hash(data), gram)
    least = _sliding(grams, w, np.minimum, 2**64 - 1)
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= width
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - width + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    least[~valid] = 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    start, last = np.nonzero(opens)[0], np.nonzero(closes)[0]
    n = last - start + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    minima = np.nonzero(_sliding(padded, w, np.maximum, 0) == grams)[0]
    again = np.zeros(len(minima) + 1, np.int64)
    if len(minima) > 1:
        np.cumsum((grams[minima[1:]] == grams[minima[:-1]]) & (np.diff(minima) <= w), out=again[1:-1])
        again[-1] = again[-2]
    several = again[np.searchsorted(minima, last + w)] > again[np.searchsorted(minima, start)]
    run = mixed(span_hash(value_sums(grams), start, last + w) + n.astype(np.uint64))  # of the strings' hashes: a sum over single bytes is not safe for long runs
    return row, start, n, least[start], run, several


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A long text in pieces that share width - 1 bytes; others as they come."""
    if len(offsets) == 2 and len(data) > 4 * STRIDE:
        for at in range(0, len(data) - width + 1, STRIDE):
            piece = data[at : at + STRIDE + width - 1]
            yield piece, np.array([0, len(piece)]), at
    else:
        yield data, offsets, 0


def refine(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bucket: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Places of data whose window comes again in a span of the same bucket; spans are data[starts:ends]. The first depth is the width halved until it is odd or below 32."""
    depth = width
    while depth >= 32 and depth % 2 == 0:
        depth //= 2
    span = np.repeat(np.arange(len(starts)), ends - starts)
    end_of = ends[span]
    place = np.arange(len(data))
    at = place[place + depth <= end_of]
    key = mixed(span_hash(prefix_hash(data), at, at + depth) ^ mixed(bucket.astype(np.uint64))[span[at]])
    while True:
        _, named, count = np.unique(key, return_inverse=True, return_counts=True)
        shared = count[named] > 1
        at, named = at[shared], named[shared]
        if depth == width or not len(at):
            return at
        pointer = np.full(len(data), -1, np.int64)
        pointer[at] = named
        at = at[at + 2 * depth <= end_of[at]]
        later = pointer[at + depth]
        at, later = at[later >= 0], later[later >= 0]
        key = (pointer[at].astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        depth *= 2


def _joined(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of neighbouring places."""
    if not len(places):
        return places, places
    cut = np.nonzero(np.diff(places) != 1)[0]
    first = places[np.concatenate([[0], cut + 1])]
    return first, places[np.concatenate([cut, [len(places) - 1]])] - first + 1


_ID = "row_id long, th long"
_NO_ID = -(2**63)
_REPEATED = ["row_id", "th", "s", "n"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("row_id"), F.xxhash64("text").alias("th"), "text")


def _find_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 18):
        data, offsets = bytes_of(batch.column("text"))
        for piece, bounds, shift in _pieces(data, offsets, width):
            row, start, n, bucket, run, several = window_runs(piece, bounds, width)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(index), batch.column("th").take(index), pa.array((start - bounds[row] + shift).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(run.view(np.int64)), pa.array(several)],
                names=["row_id", "th", "s", "n", "bucket", "run", "several"],
            )


def _cut_spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 18):
        out: list[tuple] = []
        for row_id, th, text, wanted in zip(batch.column("row_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            raw = text.as_buffer()
            out += [(row_id, th, x["s"], x["n"], x["bucket"], x["single"], x["hot"], raw[x["s"] : x["s"] + x["n"] - 1 + width].to_pybytes()) for x in wanted]
        for at in range(0, len(out), 2048):
            part = out[at : at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], names=["row_id", "th", "s", "n", "bucket", "single", "hot", "span"])


def _refine_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket; whole buckets are refined together, about AT_ONCE bytes a time."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        all_rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = bytes_of(all_rows.column("span"))
        single = np.asarray(all_rows.column("single").to_numpy(zero_copy_only=False), bool)
        places = refine(data, offsets[:-1], offsets[1:], np.asarray(all_rows.column("bucket")), width)
        row = np.searchsorted(offsets, places, side="right") - 1
        places, row = places[single[row]], row[single[row]]
        first, n = _joined(places)
        owner = np.searchsorted(offsets, first, side="right") - 1  # width - 1 places at the end of a span start no window, so runs keep to their span
        index = pa.array(owner)
        s = np.asarray(all_rows.column("s"))[owner] + first - offsets[owner]
        return pa.RecordBatch.from_arrays([all_rows.column("row_id").take(index), all_rows.column("th").take(index), pa.array(s), pa.array(n.astype(np.int32))], names=_REPEATED)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        buckets = np.asarray(batch.column("bucket"))
        cuts = [0, *(np.nonzero(np.diff(buckets))[0] + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and size >= AT_ONCE and held[-1].column("bucket")[-1].as_py() != buckets[a]:
                yield done(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(np.asarray(held[-1].column("n")).sum()) + (width - 1) * (b - a)
    if held:
        yield done(held)


def _window_hashes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "span", 1 << 18):
        data, offsets = bytes_of(batch.column("span"))
        sums, other = prefix_hash(data), prefix_hash(data ^ np.uint8(0x5A))
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) - width + 1)
        at = np.arange(len(row)) + row * (width - 1)
        index = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("row_id").take(index), batch.column("th").take(index), pa.array(np.asarray(batch.column("s"))[row] + at - offsets[row]), batch.column("single").take(index), pa.array(span_hash(sums, at, at + width).view(np.int64)), pa.array(span_hash(other, at, at + width).view(np.int64))], names=["row_id", "th", "s", "single", "h1", "h2"])


def _met(left: DataFrame, rows: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """left (row_id, th and others) joined with a written table (row_id, th, a list of spans, others). Few lists are broadcast; where there are more,
    a bounded map of their hashes tells which rows of left may have one, and only these are shuffled."""
    n, spans = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).head()
    by = ["row_id", "th"]
    if n <= MOST_DOCS and spans <= MOST_SPANS:
        return left.join(F.broadcast(rows), by, how)
    sent = left.sparkSession.sparkContext.broadcast(hash_map(rows, n))

    @F.pandas_udf("boolean")
    def may_have(th: pd.Series) -> pd.Series:
        return pd.Series(in_map(sent.value, th.to_numpy()))

    marked = left.withColumn("__dup_may", may_have("th"))
    some = marked.filter("__dup_may").drop("__dup_may").join(rows, by, how)
    return some if how == "inner" else some.unionByName(marked.filter("NOT __dup_may").drop("__dup_may"), allowMissingColumns=True)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's spans as maximal runs of windows."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            starts, ends = _runs(spans, 1)
            out.append([{"s": a, "n": b - a} for a, b in zip(starts, ends, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("th"), pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int32())])))], names=["row_id", "th", "spans"])


def repeated_windows(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """row_id, th, spans (array of s, n), a written table: the windows that start at bytes s to s + n - 1 come elsewhere too. keyed: row_id, th, text (string or binary)."""

    def by_task(f):
        return lambda batches: f(batches, width)

    small_batches(keyed)
    runs = written(keyed.filter(F.octet_length("text") >= width).select("row_id", "th", "text").mapInArrow(by_task(_find_runs), f"{_ID}, s long, n int, bucket long, run long, several boolean"), "runs")
    classes = written(runs.groupBy("bucket", "run").agg(F.count("*").alias("copies"), F.min(F.struct("row_id", "th", "s", "n")).alias("one"), F.max("several").alias("several")), "run-classes")
    buckets = classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.count_if(F.col("copies") == 1).alias("singles"), F.max(F.col("several") & (F.col("copies") == 1)).alias("folded"), F.sum(F.col("one.n") + width - 1).alias("size"))
    open_buckets = buckets.filter((F.col("singles") > 0) & ((F.col("classes") > 1) | F.col("folded"))).select("bucket", (F.col("size") > HOT).alias("hot"))
    wanted = written(classes.join(open_buckets, "bucket").select("one.*", "bucket", (F.col("copies") == 1).alias("single"), "hot").groupBy("row_id", "th").agg(F.collect_list(F.struct("s", "n", "bucket", "single", "hot")).alias("wanted")), "wanted")
    once = _met(keyed.select("row_id", "th", "text"), wanted, "wanted")
    spans = written(once.mapInArrow(by_task(_cut_spans), f"{_ID}, s long, n int, bucket long, single boolean, hot boolean, span binary"), "spans")

    refined = spans.filter(~F.col("hot")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_task(_refine_buckets), f"{_ID}, s long, n int")
    windows = spans.filter("hot").mapInArrow(by_task(_window_hashes), f"{_ID}, s long, single boolean, h1 long, h2 long")
    several = windows.groupBy("h1", "h2").agg(F.count("*").alias("copies")).filter("copies > 1").select("h1", "h2")
    in_row = F.col("s") - F.row_number().over(Window.partitionBy("row_id", "th").orderBy("s"))
    counted = windows.filter("single").join(several, ["h1", "h2"]).select("row_id", "th", "s", in_row.alias("stretch")).groupBy("row_id", "th", "stretch").agg(F.min("s").alias("s"), F.count("*").cast("int").alias("n")).select(*_REPEATED)
    copied = runs.join(classes.filter("copies > 1").select("bucket", "run"), ["bucket", "run"]).select(*_REPEATED)
    of_row = copied.unionByName(refined).unionByName(counted).groupBy("row_id", "th").agg(F.collect_set(F.struct("s", "n")).alias("spans"))  # a set: rows that repeat say the same
    out = written(of_row.mapInArrow(_merge_runs, f"{_ID}, spans array<struct<s: long, n: int>>"), "repeated")
    discard(runs, classes, wanted, spans)
    return out


def _runs(spans: list[dict] | None, width: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    starts, ends = [], []
    for a, b in sorted((x["s"], x["s"] + x["n"] - 1 + width) for x in spans or []):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def with_repeats(docs: DataFrame, repeated: DataFrame, *columns: str) -> DataFrame:
    """docs with further columns of a written table (row_id, th, spans and others): the windows of the row's text that come elsewhere (null: none)."""
    inner = [f"__in_{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with those of the spans
    left = docs.toDF(*inner).select(F.coalesce(inner[docs.columns.index("doc_id")], F.lit(_NO_ID)).alias("row_id"), F.xxhash64(inner[docs.columns.index("text")]).alias("th"), *inner)
    met = _met(left, repeated, "spans", "left")
    return met.select(*[F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True)], *[F.col(was).alias(name) for was, name in zip(repeated.columns[2:], columns, strict=True)])


def _kept(raw: bytes, spans: list[dict] | None, width: int) -> tuple[bytes, int, int]:
    starts, ends = _runs(spans, width)
    if not starts:
        return raw, 0, 0
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)), sum(ends) - sum(starts), len(starts)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes taken out of text (and characters that a cut broke); all columns stay, n_chars follows if there is one."""
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            all_spans = batch.column("__dup_spans").to_pylist()
            texts = [t if t is None or not s else _kept(t.encode(), s, width)[0].decode(errors="ignore") for t, s in zip(batch.column("text").to_pylist(), all_spans, strict=True)]
            arrays = [batch.column(c) if c != "text" else pa.array(texts, batch.schema.field("text").type) for c in columns]
            if "n_chars" in columns:
                at = columns.index("n_chars")
                arrays[at] = pa.array([len(t) if t is not None and s else n for t, s, n in zip(texts, all_spans, arrays[at].to_pylist(), strict=True)], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return with_repeats(docs, repeated_windows(_keyed(docs), width), "__dup_spans").mapInArrow(run, schema)


def _excerpts(docs: DataFrame, width: int, longer: int) -> DataFrame:
    """row_id, th (of row and place), text, base, of_th: the stretches of docs (row_id, th, text, spans) that strings of `width` bytes cover and that hold a string of `longer` bytes; every repeated one lies in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            out: list[tuple] = []
            for row_id, th, text, spans in zip(batch.column("row_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                out += [(row_id, th, a, text.as_buffer()[a:b].to_pybytes()) for a, b in zip(*_runs(spans, width), strict=True) if b - a >= longer]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row_id", "of_th", "base", "text"])

    cut = docs.filter("spans IS NOT NULL").mapInArrow(run, "row_id long, of_th long, base long, text binary")
    return cut.withColumn("th", F.xxhash64("of_th", "base"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; then n_repeated (bytes that repeated strings of SHORT bytes cover) and in_passages (whether such a stretch holds over WORDS words)."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for doc_id, text, spans, short in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "short")], strict=True):
                raw = (text or "").encode()
                kept, removed, n = _kept(raw, spans, WIDTH)
                starts, ends = _runs(short, SHORT)
                rows.append((doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), sum(ends) - sum(starts), any(len(word.findall(raw[a:b])) > WORDS for a, b in zip(starts, ends, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*(pa.int64(),) * 4, pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "in_passages"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = _keyed(docs)
    coarse = repeated_windows(keyed, SHORT)
    excerpts = written(_excerpts(_met(keyed, coarse, "spans"), SHORT, WIDTH), "excerpts")
    places = excerpts.select("row_id", "th", "of_th", "base").distinct()
    found = repeated_windows(excerpts.select("row_id", "th", "text"), WIDTH).join(places, ["row_id", "th"])
    fine = found.select("row_id", F.col("of_th").alias("th"), F.transform("spans", lambda x: F.struct((x["s"] + F.col("base")).alias("s"), x["n"].alias("n"))).alias("long"))
    fine = fine.groupBy("row_id", "th").agg(F.flatten(F.collect_list("long")).alias("long"))
    both = written(coarse.join(fine, ["row_id", "th"], "left"), "both")
    discard(excerpts, coarse)
    return with_repeats(docs, both, "short", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, in_passages boolean")
