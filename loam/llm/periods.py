"""Periodic runs of words, by heavy/light lag counting.

For a lag q, count the places whose word stands q words later again. Frequent words (over sqrt(n log n) times in a
document of n words) are counted by the exact autocorrelation of where they stand: one FFT a word, the power spectra
summed, one inverse FFT, rounded to the integers they are; rare words by the differences of their places. A run of period
q and length at least max(6, 4 q) has max(6 - q, 3 q) such places in a row, so only lags with as many matches are looked
at; lags up to a quarter of the words are counted, longer ones have no run.

Lags are looked at in ascending order, first at every (q // 8)-th place, then, if as many samples in a row match as the
shortest run would make, at every place; what the islands of matches cover are the stretches of period q. A stretch inside
a run whose period divides q repeats that run. Matches of a lag inside such runs are taken off its count beforehand: a run
of smallest period q shares fewer than q words with them, so none of its own matches goes, and texts of one repeated word
cost one scan instead of one a lag.

Documents are worked on where they lie, without a shuffle, a slice of some megabytes of text at a time; a document's
memory is proportional to its words. Defined results: null and white texts have no words; a null doc_id has its words left
as they are by the query; equal rows give equal rows; an empty table gives no row; further columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.shared import bytes_of, crc32_sql, slices, small_batches, split_words, table

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: A word is frequent from so many places on, whatever the text's length.
FREQUENT = 64
SLICE = 4 << 20
_NUMBERS, _DIGESTS = ["n_runs", "start", "length", "period", "exponent_milli"], ["runs_sha256", "collapsed_sha256"]
FIELDS = T.StructType([*[T.StructField(x, T.LongType()) for x in _NUMBERS], *[T.StructField(x, T.StringType()) for x in _DIGESTS]])
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def lag_counts(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document and lag (0 to a quarter of its words) how many places match; and where each document's counts start."""
    sizes = np.diff(bounds)
    most = sizes // TIMES
    base = np.concatenate(([0], np.cumsum(most + 1)))
    counts = np.zeros(base[-1], np.int64)
    if not len(codes):
        return counts, base
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = doc * (int(codes.max()) + 1) + codes
    place = np.argsort(key, kind="stable")
    key = key[place]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(first, len(key)))
    n = sizes[doc[place[first]]]
    heavy = times > np.maximum(FREQUENT, np.sqrt(n * np.log2(n + 1)))
    light = np.repeat(~heavy, times)
    _count_light(counts, base, most, key[light], place[light], doc)
    owner = doc[place[first[heavy]]]
    for d in np.unique(owner).tolist():
        many = zip(first[heavy][owner == d].tolist(), times[heavy][owner == d].tolist(), strict=True)
        counts[base[d] : base[d + 1]] += _count_heavy([place[at : at + k] - bounds[d] for at, k in many], int(sizes[d]), int(most[d]))
    return counts, base


def _count_heavy(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """By lags 0 to most: the autocorrelations of these words' places, summed. Padded so that nothing wraps around; sums are at most n, far below where rounding could err."""
    size = 1 << (n + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for where in places:
        stands = np.zeros(size)
        stands[where] = 1
        spectrum = np.fft.rfft(stands)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def _count_light(counts: np.ndarray, base: np.ndarray, most: np.ndarray, key: np.ndarray, place: np.ndarray, doc: np.ndarray) -> None:
    """Differences of the k-th next place of the same word, for k = 1, 2, ... as long as a word has one near enough."""
    left, k = np.arange(len(key)), 0
    while len(left):
        k += 1
        left = left[: np.searchsorted(left, len(key) - k)]
        left = left[key[left + k] == key[left]]
        lag, d = place[left + k] - place[left], doc[place[left]]
        near = lag <= most[d]
        left = left[near]
        slots, n = np.unique(base[d[near]] + lag[near], return_counts=True)
        counts[slots] += n


def runs_of(codes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document, by start, then period; counts[q]: matches at lag q (changed)."""
    lags = np.arange(len(counts))
    least = np.maximum(LEAST - lags, (TIMES - 1) * lags)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in (np.flatnonzero(counts[1:] >= least[1:]) + 1).tolist():
        if counts[q] < least[q]:
            continue
        step = q // 8
        if step > 1 and _longest(codes[:-q:step] == codes[q::step]) < (TIMES - 1) * q // step:
            continue
        start, end = _islands(codes[:-q] == codes[q:])
        long = end - start >= least[q]
        start, end = start[long], end[long] + q
        for d, (starts, ends) in found.items():
            if q % d == 0 and len(start):
                i = np.searchsorted(starts, start, side="right") - 1
                new = (i < 0) | (ends[i] < end)
                start, end = start[new], end[new]
        if len(start):
            found[q] = start, end
            for length in (end - start).tolist():
                inside = lags[2 * q : length : q]
                counts[inside] -= length - inside
    return sorted((s, e - s, q) for q, (start, end) in found.items() for s, e in zip(start.tolist(), end.tolist(), strict=True))


def _islands(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turns = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    return turns[::2], turns[1::2]


def _longest(same: np.ndarray) -> int:
    start, end = _islands(same)
    return int((end - start).max(initial=0))


def repeat_words(n: int, h: int) -> np.ndarray | None:
    """Which word stands at each place once the contract's planted repetition is in; None if there is none."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def find(docs: DataFrame, planted: str | None = None) -> DataFrame:
    """docs with FIELDS after its columns (text and others), in place of its own of these names: the greatest run, digests of all runs and of the text
    without repetitions. planted: a column of numbers by which words are repeated first (see repeat_words; null: not)."""
    small_batches(docs)
    docs = docs.drop(*FIELDS.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            seeds = batch.column(batch.schema.get_field_index(planted)).to_pylist() if planted else [None] * batch.num_rows
            found = _found(batch.column(batch.schema.get_field_index("text")), seeds)
            arrays = [pa.array(x, pa.string() if f.dataType == T.StringType() else pa.int64()) for x, f in zip(zip(*found, strict=True), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *FIELDS.names])

    return docs.mapInArrow(walk, T.StructType([*docs.schema.fields, *FIELDS.fields]))


def _found(texts: pa.Array, seeds: list[int | None]) -> list[tuple]:
    words, bounds = split_words(texts, _WHITE)
    codes, stands = words.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.arange(len(words))
    for d, seed in enumerate(seeds):
        if seed is not None and (moved := repeat_words(int(bounds[d + 1] - bounds[d]), seed)) is not None:
            stands[bounds[d] : bounds[d + 1]] = bounds[d] + moved
    codes = codes[stands].astype(np.int64)
    counts, base = lag_counts(codes, bounds)
    out, kept = [], np.ones(len(codes), bool)
    for d in range(len(seeds)):
        at = int(bounds[d])
        runs = runs_of(codes[at : bounds[d + 1]], counts[base[d] : base[d + 1]])
        for start, length, period in runs:
            kept[at + start + period : at + start + length] = False
        best = None
        for run in runs:  # by start, then period: the first of the greatest stays
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        listed = _digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        out.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed))
    rest = np.concatenate(([0], np.cumsum(kept)))[bounds].astype(np.int64)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(rest, words.cast(pa.large_binary()).take(pa.array(stands[kept]))), pa.scalar(b" ", pa.large_binary()))
    data, ends = bytes_of(joined)
    return [(*x, hashlib.sha256(data[ends[d] : ends[d + 1]]).hexdigest()) for d, x in enumerate(out)]


def crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc(F.col("doc_id")).alias("planted"))
    return find(docs, "planted").select("doc_id", *FIELDS.names)


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {crc32_sql("doc_id")} AS h FROM documents
), sizes AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs
), placed AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sizes
), words AS (
  SELECT rid, n, i, CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), pairs AS (
  SELECT x.rid, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4
), islands AS (
  SELECT rid, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island, i FROM (SELECT * FROM pairs QUALIFY count(*) OVER (PARTITION BY rid, q) >= greatest(6 - q, 3 * q))
), stretches AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY rid, q, island HAVING count(*) >= greatest(6 - q, 3 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches d WHERE d.rid = s.rid AND d.q < s.q AND s.q % d.q = 0 AND d.start <= s.start AND d.start + d.length >= s.start + s.length)
), dropped AS (
  SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT rid, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid
), best AS (
  SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS listed FROM runs GROUP BY rid
), longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / q DESC, start, q) = 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
  coalesce(listed, sha256('')) AS runs_sha256, coalesce(collapsed, sha256('')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (rid) LEFT JOIN longest USING (rid) LEFT JOIN kept USING (rid)
"""
