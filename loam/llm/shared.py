"""Helpers that several operators of this subpackage use: the shared folder, written tables and byte views of text."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of this subpackage name it: space, and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

BATCH = 2 << 20
OWN_FOLDER = "/tmp/checkpoints/loam"
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where that is unset and all runs on this machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or OWN_FOLDER


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors. It goes by discard(), or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, folder = _folder(spark, path)
    system.deleteOnExit(folder)
    again = spark.read.schema(df.schema).parquet(path)
    _folders[again] = path
    return again


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more; other frames are passed over."""
    for df in tables:
        if path := _folders.pop(df, None):
            system, folder = _folder(df.sparkSession, path)
            system.delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a map of hashes: so many a hash, as a power of two between these (64 MB at most).
PER_HASH, LEAST_MAP, MOST_MAP = 16, 15, 29


def hash_map(rows: DataFrame, n: int) -> np.ndarray:
    """A map of the 64-bit hashes (column th) of n rows by their last bits, bounded for any number: bytes, the lowest bit first. Tasks make its buckets of
    4 KB. It says which rows elsewhere cannot be meant: all but one in PER_HASH at most of the others, fewer once the map is full."""
    bits = min(MOST_MAP, max(LEAST_MAP, (PER_HASH * n).bit_length()))
    at = F.col("th").bitwiseAND(F.lit((1 << bits) - 1))
    out = np.zeros(1 << bits - 3, np.uint8)
    for x in rows.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(0x7FFF))).alias("map")).collect():
        out[x.bucket << 12 : x.bucket + 1 << 12] = np.frombuffer(x.map, np.uint8)
    return out


def in_map(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.int64(8 * len(held) - 1)
    return (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def small_batches(df: DataFrame) -> None:
    """From now on, batches of at most BATCH bytes go to the session's Python workers, so that memory does not grow with the texts; a smaller limit is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key, "64m"))
    if not 0 < now <= BATCH:
        conf.set(key, str(BATCH))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of a column hold about `most` bytes each; a single longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    return np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column one after another, and where each row starts (one more at the end). Null: no bytes."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    ends = _offsets(array)
    data = array.buffers()[2]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), ends - (ends[0] if len(ends) else 0)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def split_words(texts: pa.Array, between: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another (binary), and where each text's words start (one more at the end). A word is a
    longest stretch of bytes that between (a boolean for each byte value) does not hold; lower: with A-Z lower-cased first."""
    data, bounds = bytes_of(texts)
    if lower:
        data = _LOWERED[data]
    gap, edge = between[data], np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    inside = np.concatenate(([0], np.cumsum(~gap)))
    ends = np.append(inside[starts], inside[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[~gap])])
    return words, np.searchsorted(starts, bounds)


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20


def _fixed_values(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE_VALUES = _fixed_values(256, 20240501)
_BASE = 0x9E3779B97F4A7C15
_BASE_BACK = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(n, _BASE if kind == "up" else _BASE_BACK, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """value_sums of the bytes of data. Two byte strings are known to agree from 1,024 bytes on (a Thue-Morse word and its complement), so only shorter ones are told apart by it."""
    return value_sums(_BYTE_VALUES[data])


def value_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial hash modulo 2^64 (one longer than values)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mixed((sums[end] - sums[start]) * _power("down", len(sums))[start])


def gram_hash(sums: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all strings of q bytes."""
    n = len(sums) - q
    return mixed((sums[q:] - sums[:n]) * _power("down", len(sums))[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64, public domain)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(*columns, seed: int):
    """A 64-bit hash of columns, the same on every run."""
    return F.xxhash64(F.lit(seed), *columns)


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a value's decimal text (null: null), which DuckDB has no function for."""
    codes = f"list_transform(string_split({value}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    step = "CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END"
    folded = f"list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda r, _: {step}))"
    return f"CASE WHEN {value} IS NOT NULL THEN xor({folded}, 4294967295) END"
