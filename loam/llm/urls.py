"""URL filters with a sorted digest array.

Rules are strings of a host and a path prefix with a verdict. Their 64-bit xxhash keys stand sorted in a file that tasks
map into memory; a url is probed with each suffix of its host and each path length that some rule has, all at once by
binary search, and the stored string of each hit is compared in full, so that a collision never decides.

The array is broadcast (again, if an executor is lost), only below a stated size, and each Python worker puts it into an
unnamed file that it maps. Beyond that size `judge_by_join` gives the same verdicts by a shuffled join on the digests.

Defined results: a url that is null or has no ``://`` has empty host and path; then, as for any url without a fitting
rule, the verdict is `default`; of fitting rules the one with the longest string wins, then the longest host; of equal
rules the smallest verdict; null hosts, paths or verdicts of rules are no rules; repeated rows repeat; empty tables work;
other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Bytes of rule strings up to which the array is broadcast.
MOST_BYTES = 256 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Sorted keys, where each stored string starts, and the strings; mapped into memory from one unnamed file."""

    def __init__(self, keys: bytes, starts: bytes, strings: bytes, lengths: list[int]):
        with tempfile.TemporaryFile() as f:
            for part in (keys, starts, strings):
                f.write(part)
            f.flush()
            self.keys = np.memmap(f, np.uint64, "r", 0, len(keys) // 8)
            self.starts = np.memmap(f, np.int64, "r", len(keys), len(starts) // 8)
            self.strings = np.memmap(f, np.uint8, "r", len(keys) + len(starts), len(strings))
        self.lengths = lengths

    @staticmethod
    def parts(rules: list[tuple[str, str, str]]) -> tuple[bytes, bytes, bytes, list[int]]:
        """What an array is made of. A stored string is host, NUL, path, NUL, verdict; the key covers host, NUL and path."""
        rules = sorted(set(rules))
        stored = [f"{h}\0{p}\0{v}".encode() for h, p, v in rules]
        keys = np.array([xxhash.xxh64_intdigest(f"{h}\0{p}".encode()) for h, p, _ in rules], np.uint64)
        order = np.argsort(keys, kind="stable")
        stored = [stored[i] for i in order]
        starts = np.cumsum([0, *map(len, stored)], dtype=np.int64)
        return keys[order].tobytes(), starts.tobytes(), b"".join(stored), sorted({len(p) for _, p, _ in rules})

    def find(self, probes: list[bytes]) -> list[bytes | None]:
        """The stored string of each probe (host, NUL, path), or None."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, wanted)
        out: list[bytes | None] = [None] * len(probes)
        for i in np.nonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)[0].tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:  # equal digests stand side by side
                stored = self.strings[self.starts[k] : self.starts[k + 1]].tobytes()
                if stored.startswith(probes[i] + b"\0"):
                    out[i] = stored
                    break
                k += 1
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    rules = [r for r in rules if None not in r]
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if sum(len(h) + len(p) for h, p, _ in rules) > MOST_BYTES:
        return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default)
    sent = spark.sparkContext.broadcast(DigestArray.parts(rules))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(*sent.value)
        lengths = array.lengths
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            probes, owners, marks = [], [], []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                starts = [p[:n] for n in lengths if n <= len(p)]
                at = 0
                while starts:
                    for s in starts:
                        probes.append(f"{h[at:]}\0{s}".encode())
                        owners.append(i)
                        marks.append((len(h) - at + len(s), len(h) - at))
                    if not (at := h.find(".", at) + 1):
                        break
            best: dict[int, tuple[tuple[int, int], bytes]] = {}
            for i, mark, stored in zip(owners, marks, array.find(probes), strict=True):
                if stored is not None and (i not in best or best[i][0] < mark):
                    best[i] = mark, stored
            found = [best[i][1].decode().split("\0") if i in best else None for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("host"), batch.column("path"), pa.array([f and f[0] + f[1] for f in found], pa.string()), pa.array([f[2] if f else default for f in found], pa.string())], schema=schema)

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rules of any number: probes meet rules in a shuffled join on their digest and full string. A verdict hangs on host and path alone, so equal ones are judged once; a path is probed at the lengths that rules' paths have."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    named = rules.dropna().groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("verdict")).withColumn("digest", F.xxhash64("rule_host", "rule_path"))
    lengths = [r[0] for r in named.select(F.length("rule_path")).distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"), starts.alias("starts")).select("host", "path", "rule_host", F.explode("starts").alias("rule_path")).withColumn("digest", F.xxhash64("rule_host", "rule_path"))
    hits = probes.join(named, ["digest", "rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("hit"))
    return rows.join(hits, ["host", "path"], "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parts AS (
  SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), hits AS (
  SELECT row, rule_host || rule_path AS rule, rule_verdict FROM split JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM split LEFT JOIN hits USING (row)
"""
