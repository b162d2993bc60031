"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity of at least 0.8, joined exactly.

Copies. Documents with equal sets are one node; only nodes are compared.

Regions. Jaccard distance is a metric, but documents that share nothing are all at distance 1 of each other, and pivots
drawn at large would leave every document on every boundary. So a region starts from a shingle: two sets within the
distance share one of their first n - ceil(0.8 n) + 1 shingles in any fixed order of all shingles. The order is rarest
first by a sketch of counts over all documents (of bounded size; it bears on speed alone), then by hash. Nodes stand in all
their shingles' regions, which is the replication over boundaries; regions of equal members are one. If a region's shingle
is the first that two sets share, they share no more than what stands from it on: for a partner of at least a node's own
size that is enough only in the first ninth of the node's shingles. A region without such an early member holds no pair.

Pivots. In each region a pivot is compared with the members; each node goes to the pivot that it shares most regions with.
Members within the distance are linked to it, which settles them against all others that hang together with it. Of what is
left, x and y can only be close if their distances to a common pivot differ by no more than the distance asked for (the
triangle inequality's window), and if enough of both stands behind their first common shingle; those pairs of a small region
are compared. Documents of regions that stay large make up a join of their own: all their shingles are counted exactly, and
the order is by that count, so that what many of these documents share stands last and makes no region. There, pivots go
first again, and then all pairs that are left are compared. So regions join recursively, and no close pair of different
components stays uncompared: it shares a region whose pairs were compared, or that region is large, and then both documents
are in the second join.

Shingles are compared by 64-bit hashes.

Defined results: words are what stands between white space, A-Z lower-cased; a text with fewer words than a shingle has
one shingle, all its words; without words or text the set is empty and the document links with nothing, its component is
its own doc_id; documents with null doc_id link like others, and the component is the smallest doc_id in it that is not null
(null if there is none); rows that share a doc_id are documents of their own; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.links import components
from loam.llm.shared import bytes_of, discard, hash_map, in_map, mixed, prefix_hash, slices, small_batches, span_hash, table, written

WORDS, SHARE = 5, 80
#: Counters of the sketch: so many a document, as a power of two between these; counters of a block.
PER_DOC, LEAST_BITS, MOST_BITS, BLOCK_BITS = 32, 12, 23, 18
#: Pairs that a region may hold to be compared in the first join.
SMALL = 4096
#: Ids that are broadcast at most (24 bytes each); more are joined by a shuffle.
MOST_SENT = 300_000
#: Words of more bytes are hashed one by one: sums modulo 2^64 are not safe there.
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = mixed(np.arange(1, WORDS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another, and where each text's start."""
    low = _LOWER[data]
    dark = ~_SPACE[data]
    opens, closes = dark.copy(), dark.copy()
    opens[1:] &= ~dark[:-1]
    closes[:-1] &= ~dark[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    opens[bounds] |= dark[bounds]
    closes[bounds - 1] |= dark[bounds - 1]
    start, end = np.nonzero(opens)[0], np.nonzero(closes)[0] + 1
    word = span_hash(prefix_hash(low), start, end)
    for i in np.nonzero(end - start > LONG_WORD)[0].tolist():
        word[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]].tobytes())
    first = np.searchsorted(start, offsets)  # of each text's words
    n_words = np.diff(first)
    shingle = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words if len(shingle) else 0):
        shingle += word[k : len(shingle) + k] * _STEPS[k]
    shingle = mixed(shingle)
    out, starts = [], [0]
    for a, n in zip(first[:-1].tolist(), n_words.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(shingle[a : a + n - words + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mixed(np.array([np.sum(word[a : a + n] * _STEPS[:n], dtype=np.uint64) + _STEPS[words] * np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        starts.append(starts[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(starts)


def _prefix_length(n: int, share: int) -> int:
    return n - -(-n * share // 100) + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)))


def sketch(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle, by the last bits of its hash, as rounded logarithms: one byte a counter, 8 MB at most for any corpus. Each task counts its documents; blocks of counters are added up on the cluster."""
    bits = min(MOST_BITS, max(LEAST_BITS, (PER_DOC * docs.count()).bit_length()))
    block = min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = np.zeros(1 << bits, np.uint32), np.uint64((1 << bits) - 1)
        for batch in slices(batches, "text", 1 << 18):
            np.add.at(counts, (shingle_sets(*bytes_of(batch.column("text")))[0] & last).view(np.int64), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for i, part in enumerate(counts.reshape(-1, 1 << block)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=["block", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, at, total = zstandard.ZstdDecompressor().decompress, None, np.zeros(1 << block, np.uint64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.round(8 * np.log2(1 + total.astype(np.float64))).astype(np.uint8).tobytes()], pa.binary())], names=["block", "q"])

        for batch in batches:
            for i, z in zip(batch.column("block").to_pylist(), batch.column("z").to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        yield done()
                    at = i
                    total[:] = 0
                total += np.frombuffer(unpack(z), np.uint32)
        if at is not None:
            yield done()

    out = np.zeros(1 << bits, np.uint8)
    for x in docs.select("text").mapInArrow(count, "block int, z binary").repartition(1 << bits - block, "block").sortWithinPartitions("block").mapInArrow(add, "block int, q binary").collect():
        out[x.block << block : x.block + 1 << block] = np.frombuffer(x.q, np.uint8)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text, with which rows of null doc_id are found again), text."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _sets(docs: DataFrame, counts, share: int) -> DataFrame:
    """doc_id, th, n, f1, f2 (an order-free fingerprint of the set), prefix (its first shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counts.value, np.uint64(len(counts.value) - 1)
        for batch in slices(batches, "text", 1 << 18):
            values, starts = shingle_sets(*bytes_of(batch.column("text")))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(values ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x51, 0xA7)]
            often = count[(values & last).view(np.int64)]
            prefixes = [values[a:b][np.argsort(often[a:b], kind="stable")[: _prefix_length(b - a, share)]] if b > a else values[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.diff(starts)), *[pa.array((s[starts[1:]] - s[starts[:-1]]).view(np.int64)) for s in sums], _lists(prefixes)], names=["doc_id", "th", "n", "f1", "f2", "prefix"])

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, n long, f1 long, f2 long, prefix array<long>")


def _with_sets(rows: DataFrame) -> DataFrame:
    """node, n, s: all shingles of the rows' packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", 1 << 16):
            raw = [unpack(z) for z in batch.column("z").to_pylist()]
            values, starts = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("node")), n)), pa.array(np.repeat(n, n)), pa.array(values.view(np.int64))], names=["node", "n", "s"])

    return rows.mapInArrow(run, "node long, n long, s long")


def _packed(wanted: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
    """node, z: the compressed text of each wanted node's owner, once. What travels takes a fifth of a set of hashes.

    A map of the owners' text hashes goes to all tasks, so that a text that is not wanted ends where it was read (but for those whose hash
    meets another's place in the map); the rest is compressed before it moves."""
    owned = written(wanted.join(owners, "node"), "wanted")
    n = owned.count()
    sent = docs.sparkSession.sparkContext.broadcast(hash_map(owned, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text", 1 << 18):
            some = batch.filter(pa.array(in_map(sent.value, np.asarray(batch.column("th")))))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("th"), pa.array([pack(x.as_buffer()) for x in some.column("text")], pa.binary())], names=["doc_id", "th", "z"])

    maybe = _keyed(docs.filter(F.col("text").isNotNull())).mapInArrow(run, "doc_id long, th long, z binary")
    named = owned.withColumnsRenamed({"doc_id": "owner", "th": "owner_th"})
    found = maybe.join(F.broadcast(named) if n <= MOST_SENT else named, (F.col("th") == F.col("owner_th")) & F.col("doc_id").eqNullSafe(F.col("owner")))
    return found.groupBy("node").agg(F.first("z").alias("z"))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, common (shingles of both), total (sizes of both sets, added) of rows with packed texts za and zb; pairs of empty sets are left out."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "zb", 1 << 16):
        za, zb = batch.column("za").to_pylist(), batch.column("zb").to_pylist()
        opens = [i == 0 or za[i] != za[i - 1] for i in range(len(za))]
        raw = [unpack(z) for z in [*(z for z, first in zip(za, opens, strict=True) if first), *zb]]
        values, starts = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        own = np.cumsum(opens) - 1
        other = np.arange(len(zb)) + own[-1] + 1
        total = starts[own + 1] - starts[own] + starts[other + 1] - starts[other]
        common = np.zeros(len(zb), np.int64)
        for i, (x, y) in enumerate(zip(own.tolist(), other.tolist(), strict=True)):
            both = np.sort(np.concatenate([values[starts[x] : starts[x + 1]], values[starts[y] : starts[y + 1]]]))
            common[i] = np.count_nonzero(both[1:] == both[:-1])
        there = pa.array(total > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(total)], names=["a", "b", "common", "total"]).filter(there)


def _compared(pairs: DataFrame, owners: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """a, b, distance and whether they are linked, for distinct pairs of nodes (a, b). owners: node, doc_id, th. Packed texts travel, and sets are made where pairs meet."""
    pairs = written(pairs.select("a", "b"), "pairs")
    a = _packed(pairs.select(F.col("a").alias("node")).distinct(), owners, docs).select(F.col("node").alias("a"), F.col("z").alias("za"))
    b = _packed(pairs.select(F.col("b").alias("node")).distinct(), owners, docs).select(F.col("node").alias("b"), F.col("z").alias("zb"))
    both = pairs.join(b, "b").join(a, "a").mapInArrow(_common, "a long, b long, common long, total long")
    distance, linked = 1 - F.col("common") / (F.col("total") - F.col("common")), 100 * F.col("common") >= share * (F.col("total") - F.col("common"))
    out = written(both.select("a", "b", distance.alias("distance"), linked.alias("linked")), "compared")
    discard(pairs)
    return out


def _same(members: DataFrame) -> DataFrame:
    """Regions with equal members as one, the first in the order of shingles: region, node, n, pos, early, weight (the regions it stands for)."""
    marks = members.groupBy("region").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("m1"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("m2"), F.min("pos").alias("first"))
    kept = marks.groupBy("size", "m1", "m2").agg(F.min_by("region", "first").alias("region"), F.count("*").alias("weight"))
    return members.join(kept.select("region", "weight"), "region")


def regions_of(nodes: DataFrame, share: int) -> DataFrame:
    """region, node, n, pos, early: nodes (node, n, prefix) in the regions of their first shingles, as far as a pair can be close there; pos is the shingle's place in the node's order, early says that enough stands behind it for a partner of the node's own size or more."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "region")).withColumn("early", (100 + share) * (F.col("n") - F.col("pos")) >= 2 * share * F.col("n"))
    one, early_n = W.partitionBy("region"), F.when(F.col("early"), F.col("n"))
    spans = rows.repartition("region").withColumn("size", F.count("*").over(one)).withColumn("least", F.min(early_n).over(one)).withColumn("most", F.max(early_n).over(one))
    partner = F.col("early") | ((share * F.col("least") <= (100 + share) * (F.col("n") - F.col("pos")) - share * F.col("n")) & (100 * F.col("most") >= share * F.col("n")))
    return spans.filter((F.col("size") > 1) & F.col("least").isNotNull() & partner).select("region", "node", "n", "pos", "early")


def by_frequency(packed: DataFrame, share: int) -> DataFrame:
    """node, n, prefix of packed texts (node, z), shingles standing by how many of these nodes have them."""
    sets = written(_with_sets(packed), "all-shingles")
    ranked = sets.join(sets.groupBy("s").agg(F.count("*").alias("count")), "s").withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("count", "s")))
    return ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * share / 100) + 1).groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s")))["s"].alias("prefix"))


def linked_nodes(nodes: DataFrame, owners: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """node, label for all nodes that link with another. nodes: node, n, prefix. owners: node, doc_id, th."""
    spark = nodes.sparkSession
    seen = spark.sql("SELECT 0L AS a, 0L AS b, 0D AS distance, false AS linked WHERE false")
    labels = spark.sql("SELECT 0L AS node, 0L AS label WHERE false")
    for last in (False, True):
        found = written(regions_of(nodes, share), "members")
        members = written(_same(found), "regions")
        discard(found)
        for pivots in (True, False):
            named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            span = named.groupBy("region").agg(F.min("label").alias("least"), F.max("label").alias("most"), (F.count("*") * F.count_if("early")).alias("pairs"))
            named = written(named.join(span.filter("least < most").select("region", "pairs"), "region"), "open")
            if not named.head(1):
                return labels
            pairs = _pivot_pairs(named, share) if pivots else _in_window(_cross_pairs(named if last else named.filter(F.col("pairs") <= SMALL), share), seen, 1 - share / 100 + 1e-9)
            found = _compared(pairs.join(seen, ["a", "b"], "left_anti"), owners, docs, share)
            seen = seen.unionByName(found)
            if found.filter("linked").head(1):
                labels = components(seen.filter("linked").select("a", "b"))
            if pivots:
                discard(named)
        discard(members)
        large = written(named.filter(F.col("pairs") > SMALL).select("node").distinct(), "large")
        discard(named)
        if last or not large.head(1):
            return labels
        nodes = written(by_frequency(_packed(large, owners, docs), share), "nodes")
    return labels


def _pivot_pairs(named: DataFrame, share: int) -> DataFrame:
    """For each node, itself and the pivot that it shares most regions with; a region's pivot is the node with the fewest rarer shingles, the most central one of near copies."""
    pivots = named.groupBy("region").agg(F.min(F.struct("pos", "node", "n", "label")).alias("pivot"))
    tries = named.join(pivots, "region").filter("label != pivot.label").filter(_may_be_close(F.col("n"), F.col("pivot.n"), share))
    tries = tries.groupBy(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"), "node").agg(F.sum("weight").alias("weight"))
    best = tries.withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "a", "b"))).filter("rn = 1")
    return best.select("a", "b").distinct()


def _cross_pairs(named: DataFrame, share: int) -> DataFrame:
    """Pairs of a region, one of them early, whose nodes do not hang together yet. If the region's shingle is the first that two sets share, they share no more than what stands from it on; a pair that needs more is left to the region of its first one."""
    x, y = (named.select("region", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "pos", "early", "label")]) for k in "xy")
    once = F.col("early_x") & (~F.col("early_y") | (F.col("node_x") < F.col("node_y")))
    most = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    enough = (100 + share) * most >= share * (F.col("n_x") + F.col("n_y"))
    met = x.filter("early_x").join(y, "region").filter(once & (F.col("label_x") != F.col("label_y")) & _may_be_close(F.col("n_x"), F.col("n_y"), share) & enough)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _may_be_close(n, m, share: int):
    return 100 * F.least(n, m) >= share * F.greatest(n, m)


def _in_window(pairs: DataFrame, seen: DataFrame, close: float) -> DataFrame:
    """Pairs that the distances to a common pivot do not rule out."""
    known = seen.select("a", "b", "distance")
    to_pivot = known.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "distance").unionByName(known.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "distance"))
    best = to_pivot.groupBy("node").agg(F.min_by(F.struct("pivot", "distance"), F.struct("distance", "pivot")).alias("own"))
    of_a, of_b = (best.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}")) for k in ("a", "b"))
    out = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    apart = (F.col("own_a.pivot") == F.col("own_b.pivot")) & (F.abs(F.col("own_a.distance") - F.col("own_b.distance")) > close)
    return out.filter(~F.coalesce(apart, F.lit(False))).select("a", "b")


def _node(salt: int):
    return F.xxhash64("n", "f1", "f2", F.lit(salt))


def _named(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets with node, and node, owner of those that are not empty: a key of 64 bits for each (n, f1, f2). At billions of sets two of them meet in one key; all
    but the least of these take another key, until every key is one set's."""
    owner, mark, salt = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("owner"), F.struct("n", "f1", "f2"), 0
    rows = sets.withColumn("node", _node(salt))
    while True:
        owners = written(rows.filter("n > 0").groupBy("node").agg(owner, F.min(mark).alias("least"), F.max(mark).alias("most")), "owners")
        twins = owners.filter("least != most").select("node", "least")
        if not twins.head(1):
            return rows, owners.select("node", "owner")
        salt += 1
        moved = F.col("least").isNotNull() & (mark != F.col("least"))
        rows = rows.join(twins, "node", "left").withColumn("node", F.when(moved, _node(salt)).otherwise(F.col("node"))).drop("least")


def join(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return labelled(docs, share).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, th, n_shingles, component_id, and first: whether the row is the component's first by (doc_id, th), nulls last (rows with empty sets all are)."""
    small_batches(docs)
    rows, owners = _named(written(_sets(docs, docs.sparkSession.sparkContext.broadcast(sketch(docs)), share), "sets"))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.first("prefix").alias("prefix"))
    labels = linked_nodes(nodes, owners.select("node", "owner.doc_id", "owner.th"), docs, share)
    named = owners.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    leads = named.groupBy("label").agg(F.min("owner").alias("lead"))
    leads = named.join(leads, "label").select("node", "lead")
    out = rows.select("doc_id", "th", "n", "node").join(leads, "node", "left")
    first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), ((F.col("n") == 0) | first).alias("first"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS c
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (total - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
