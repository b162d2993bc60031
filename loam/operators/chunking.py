"""Chunking: a document becomes rows of text slices that tile it, by one of five strategies.

A tiling is a sorted array of places in the text: its edges. A strategy adds edges where spans are too long, takes edges
away where neighbours fit together, and the chunks are the spans that are left, so a chunk's text is always an exact slice
of its document. A document is one row and its chunks are made where it lies, on Arrow batches: no shuffle.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.batches import small_batches
from loam.functions.text import stripped

#: Where to cut, coarse to fine; the least size of a re-split; sentence ends; sentences below which meaning is not asked.
SEPARATORS, FLOOR, SENTENCE_END, FEW_SENTENCES = ("\n\n", "\n", ". ", "; ", ", ", " "), 16, re.compile(r"(?<=[.!?])\s+|\n{2,}"), 3
SCHEMA = "doc_id long, chunk_index int, start int, end int, token_count int, section string, text string"
#: Bytes of text that a batch handed on holds, about.
BATCH = 1 << 20

Edges = list[int]
Counter = Callable[[str], int]
Pooling = Callable[[str, list[tuple[int, int]]], list[list[float] | None]]


def estimate(text: str, chars_per_token: int = 4) -> int:
    t = text.strip()
    return max(len(t) // chars_per_token, len(t.split())) if t else 0


def _long(edges: Edges, limit: int) -> list[int]:
    """Which spans between neighbouring edges are longer than limit."""
    return np.nonzero(np.diff(np.asarray(edges, np.int64)) > limit)[0].tolist()


def with_spaces(text: str, edges: Edges, limit: int) -> Edges:
    """More edges in spans of over `limit` characters: each after the last space in the second half of the next `limit` characters, or right behind these."""
    more: Edges = []
    for i in _long(edges, limit):
        at, end = edges[i], edges[i + 1]
        while end - at > limit:
            space = text.rfind(" ", at + limit // 2, at + limit)
            at = at + limit if space <= at else space + 1
            more.append(at)
    return sorted([*edges, *more])


def with_separators(text: str, edges: Edges, limit: int) -> Edges:
    """More edges in spans of over `limit` characters: a separator at a time, coarse to fine, behind each place where it stands within a span that is still too long; then by spaces."""
    for mark in SEPARATORS:
        more = [e for i in _long(edges, limit) for e in _behind(text, mark, edges[i], edges[i + 1])]
        edges = sorted([*edges, *more]) if more else edges
    return with_spaces(text, edges, limit)


def _behind(text: str, mark: str, start: int, end: int) -> Iterator[int]:
    at = text.find(mark, start, end)
    while at >= 0 and (at := at + len(mark)) < end:
        yield at
        at = text.find(mark, at, end)


def without_needless(edges: Edges, limit: int, fixed: Edges = ()) -> Edges:
    """Edges from the left, each the farthest one within `limit` characters of the last (the next one if none is), but never beyond a fixed edge."""
    out = edges[:1]
    while out and out[-1] < edges[-1]:
        i = max(bisect_right(edges, out[-1] + limit) - 1, bisect_right(edges, out[-1]))
        stop = bisect_right(fixed, out[-1])
        out.append(min(edges[i], fixed[stop]) if stop < len(fixed) else edges[i])
    return out


def within_tokens(text: str, edges: Edges, limit: int, tokens: int, cut: Callable[[str, Edges, int], Edges], count: Counter) -> Edges:
    """More edges in spans of too many tokens: cut for half the characters, what is still too much for half of that, down to FLOOR."""
    done, rest = set(edges), list(zip(edges, edges[1:]))
    while limit > FLOOR and (rest := [(a, b) for a, b in rest if count(text[a:b]) > tokens]):
        limit = max(limit // 2, FLOOR)
        cuts = [cut(text, [a, b], limit) for a, b in rest]
        done.update(e for own in cuts for e in own)
        rest = [span for own in cuts for span in zip(own, own[1:])]
    return sorted(done)


def hashed_embedding(texts: list[str], dimensions: int = 8) -> list[list[float]]:
    """A deterministic stand-in for a sentence model: words counted in crc32 buckets, unit length."""
    out = []
    for t in texts:
        v = [0.0] * dimensions
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % dimensions] += 1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def _shifts(vectors: list[list[float]], percentile: float) -> np.ndarray:
    """Whether meaning shifts before each sentence but the first: its distance to the one before is among the largest."""
    v = np.asarray(vectors, float)
    norms = np.sqrt((v**2).sum(axis=1))
    scale = norms[1:] * norms[:-1]
    gaps = 1 - np.divide((v[1:] * v[:-1]).sum(axis=1), scale, out=np.zeros(len(scale)), where=scale > 0)
    return gaps >= np.sort(gaps)[min(int(len(gaps) * percentile), len(gaps) - 1)]


def sentence_edges(text: str) -> Edges:
    return sorted({0, len(text), *(m.end() for m in SENTENCE_END.finditer(text))})


def edges_of(text: str, strategy: str, limit: int, tokens: int, blocks: list[dict] | None, embed, percentile: float, count: Counter) -> Edges:
    """The edges of a document's chunks, before blank ones are closed up."""
    whole = [0, len(text)] if text else []
    if strategy == "fixed":
        return within_tokens(text, with_spaces(text, whole, limit), limit, tokens, with_spaces, count)
    if strategy == "semantic":
        edges = sentence_edges(text) if text else []
        told = len(edges) > FEW_SENTENCES
        shifts = _shifts(embed([text[a:b].strip() for a, b in zip(edges, edges[1:])]), percentile) if told else []
        return with_spaces(text, without_needless(edges, limit, [e for e, shift in zip(edges[1:], shifts) if shift]), limit)
    if strategy == "layout" and blocks:
        edges = [b["start"] for b in blocks] + [len(text)]
        cut = with_separators(text, edges, limit)
        fixed = {b["start"] for b in blocks if b["kind"] == "heading"} | {edges[i] for i in _long(edges, limit)} | set(cut) - set(edges)
        return within_tokens(text, without_needless(cut, limit, sorted(fixed)), limit, tokens, with_separators, count)
    edges = with_separators(text, whole, limit)
    return within_tokens(text, edges if strategy == "layout" else without_needless(edges, limit), limit, tokens, with_separators, count)


def spans_of(text: str, edges: Edges, overlap_chars: int, overlap_tokens: int, count: Counter) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each chunk; a blank span belongs to the chunk before it, and to none at the start."""
    starts = [a for a, b in zip(edges, edges[1:]) if text[a:b].strip()]
    out = []
    for a, b in zip(starts, [*starts[1:], edges[-1] if edges else 0]):
        reach = min(overlap_chars, a) if out else 0
        while reach and count(text[a - reach : a]) > overlap_tokens:
            reach //= 2
        out.append((a - reach, a, b))
    return out


STRATEGIES = ("recursive", "fixed", "semantic", "layout", "late")


def chunked(docs: DataFrame, strategy: str = "recursive", chunk_size: int = 768, overlap: int = 64, chars_per_token: int = 4, percentile: float = 0.95, embed: Callable[[list[str]], list[list[float]]] | None = hashed_embedding, count: Counter | None = None, pool: Pooling | None = None, plain: bool = False) -> DataFrame:
    """SCHEMA rows of docs (doc_id, text, and blocks for the layout strategy). plain, for the fixed strategy: characters alone say where to cut, so a
    chunk may hold more tokens than its size, and blank spans stay chunks of their own. The late strategy adds late_pooling (true) and vector:
    what pool(text, spans) says of each chunk's span, made from the whole text; null where there is no pool, so that the chunk is embedded on its own."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "semantic" and embed is None:
        raise ValueError("the semantic strategy needs an embedder")
    if plain and (strategy != "fixed" or overlap):
        raise ValueError("only the fixed strategy without overlap can be plain")
    has_blocks = "blocks" in docs.columns
    limit = chunk_size * chars_per_token
    names = ["doc_id", "chunk_index", "start", "end", "token_count", "section", "text"]
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string()]
    late = strategy == "late"
    if late:
        names, kinds = [*names, "late_pooling", "vector"], [*kinds, pa.bool_(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = count or (lambda t: estimate(t, chars_per_token))
        columns: list[list] = [[] for _ in names]
        held = 0

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[i].as_py() or ""
                if not text or not (plain or text.strip()):
                    continue
                blocks = batch.column("blocks")[i].as_py() if has_blocks else None
                if plain:
                    edges = with_spaces(text, [0, len(text)], limit)
                    spans = [(a, a, b) for a, b in zip(edges, edges[1:])]
                else:
                    spans = spans_of(text, edges_of(text, strategy, limit, chunk_size, blocks, embed, percentile, n_tokens), overlap * chars_per_token, overlap, n_tokens)
                slices = [text[a:b] for a, _, b in spans]
                places = [b["start"] for b in blocks or ()]
                vectors = ([True] * len(spans), pool(text, [(a, b) for a, _, b in spans]) if pool else [None] * len(spans)) if late else ()
                under = [bisect_right(places, own) - 1 for _, own, _ in spans]
                for c, values in zip(columns, ([doc_id] * len(spans), range(len(spans)), [s[0] for s in spans], [s[2] for s in spans], map(n_tokens, slices), [blocks[k]["section"] if k >= 0 else None for k in under], slices, *vectors)):
                    c.extend(values)
                held += len(text)
                if held >= BATCH:
                    yield taken()
                    held = 0
        yield taken()

    return small_batches(docs.select("doc_id", "text", *["blocks"] * has_blocks)).mapInArrow(run, SCHEMA + ", late_pooling boolean, vector array<double>" * late)


#: What a model writes before a context though told not to, how often that is peeled off, and characters of a document that a prompt holds.
OPENERS, PEELED, PARENT_CHARS = ("Here is the context:", "Situating context:", "Context:", "context:"), 4, 60_000


def situating_prompt(document: Column, chunk: Column) -> Column:
    """The prompt that asks for a chunk's context: the document first, so that all its chunks share a prefix, and no more of it than PARENT_CHARS."""
    return F.concat(F.lit("<document>\n"), F.substring(document, 1, PARENT_CHARS), F.lit("\n</document>\n\n<chunk>\n"), chunk, F.lit("\n</chunk>"))


def cleaned(answer: Column) -> Column:
    """A model's answer as one line without openers and quotes around it, which may be nested in either order."""
    ends = lambda t, marks: F.regexp_replace(t, rf"^{marks}+|{marks}+$", "")
    opener = "^(?:" + "|".join(OPENERS) + ")"
    text = stripped(answer)
    for _ in range(PEELED):
        text = stripped(ends(ends(stripped(F.regexp_replace(text, opener, "")), '"'), "'"))
    return F.regexp_replace(text, r"(?U)\s+", " ")


def enriched(chunks: DataFrame, header) -> DataFrame:
    """chunks with their context (a column: a model's answer) put before the text; a context that is null, or blank once cleaned, marks the chunk as failed and leaves it."""
    clean = cleaned(header)
    made = chunks.withColumn("original_text", F.col("text")).withColumn("context_prefix", F.nullif(clean, F.lit("")))
    return made.withColumn("enrichment_failed", F.col("context_prefix").isNull()).withColumn("text", F.when(F.col("enrichment_failed"), F.col("text")).otherwise(F.concat("context_prefix", F.lit("\n\n"), "text")))
