"""Late pooling: a document is embedded whole, token by token, and a chunk's vector is the mean of the tokens in its span.

Documents longer than a model's window go through overlapping windows, and each token is taken from the one where it stands
farthest from an edge. Means come from running sums of the token vectors, so spans that overlap add no work.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the share of a window that repeats the one before it is one in so many.
OVERLAP = 4


@dataclass(frozen=True)
class TokenModel:
    """offsets(text): where its tokens start and end. states(tokens): a vector for each token of one window, which alone they see.
    ids(text, offsets), if there is one: what states gets in place of the tokens' strings; asked once a text, not once a window."""

    offsets: Callable[[str], Sequence[tuple[int, int]] | np.ndarray]
    states: Callable[[Sequence], np.ndarray]
    window: int = 510
    ids: Callable[[str, np.ndarray], np.ndarray] | None = None


def windows(total: int, size: int) -> list[tuple[int, int]]:
    """Stretches of `size` tokens, each repeating a part of the one before, that cover `total` tokens."""
    step = max(1, size - size // OVERLAP)
    starts = range(0, max(1, total - size + step), step)
    return [(s, min(s + size, total)) for s in starts]


def token_states(model: TokenModel, tokens: Sequence) -> np.ndarray:
    """Each token's vector, from the (first) window where it is most central: of the tokens that two windows share, the first has the first half."""
    found = windows(len(tokens), model.window)
    cuts = [0, *((later[0] + first[1] + 1) // 2 for first, later in pairwise(found)), len(tokens)]
    return np.concatenate([np.asarray(model.states(tokens[s:e]), float)[a - s : b - s] for (s, e), (a, b) in zip(found, pairwise(cuts), strict=True)])


def span_means(starts: np.ndarray, ends: np.ndarray, vectors: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Unit vectors of the means of the tokens (in order) that meet each span; of all tokens where none does."""
    sums = np.concatenate((np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)))
    asked = np.asarray(spans, np.int64).reshape(-1, 2)
    low, high = np.searchsorted(ends, asked[:, 0], side="right"), np.searchsorted(starts, asked[:, 1], side="left")
    none = high <= low
    low, high = np.where(none, 0, low), np.where(none, len(vectors), high)
    means = (sums[high] - sums[low]) / (high - low)[:, None]
    length = np.sqrt((means * means).sum(axis=1, keepdims=True))
    return np.divide(means, length, out=means.copy(), where=length > 0)


def pooled(model: TokenModel, text: str, spans: Sequence[tuple[int, int]]) -> list[list[float] | None]:
    """A vector a span; null if the text has no tokens."""
    offsets = np.asarray(model.offsets(text), np.int64).reshape(-1, 2)
    offsets = offsets[offsets[:, 1] > offsets[:, 0]]
    if not len(offsets):
        return [None] * len(spans)
    tokens = model.ids(text, offsets) if model.ids else [text[a:b] for a, b in offsets.tolist()]
    return span_means(*offsets.T, token_states(model, tokens), spans).tolist()


def pooled_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """document, span, vector of spans (document, span, start, end) over tokens that are stored (document, start, end, vector; each
    once). A document's tokens and spans are a group, and spans of a document without tokens have no row; so have tokens without a vector."""
    kinds = dict(spans.dtypes)

    def run(spans: pa.Table, tokens: pa.Table) -> pa.Table:
        whole = tokens.filter(tokens["vector"].is_valid()).sort_by([("start", "ascending"), ("end", "ascending")])
        named = spans.select(["document", "span"])
        if not whole.num_rows or not spans.num_rows:
            return named.slice(0, 0).append_column("vector", pa.array([], pa.list_(pa.float64())))
        starts, ends = whole["start"].to_numpy(), whole["end"].to_numpy()
        some = ends > starts
        vectors = np.array(whole["vector"].to_pylist(), float)[some]
        if not len(vectors):
            return named.slice(0, 0).append_column("vector", pa.array([], pa.list_(pa.float64())))
        means = span_means(starts[some], ends[some], vectors, list(zip(spans["start"].to_pylist(), spans["end"].to_pylist(), strict=True)))
        return named.append_column("vector", pa.array(list(means), pa.list_(pa.float64())))

    by = spans.select("document", "span", "start", "end").groupBy("document").cogroup(tokens.select("document", "start", "end", "vector").groupBy("document"))
    return by.applyInArrow(run, f"document {kinds['document']}, span {kinds['span']}, vector array<double>")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: 0 for white space, 1 for what words are made of, 2 for a token of its own."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), 2, np.uint8)
    for kind, pattern in enumerate((r"\s", r"\w")):
        out[[m.start() for m in re.finditer(pattern, every)]] = kind
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _offsets(text: str) -> np.ndarray:
    """Where the matches of \\w+|[^\\w\\s] are."""
    kinds = _kinds()[_points(text)]
    inside = (kinds[1:] == 1) & (kinds[:-1] == 1)
    first, last = kinds > 0, kinds > 0
    first[1:] &= ~inside
    last[:-1] &= ~inside
    return np.stack((np.flatnonzero(first), np.flatnonzero(last) + 1), axis=1)


def _ids(text: str, offsets: np.ndarray) -> np.ndarray:
    """crc32 of each token in lower case; the tokens are what stands in the text beside white space, so they are read as lines of a text of their own."""
    points = _points(text)
    kept = points[_kinds()[points] > 0]
    lines = np.full(len(kept) + len(offsets), ord("\n"), np.uint32)
    lines[np.arange(len(kept)) + np.repeat(np.arange(len(offsets)), offsets[:, 1] - offsets[:, 0])] = kept
    return np.fromiter(map(zlib.crc32, lines.tobytes().decode("utf-32-le").lower().encode().split(b"\n")), np.int64, len(offsets))


def _states(tokens: Sequence[str] | np.ndarray, dimensions: int = 8, reach: int = 4) -> np.ndarray:
    ids = tokens if isinstance(tokens, np.ndarray) else np.array([zlib.crc32(t.lower().encode()) for t in tokens], np.int64)
    n = len(ids)
    own = np.zeros((n + 2 * reach + 1, dimensions))
    own[np.arange(n) + reach + 1, ids % dimensions] = 1
    sums, at = np.cumsum(own, axis=0), np.arange(n)
    near = (sums[2 * reach + 1 :] - sums[:n]) / (np.minimum(at + reach + 1, n) - np.maximum(at - reach, 0))[:, None]
    return own[reach + 1 : n + reach + 1] + near


#: A deterministic stand-in for a model that gives token vectors: each token's bucket and, half as much, its neighbours'.
HASHED = TokenModel(_offsets, _states, 256, _ids)


def vectors_for(model: TokenModel | None) -> Callable[[str, Sequence[tuple[int, int]]], Iterator]:
    """What chunking.chunked asks for the vectors of a document's spans; without a model there are none, and chunks are embedded on their own."""
    return lambda text, spans: pooled(model, text, spans) if model else [None] * len(spans)
