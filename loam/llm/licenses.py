"""License scans: phrases of consecutive words, and an exact set-similarity join of text blocks with license notices.

A block is BLOCK words of a document, one starting every BLOCK / 2 words, so that a notice of up to half a block (longer
templates are refused) lies whole in some block however its lines are broken. A block and a template join when the block
holds at least LEAST percent of the template's distinct words. Words stand in one order for all: rarest first by their
number in all documents, which a first pass counts for the templates' words alone. Then

* prefix filter: of the template's m words, m - need + 1 stand in its prefix; a block that joins holds one of these;
* length filter: a block with fewer than need of all templates' words joins nothing;
* positional filter: behind the first word that both share, what is left of either bounds how many more they can share;
* what remains is counted exactly.

The templates are a parameter, refused beyond MOST_WORDS distinct words, and are all that leaves the driver; the counts
that come back have a row for each of these words. Documents are read twice and never shuffled.

Defined results: null and white texts have no words, no places and score 0; score is 1 where a phrase stands, else the
greatest share of a template that joins, else 0; a template and phrases may have one label, which is listed once; without
templates only phrases count; equal rows give equal rows; an empty table gives no row; further columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.shared import slices, small_batches, split_words, table

BLOCK, LEAST, MOST_WORDS = 256, 80, 100_000
SLICE = 4 << 20

#: Fixed values of the contract.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices as the licenses' publishers ask authors to use them.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
FIELDS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
        *[T.StructField(c, T.StringType()) for c in ("base_labels", "labels")],
        T.StructField("score", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("template", T.LongType()), T.StructField("share", T.DoubleType())]))),
    ]
)
_BETWEEN = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def words_of(text: str) -> list[str]:
    return [w.decode() for w in split_words(pa.array([text]), _BETWEEN, lower=True)[0].to_pylist()]


def needed(size: int, least: int = LEAST) -> int:
    return -(-least * size // 100)


class Templates:
    """Templates and phrases by the numbers of their words: how rare a word is."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], least: int, frequency: dict[str, int] | None = None):
        sets = [set(words_of(text)) for _, text in templates]
        words = set().union(*sets, *[words_of(p) for p, _ in phrases])
        if len(words) > MOST_WORDS:
            raise ValueError(f"{len(words)} distinct words in templates; {MOST_WORDS} at most")
        for label, text in templates:
            if not 0 < len(words_of(text)) <= BLOCK // 2:
                raise ValueError(f"the template of {label} has no words, or more than half a block")
        self.words = sorted(words, key=lambda w: ((frequency or {}).get(w, 0), w))
        number = {w: i for i, w in enumerate(self.words)}
        self.labels = [label for label, _ in templates]
        self.phrases = [([number[w] for w in words_of(p)], label) for p, label in phrases]
        self.sets = [np.array(sorted(number[w] for w in s), np.int64) for s in sets]
        self.need = np.array([needed(len(s), least) for s in self.sets], np.int64)
        entries = sorted((int(w), t, at) for t, s in enumerate(self.sets) for at, w in enumerate(s[: len(s) - self.need[t] + 1]))
        self.prefix_word, self.prefix_of, self.prefix_at = (np.array(x, np.int64) for x in (zip(*entries, strict=True) if entries else ((), (), ())))
        self.values = pa.array([w.encode() for w in self.words], pa.binary())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number; -1 if it is in no template."""
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, self.values), -1).to_numpy()
        return known[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(words) else np.zeros(0, np.int64)

    def joined(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, block in the text, template, share) of every block and template that join."""
        if not self.labels:
            return
        half, sizes = BLOCK // 2, np.diff(bounds)
        blocks = np.where(sizes > 0, np.maximum(1, -(-(sizes - half) // half)), 0)
        base = np.concatenate(([0], np.cumsum(blocks)))
        place = np.flatnonzero(numbers >= 0)
        text = np.searchsorted(bounds, place, side="right") - 1
        last = (place - bounds[text]) // half
        own = np.concatenate([base[text] + b for b in (last, last - 1)])
        inside = np.concatenate([(b >= 0) & (b < blocks[text]) for b in (last, last - 1)])
        pairs = np.unique(own[inside] * len(self.words) + np.tile(numbers[place], 2)[inside])
        block, word = np.divmod(pairs, len(self.words))
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(block)))
        at = np.arange(len(block)) - np.repeat(first, size)
        rest = np.repeat(size, size) - at
        # prefix filter: a row for each word of a block and prefix that has it; the first of a block and template stays
        low, high = (np.searchsorted(self.prefix_word, word, side=side) for side in ("left", "right"))
        row = np.repeat(np.arange(len(block)), high - low)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
        template = self.prefix_of[entry]
        _, once = np.unique(block[row] * len(self.labels) + template, return_index=True)
        row, entry, template = row[once], entry[once], template[once]
        need = self.need[template]
        lengths = np.array([len(s) for s in self.sets], np.int64)[template]
        fits = (at[row] + rest[row] >= need) & (np.minimum(rest[row], lengths - self.prefix_at[entry]) >= need)
        for t in np.unique(template[fits]).tolist():
            wanted = np.unique(block[row[fits & (template == t)]])
            shared = np.isin(word, self.sets[t]) & np.isin(block, wanted)
            found, n = np.unique(block[shared], return_counts=True)
            for b, k in zip(found[n >= self.need[t]].tolist(), n[n >= self.need[t]].tolist(), strict=True):
                d = int(np.searchsorted(base, b, side="right")) - 1
                yield d, b - int(base[d]), t, k / len(self.sets[t])

    def places(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """label, and the texts and places in them where a phrase stands."""
        for phrase, label in self.phrases:
            at = np.flatnonzero(numbers == phrase[0])
            for k, w in enumerate(phrase[1:], 1):
                at = at[at + k < len(numbers)]
                at = at[numbers[at + k] == w]
            text = np.searchsorted(bounds, at, side="right") - 1
            whole = at + len(phrase) <= bounds[text + 1]
            yield label, text[whole], (at - bounds[text])[whole]


def frequencies(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """How often each of these words stands in all documents."""
    wanted = pa.array([w.encode() for w in words], pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "text", SLICE):
            found = split_words(batch.column(0), _BETWEEN, lower=True)[0].dictionary_encode()
            known = pc.fill_null(pc.index_in(found.dictionary, wanted), -1).to_numpy()
            times = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(known)) if len(found) else np.zeros(0, np.int64)
            total.update(dict(zip(known[known >= 0].tolist(), times[known >= 0].tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = LEAST) -> DataFrame:
    """docs (text and others) with FIELDS after its columns, in place of its own of these names. blocks: the words (from, up to) that hold a template (its number in templates), and its share."""
    small_batches(docs)
    docs = docs.drop(*FIELDS.names)
    words = Templates(templates, phrases, least).words
    known = Templates(templates, phrases, least, frequencies(docs, words))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = _scanned(known, batch.column(batch.schema.get_field_index("text")))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("template", pa.int64()), ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)]], names=[*batch.schema.names, *FIELDS.names])

    return docs.mapInArrow(walk, T.StructType([*docs.schema.fields, *FIELDS.fields]))


def _scanned(known: Templates, texts: pa.Array) -> list[tuple]:
    words, bounds = split_words(texts, _BETWEEN, lower=True)
    numbers, sizes = known.numbers(words), np.diff(bounds)
    base: dict[int, list[tuple[int, str]]] = {}
    for label, text, place in known.places(numbers, bounds):
        for d, at in zip(text.tolist(), place.tolist(), strict=True):
            base.setdefault(d, []).append((at, label))
    blocks: dict[int, list[tuple[int, int, int, float]]] = {}
    for d, b, t, share in known.joined(numbers, bounds):
        start = b * (BLOCK // 2)
        blocks.setdefault(d, []).append((start, min(start + BLOCK, int(sizes[d])), t, share))
    out = []
    for d, n in enumerate(sizes.tolist()):
        stands, held = base.get(d, []), sorted(blocks.get(d, []))
        labels = {label for _, label in stands}
        places = [at for at, _ in stands]
        score = 1.0 if stands else max([0.0, *(x[3] for x in held)])
        both = labels | {known.labels[x[2]] for x in held}
        out.append((n, len(stands), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), score, [dict(zip(("start", "end", "template", "share"), x, strict=True)) for x in held]))
    return out


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *FIELDS.names[:-1])


def _sql() -> str:
    """Places by neighbouring words, and every block counted against every template, without filters."""
    chains = [(words_of(p), label) for p, label in PHRASES]
    places = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM words WINDOW o AS (PARTITION BY rid ORDER BY i) QUALIFY w = '{p[0]}'" + "".join(f" AND lead(w, {k}) OVER o = '{x}'" for k, x in enumerate(p[1:], 1)) for p, label in chains
    )
    sets = [sorted(set(words_of(text))) for _, text in TEMPLATES]
    values = ", ".join(f"({t}, '{label}', {len(s)}, {needed(len(s))}, ['{"', '".join(s)}'])" for t, ((label, _), s) in enumerate(zip(TEMPLATES, sets, strict=True)))
    half = BLOCK // 2
    return rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), words AS (
  SELECT rid, len(ws) AS n, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM docs
), places AS (
  {places}
), base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid
), templates AS (
  SELECT t, label, size, need, unnest(ws) AS w FROM (VALUES {values}) AS x(t, label, size, need, ws)
), blocks AS (
  SELECT rid, b, t, label, count(DISTINCT w) / size AS share
  FROM (SELECT rid, w, n, unnest([i // {half}, i // {half} - 1]) AS b FROM words) JOIN templates USING (w)
  WHERE b >= 0 AND b < greatest(1, ceil((n - {half}) / {half})) GROUP BY rid, b, t, label, size, need HAVING count(DISTINCT w) >= need
), found AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM blocks UNION ALL SELECT rid, label FROM places) GROUP BY rid
), best AS (
  SELECT rid, max(share) AS share FROM blocks GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN found USING (rid) LEFT JOIN best USING (rid)
"""


ORACLE = _sql()
