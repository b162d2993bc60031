"""Language ID by cross-parsing: a text is cut into the longest phrases that occur in a language's labelled text, found by
walking that text's suffix automaton; the language that needs the fewest, normalised phrases wins.

The normalised number is phrases * log2(length of the labelled text) / length of the text: an estimate of the cross
entropy, so languages with less labelled text are not favoured.

Labelled text is a bounded sample: about SAMPLE documents a language, spread by a hash of doc_id, at most CHARS characters
of their words a language and ALL_CHARS in all. It is broadcast; each Python worker builds the automata once.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if nothing could be learned;
ties go to the smaller language; a null doc_id is not held out; rows without language or text teach nothing; repeated rows
repeat; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.shared import slices, small_batches, table

SAMPLE, CHARS, ALL_CHARS = 200, 30_000, 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> str:
    """The words of letters, lower-cased, one space between; empty if there is no letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return " ".join(found) if any(w.isalpha() or any(map(str.isalpha, w)) for w in found) else ""


def suffix_automaton(text: str) -> dict:
    """The start state; a state maps a character to the next state. A walk succeeds just for the substrings of text."""
    states: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(states)
        states.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in states[p]:
            states[p][c] = cur
            p = link[p]
        if p >= 0:
            q = states[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(states)
                states.append(dict(states[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and states[p].get(c) == q:
                    states[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    for state in states:
        for c, to in state.items():
            state[c] = states[to]
    return states[0]


def phrases(text: str, start: dict) -> int:
    """How many longest matches cover text from the left; a character that never occurs is a phrase of its own."""
    n, state = 0, start
    for c in text:
        after = state.get(c)
        if after is None:
            if state is not start:
                n += 1
            after = start.get(c)
            if after is None:
                n += 1
                after = start
        state = after
    return n + (state is not start)


class Languages:
    def __init__(self, texts: dict[str, str]):
        self.known = [(lang, suffix_automaton(text), math.log2(len(text) + 1)) for lang, text in sorted(texts.items()) if text]

    def judge(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.known:
            return "und", 0.0
        costs = sorted((phrases(words, start) * weight / len(words), lang) for lang, start, weight in self.known)
        if len(costs) == 1:
            return costs[0][1], 1.0
        best, second = costs[0][0], costs[1][0]
        return costs[0][1], min(1.0, max(0.0, 1 - best / second)) if second > 0 else 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame) -> dict[str, str]:
    """Labelled text by language, from a bounded sample of the documents that are not held out: of each an equal share of the characters, from a place that a hash says."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64(F.lit("learn"), "doc_id").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(ALL_CHARS // 1000).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * SAMPLE / n))])
    picked = rows.filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    each = min(CHARS, ALL_CHARS // len(counts))
    few = picked.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64("text")))).filter(F.col("rn") <= SAMPLE)
    size = F.ceil(F.lit(each) / F.count("*").over(W.partitionBy("lang"))).cast("int")
    start = F.pmod(F.xxhash64(F.lit("start"), "h"), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    few = few.select("lang", "rn", F.substring("text", start, size).alias("text"))
    out: dict[str, str] = {}
    for row in sorted(few.toLocalIterator(), key=lambda r: (r["lang"], r["rn"])):
        held = out.get(row["lang"], "")
        if len(held) < each and (words := words_of(row["text"])):
            out[row["lang"]] = f"{held}\n{words}"[: each + 1] if held else words[:each]
    return out


_built: dict[int, Languages] = {}


def identify(docs: DataFrame, learn_from: DataFrame | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score, under these names, after its own columns."""
    small_batches(docs)
    texts = labelled(docs if learn_from is None else learn_from)
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    mark = hash(tuple(sorted(texts.items())))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _built:
            _built.clear()
            _built[mark] = Languages(sent.value)
        known = _built[mark]
        for batch in slices(batches, "text", 4 << 20):
            judged = [known.judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in judged], pa.string()), pa.array([x[1] for x in judged], pa.float64())], names=[*columns, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
