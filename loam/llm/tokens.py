"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A token sequence is what merging would give if each pair of neighbours is: re-merging the two tokens' text gives these two
again. So a text is covered from the left by the longest vocabulary match (found for all places by one Aho-Corasick pass);
a token that does not fit its left neighbour gives way to the next shorter prefix; where none is left, the place is marked
in a bitfield as failed and the last token is taken back. Work is linear in the text.

No token but runs of spaces has a space mark behind another character, so texts are encoded word by word and words that
recur are looked up, in two bounded tables of each task: when the younger is full it becomes the older.

Defined results: null text is empty; an empty text has no tokens; characters outside the vocabulary become byte tokens;
control strings in texts are plain text; repeated rows repeat; an empty table gives no row; other columns are not read.
The model file is read on the driver (a vocabulary of fixed size) and its pieces are broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loam.llm.shared import slices, small_batches, table

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words that each of a task's two tables keeps, and the longest word that they keep.
KEPT_WORDS, KEPT_LENGTH = 150_000, 64


class Pieces:
    """The vocabulary of a merge-type model: pieces with scores, byte tokens."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unfit: list[bool]):
        import ahocorasick

        self.pieces, self.byte_ids = pieces, byte_ids
        self.byte_of = {t: b for b, t in enumerate(byte_ids)}
        self.scores = {p: s for p, s, no in zip(pieces, scores, unfit, strict=True) if not no}
        self.ids = {p: i for i, (p, no) in enumerate(zip(pieces, unfit, strict=True)) if not no}
        self.lengths = [len(p) for p in pieces]
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matches.add_word(p, (len(p) - 1, i))
        self.matches.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Merging proper: the best-scored neighbours join, the leftmost of equals, until none can. For short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether re-merging the text of two tokens gives these two."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        known = self.fits[a << 32 | b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return known

    def next_shorter(self, a: int) -> int:
        known = self.shorter.get(a)
        if known is None:
            text = self.pieces[a]
            known = self.shorter[a] = next((i for n in range(len(text) - 1, 0, -1) if (i := self.ids.get(text[:n])) is not None), -1)
        return known

    def encode_word(self, text: str) -> list[int]:
        longest = [-1] * len(text)
        for end, (n, i) in self.matches.iter(text):
            longest[end - n] = i  # a later match from the same place is longer
        if -1 not in longest:
            return self._covered(longest, 0, len(text)) if text else []
        out: list[int] = []
        at, n = 0, len(text)
        while at < n:
            if longest[at] < 0:
                out += [self.byte_ids[b] for b in text[at].encode()]
                at += 1
                continue
            to = at
            while to < n and longest[to] >= 0:  # a character without a token joins with nothing
                to += 1
            out += self._covered(longest, at, to)
            at = to
        return out

    def _covered(self, longest: list[int], start: int, end: int) -> list[int]:
        failed = None
        tokens: list[int] = []
        at, token, last = start, longest[start], -1
        lengths, known = self.lengths, self.fits.get
        while True:
            while token >= 0:
                to = at + lengths[token]
                if to <= end and (failed is None or not failed[to - start >> 3] >> (to - start & 7) & 1):
                    if last < 0:
                        break
                    fit = known(last << 32 | token)
                    if self.fit(last, token) if fit is None else fit:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                tokens.append(token)
                at, last = to, token
                if at == end:
                    return tokens
                token = longest[at]
            else:
                if not tokens:
                    raise ValueError("no sequence of tokens covers the text")
                failed = failed or bytearray((end - start) // 8 + 1)
                failed[at - start >> 3] |= 1 << (at - start & 7)
                token = tokens.pop()
                at -= lengths[token]
                last = tokens[-1] if tokens else -1

    def encode(self, text: str) -> list[int]:
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        return [i for word in _WORDS.findall(marked) for i in self.encode_word(word)]

    def decode_part(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_each_bad_byte(bytes(raw)))
                raw.clear()
            if i >= 0:
                out.append(self.pieces[i])
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_part(ids)
        return text[1:] if text[:1] == " " else text


def _each_bad_byte(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + _each_bad_byte(raw[e.start + 1 :])


def read_pieces(model_file: str) -> tuple[list[str], list[float], list[int], list[bool]]:
    """What Pieces takes, from a model file. Only merge-type models with byte tokens, an identity normaliser and a leading space are handled; others are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    kinds = [p.type for p in model.pieces]
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kind.USER_DEFINED in kinds:
        raise ValueError("the model is not of the kind that this operator encodes exactly")
    names = [p.piece for p in model.pieces]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(names, kinds, strict=True) if k == kind.NORMAL):
        raise ValueError("the model has pieces of several words")
    by_name = {p: i for i, p in enumerate(names)}
    out = names, [p.score for p in model.pieces], [by_name[f"<0x{b:02X}>"] for b in range(256)], [k != kind.NORMAL for k in kinds]
    made = Pieces(*out)
    return *out[:3], [no or made.merged(p) != [p] for p, no in zip(names, out[3], strict=True)]  # merging never makes some


_made: dict[int, Pieces] = {}


def _pieces(handle) -> Pieces:
    """One vocabulary a Python worker, for as long as it lives."""
    if handle.id not in _made:
        _made.clear()
        _made[handle.id] = Pieces(*handle.value)
    return _made[handle.id]


class _Model:
    """A broadcast vocabulary with an id that workers keep it by."""

    def __init__(self, spark: SparkSession, model_file: str):
        self.id, self.broadcast = hash(model_file), spark.sparkContext.broadcast(read_pieces(model_file))

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, model_file: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with texts also ids (array of int) and decoded."""
    small_batches(docs)
    model = _Model(docs.sparkSession, model_file)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        young: dict[str, tuple[str, str]] = {}
        old: dict[str, tuple[str, str]] = {}

        def coded(word: str) -> tuple[str, str]:
            """The ids of a word (without its space mark, or with a run of them) and what they decode to, as text."""
            nonlocal young, old
            out = old.get(word)
            if out is None:
                ids = pieces.encode_word(word if word[:1] == SPACE else SPACE + word)
                out = ",".join(map(str, ids)), pieces.decode_part(ids)
            if len(word) <= KEPT_LENGTH:
                if len(young) >= KEPT_WORDS:
                    young, old = {}, young
                young[word] = out
            return out

        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    words = []
                elif SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
                    words = _WORDS.findall(SPACE + text.replace(" ", SPACE))
                else:
                    words = text.split(" ")
                parts = [young.get(w) or coded(w) for w in words]
                ids = ",".join([p[0] for p in parts])
                decoded = "".join([p[1] for p in parts])
                decoded = decoded[1:] if decoded[:1] == " " else decoded
                row = [doc_id, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + [[int(x) for x in ids.split(",")] if ids else [], decoded] * texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
