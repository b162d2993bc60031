"""The stand-in model of late pooling: its tokens and ids are those of a regular expression and crc32, read once a text."""

import random
import re
import time
import zlib
from itertools import pairwise

import numpy as np
import pytest

from loam.operators import pooling

TOKEN = re.compile(r"\w+|[^\w\s]")


def texts():
    r = random.Random(15)
    odd = "aZ9_ ΑΣΣ İıß\n\t  ́‍😀漢字،.-'´ª²\x1f\x85"
    yield from ["", " \n", "ΑΣ", "ΑΣ ΒΣ.Γ Σ", "İstanbul's", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))]
    yield from ("".join(r.choices(odd, k=r.randint(1, 900))) for _ in range(60))
    yield from (" ".join(r.choices(["Alpha", "beta,", "Größe", "d-e", "x_1"], k=r.randint(1, 900))) for _ in range(20))


def plain(tokens):
    """Vectors token by token: windows one after the other, the better one of each place kept."""
    out, central = np.zeros((len(tokens), 8)), [-1] * len(tokens)
    for s, e in pooling.windows(len(tokens), 256):
        own = np.eye(8)[[zlib.crc32(t.lower().encode()) % 8 for t in tokens[s:e]]].reshape(-1, 8)
        for i in range(e - s):
            inner = min(i, e - s - 1 - i)
            if inner > central[s + i]:
                near = own[max(i - 4, 0) : i + 5]
                out[s + i], central[s + i] = own[i] + near.sum(axis=0) / len(near), inner
    return out


def test_tokens_and_ids_are_those_of_the_expression():
    for text in texts():
        offsets = pooling.HASHED.offsets(text)
        tokens = TOKEN.findall(text)
        assert [text[a:b] for a, b in offsets] == tokens
        if tokens:
            assert pooling.HASHED.ids(text, offsets).tolist() == [zlib.crc32(t.lower().encode()) for t in tokens]


def test_pooled_means_of_plain_vectors():
    for text in texts():
        at = [m.span() for m in TOKEN.finditer(text)][:3000]
        text = text[: at[-1][1]] if at else ""
        edges = [*range(0, len(text), 200), len(text)]
        spans = list(pairwise(edges))
        want = pooling.span_means(*np.array(at).T, plain([text[a:b] for a, b in at]), spans).tolist() if at else [None] * len(spans)
        assert pooling.pooled(pooling.HASHED, text, spans) == want


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8, 9, 50])
def test_shared_tokens_are_parted_in_the_middle(size):
    for total in (*range(1, 40), 200):
        model = pooling.TokenModel(lambda t: [], lambda tokens: np.array([[min(i, len(tokens) - 1 - i), t] for i, t in enumerate(tokens)], float), size)
        states = pooling.token_states(model, list(range(total)))
        best = [max(min(t - a, b - 1 - t) for a, b in pooling.windows(total, size) if a <= t < b) for t in range(total)]
        assert states.tolist() == [[n, t] for t, n in enumerate(best)]


def test_ids_are_asked_once_a_text():
    asked = []
    model = pooling.TokenModel(pooling.HASHED.offsets, pooling.HASHED.states, 8, lambda text, offsets: asked.append(len(offsets)) or pooling.HASHED.ids(text, offsets))
    assert len(pooling.pooled(model, "one two " * 100, [(0, 100), (100, 800)])) == 2 and asked == [200]


def test_pooling_costs_less_than_reading_token_by_token():
    """In CPU time, beside twice a loop over the same tokens; it was over three such loops."""
    text = " ".join(f"{w}{i}" if i % 7 == 0 else w for i, w in enumerate(random.Random(1).choices("a quick brown fox, jumps over the lazy dog's Größe".split(), k=150_000)))
    spans = list(pairwise([*range(0, len(text), 800), len(text)]))

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: pooling.pooled(pooling.HASHED, text, spans)) < 2 * least(lambda: [m.span() for m in TOKEN.finditer(text)])
