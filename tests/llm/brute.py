"""Plain versions of the operators for small inputs, written from their contracts."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jaccard(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for i, text in rows:
        w = [x.translate(LOWER) for x in words(text)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(texts, w=400):
    """(kept bytes, removed, spans) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(gone), spans))
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
