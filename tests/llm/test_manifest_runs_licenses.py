"""Operators 11 to 13: against their SQL on odd tables, and against plain versions written from the contract."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from loam.llm import licenses, merkle, periods
from tests.llm import brute
from tests.llm.test_llm import DOCS, matches_sql, put, rows_of

ODD = [None, "", " \n\t\x0b", "one", "a a a a a a", "a a a a a", "a b a b a b a b", "a b a b a b a", "x " * 3000, "é è " * 90, "日本 語\n" * 30, "A a " * 8, "q" * 100_000]


def plain_runs(w):
    """All runs, by trying each period and each start."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts():
    r = random.Random(21)
    made = []
    for k in range(120):
        w = [r.choice("ab" if k % 3 == 0 else "abcdefgh") for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("abc") for _ in range(r.randint(1, 7))]
            at = r.randint(0, len(w))
            w[at:at] = unit * r.randint(2, 9) + unit[: r.randint(0, len(unit))]
        made.append((" " if k % 2 else "\n \t").join(w))
    return made


def test_periodic_runs_by_sql(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD + periodic_texts())] + [(None, "a " * 9, None, None, None)] * 2 + [(30, "b " * 9, "en", "s", 1)]
    put(spark, str(tmp_path), "documents", [(*x, 1, "y") for x in rows], DOCS + ", n_runs int, planted string")
    matches_sql(spark, str(tmp_path), "op11_periodic_runs", ["documents"])
    put(spark, str(tmp_path), "documents", [], DOCS)
    assert rows_of(periods.op11_periodic_runs(spark, str(tmp_path))) == []


def test_periodic_runs_by_trying_all(spark):
    texts = ODD[:12] + periodic_texts()
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)], "doc_id long, text string, start int, other string")
    found = periods.find(docs)
    assert found.columns == ["doc_id", "text", "other", *periods.FIELDS.names]
    some = 0
    for x in found.collect():
        w = brute.words(texts[x.doc_id])
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (x.n_runs, x.runs_sha256) == (len(runs), brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)))
        assert x.collapsed_sha256 == brute.sha(" ".join(y for i, y in enumerate(w) if i not in gone))
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (x.start, x.length, x.period, x.exponent_milli) == (s, n, q, 1000 * n // q)
            some += 1
        else:
            assert (x.start, x.length, x.period, x.exponent_milli) == (None,) * 4
    assert some > 60


@pytest.mark.parametrize("frequent", [1, 64, 10**9])
def test_lag_counts(monkeypatch, frequent):
    """By FFT, by both and by differences of places: the same exact counts."""
    monkeypatch.setattr(periods, "FREQUENT", frequent)
    if frequent == 1:
        monkeypatch.setattr(np, "sqrt", lambda x: np.zeros_like(x, dtype=float))
    g = np.random.Generator(np.random.PCG64(3))
    sizes = [0, 1, 700, 3, 0, 4000, 9]
    parts = [np.where(g.random(n) < 0.5, 0, g.integers(0, 40, n)) for n in sizes]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    counts, base = periods.lag_counts(np.concatenate(parts).astype(np.int64), bounds)
    for d, w in enumerate(parts):
        assert counts[base[d] + 1 : base[d + 1]].tolist() == [int((w[:-q] == w[q:]).sum()) for q in range(1, len(w) // 4 + 1)]


def test_long_texts_of_few_words():
    """One word, two in turn, two at random: no lag is scanned in vain."""
    g = np.random.Generator(np.random.PCG64(4))
    for codes, want in ((np.zeros(200_000, np.int64), [(0, 200_000, 1)]), (np.arange(200_000) % 2, [(0, 200_000, 2)]), (g.integers(0, 2, 60_000), None)):
        began = time.time()
        counts, base = periods.lag_counts(codes, np.array([0, len(codes)]))
        runs = periods.runs_of(codes, counts)
        assert (want is None or runs == want) and time.time() - began < 30
        for s, n, q in runs:
            assert (codes[s : s + n - q] == codes[s + q : s + n]).all() and n >= max(6, 4 * q)
            assert (s == 0 or codes[s - 1] != codes[s - 1 + q]) and (s + n == len(codes) or codes[s + n] != codes[s + n - q])


def plain_manifest(rows):
    """(leaf, subroot, root, siblings level by level) of rows (doc_id, source, lang, n_chars, text) with distinct ids."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        paths, places = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(places):
                run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
                paths[i].append((run[: at % 3], run[at % 3 + 1 :]))
            nodes = [brute.sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
            places = [at // 3 for at in places]
        return nodes[0], paths

    leaves = {x[0]: brute.sha("".join(map(field, x))) for x in rows}
    sources = sorted({x[1] for x in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaves[i] for i in sorted(x[0] for x in rows if x[1] == s)]) for s in sources}
    root, above = climb([trees[s][0] for s in sources])
    out = {}
    for s, up in zip(sources, above, strict=True):
        for i, path in zip(sorted(x[0] for x in rows if x[1] == s), trees[s][1], strict=True):
            out[i] = (leaves[i], trees[s][0], root, path + up)
    return out


def test_merkle_manifest(spark, tmp_path, monkeypatch):
    r = random.Random(22)
    sources = ["hot"] * 6 + [None, "", "é", "z", "a" * 30, "one\n"]
    rows = [(i * 3 - 200, r.choice([None, "", "line\nline", "no break", "\n", "é\n" * 9]), r.choice(["en", None]), r.choice(sources), r.choice([None, i])) for i in range(700)] + [(9000, "x\n" * 50_000, "en", "alone", 5)]
    for levels in (6, 2):  # one pass; several passes of few levels
        monkeypatch.setattr(merkle, "LEVELS", levels)
        put(spark, str(tmp_path), "documents", [(*x, "l", 1) for x in rows], DOCS + ", leaf string, at int")
        matches_sql(spark, str(tmp_path), "op12_merkle_manifest", ["documents"])
    want = plain_manifest([(i, s, lang, n, t) for i, t, lang, s, n in rows])
    for x in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect():
        leaf, subroot, root, path = want[x.doc_id]
        assert (x.leaf, x.subroot, x.root, x.proof_sha256) == (leaf, subroot, root, brute.sha("".join("".join(a + b) for a, b in path)))
    text = {i: t for i, t, *_ in rows}
    checked = {x.doc_id: x.verified for x in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    assert checked == {i: zlib.crc32(str(i).encode()) % 2 == 1 or "\n" not in (t or "") for i, t in text.items()}


def test_merkle_manifest_of_odd_tables(spark, tmp_path):
    odd = [(None, "a\n", None, None, None), (None, "b\n", None, None, None), (7, "q\n", "en", "s", 2), (7, "q\n", "en", "s", 2), (7, "r", "en", "s", 2), (8, None, "en", "s", 0)]
    for rows in (odd, odd[:1], odd[2:4]):
        put(spark, str(tmp_path), "documents", rows, DOCS)
        matches_sql(spark, str(tmp_path), "op12_merkle_manifest", ["documents"])
    put(spark, str(tmp_path), "documents", [], DOCS)
    assert rows_of(merkle.op12_merkle_manifest(spark, str(tmp_path))) == []


def filler(r, n):
    return [r.choice("alpha beta gamma delta the of and license under any software copy work".split()) for _ in range(n)]


def test_license_scan(spark, tmp_path):
    r = random.Random(23)
    rows, want = [], {}
    for i in range(160):
        label, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = text.split()
        if i % 4 == 1:
            w = [x for k, x in enumerate(w) if k % 12]  # a twelfth goes
        if i % 4 == 2:
            w = w[: len(w) // 2]
        before = r.choice([0, 5, 100, 127, 128, 129, 255, 256, 300, 1000])
        made = " ".join(filler(r, before)) + "\n" + (" " if i % 3 else "\n  * ").join(w).upper() + "\n" + " ".join(filler(r, r.choice([0, 7, 400])))
        rows.append((i, made, "en", "s", 1))
        if i % 4 in (0, 3):
            want[i] = label
    rows += [(500 + i, t, "en", "s", 1) for i, t in enumerate([None, "", " .,; ", "MIT license", "the mit-License; Apache\nLICENSE and cc by", "cc", "gnu general public licenses", "gnu general public license gnu general public license", "É MIT LICENSE", "mit license " * 20_000, "mit", "license"])]
    rows += [(None, "cc by", None, None, None)] * 2 + [(600, "mit license", "en", "s", 1)] * 2
    put(spark, str(tmp_path), "documents", [(*x, "q", 2) for x in rows], DOCS + ", labels string, blocks int")
    matches_sql(spark, str(tmp_path), "op13_license_scan", ["documents"])
    got = {x.doc_id: x for x in licenses.op13_license_scan(spark, str(tmp_path)).collect()}
    assert all(label in got[i].labels.split(",") for i, label in want.items())
    assert got[504].base_labels == "apache,cc-by,mit" and got[504].n_base == 3 and got[510].n_base == got[511].n_base == 0
    assert (got[509].n_base, got[509].first_word, got[509].last_word) == (20_000, 0, 39_998)
    put(spark, str(tmp_path), "documents", [], DOCS)
    assert rows_of(licenses.op13_license_scan(spark, str(tmp_path))) == []


def test_license_blocks(spark):
    """The blocks themselves, their order by the documents' own counts, and what a template may be."""
    r = random.Random(24)
    notice = "alpha beta gamma rare1 rare2 rare3 rare4 rare5 rare6 rare7"
    texts = [" ".join(filler(r, n) + notice.split()[k:] + filler(r, m)) for n, m, k in ((0, 0, 0), (200, 60, 0), (600, 0, 1), (120, 300, 2), (50, 50, 3))]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(9, None, 3)], "doc_id long, text string, score int")
    found = {x.doc_id: x for x in licenses.scan(docs, [("own", notice)], []).collect()}
    for i, t in enumerate(texts):
        w, held = t.split(), set(notice.split())
        starts = range(0, max(1, len(w) - 128), 128)
        want = [(s, min(s + 256, len(w)), 0, len(held & set(w[s : s + 256])) / 10) for s in starts if len(held & set(w[s : s + 256])) >= 8]
        assert [tuple(b) for b in found[i].blocks] == want and found[i].labels == ("own" if want else "")
    assert found[9].blocks == [] and found[9].score == 0 and len(found) == 6
    counted = licenses.frequencies(docs, ["alpha", "rare1", "never"])
    assert counted == {w: sum(t.split().count(w) for t in texts) for w in ("alpha", "rare1")}
    assert licenses.Templates([("own", notice)], [], 80, counted | {"beta": 10**6}).words[-1] == "beta"
    for bad in ("", "word " * 129):
        with pytest.raises(ValueError):
            licenses.scan(docs, [("bad", bad)])
    assert {x.labels for x in licenses.scan(docs, [], []).collect()} == {""}


def test_word_digest_of_runs_is_of_utf8():
    assert periods._digest("é") == hashlib.sha256("é".encode()).hexdigest()
    assert Counter(licenses.words_of("Ab_c-É 1x\x7f2")) == Counter(["ab", "c", "É", "1x", "2"])
