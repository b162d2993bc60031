import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import chat, fingerprints, jaccard, languages, mixing, quality, queries, repeats, search, tokens, urls
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def matches_sql(spark, folder, name, tables):
    """The query's rows over folder are those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, folder)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert Counter(rows_of(got)) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 50)) for _ in range(150)) for _ in range(3)]
    shared = " ".join(f"shared{i}" for i in range(60))
    out = [None, "", " \n\t", "One", "one", "one two THREE", "One  Two\tthree", "a" * 900, "ab" * 500, "x " * 700, "é" * 450, "日本語😀" * 150]
    for _ in range(90):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"z{r.randint(0, 9999)}"
        if r.random() < 0.3:
            w = [f"q{r.randint(0, 10**6)}" for _ in range(r.randint(20, 60))] + shared.split()
        out.append(" ".join(w))
    out.append(" ".join(f"w{i % 977}" for i in range(30_000)))  # very long
    return out


def test_top_k(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(16)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None] * 8), (400, [float("nan")] * 16), (None, [0.5] * 16), (451, rows[0][1]), (452, rows[0][1]), (500, []), (550, [0.1] * 4), (551, [0.2] * 4), (551, [0.2] * 4)]
    put(spark, str(tmp_path), "embeddings", [(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    matches_sql(spark, str(tmp_path), "op1_top_k", ["embeddings"])
    small = search.top_k(search.quantised(spark.createDataFrame(rows[:300], "vec_id long, embedding array<double>")), search.quantised(spark.createDataFrame(rows[:300:50], "vec_id long, embedding array<double>")), 3, tile=64, group=2)
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows[:300]}
    want = []
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(rows_of(small)) == sorted(want)
    put(spark, str(tmp_path), "embeddings", [], "vec_id long, embedding array<float>")
    assert rows_of(search.op1_top_k(spark, str(tmp_path))) == []


def test_top_k_of_many_tiles_meets_all_rows(spark):
    """Tiles and groups that do not fall into one partition; their keys were of two types, which meet only by luck."""
    r = random.Random(7)
    rows = [(i, [r.randint(-200, 200) for _ in range(8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    coalesce = spark.conf.get(key)
    spark.conf.set(key, False)
    try:
        got = sorted(rows_of(search.top_k(frame, frame.filter("vec_id % 10 = 0"), 5, tile=50, group=10)))
    finally:
        spark.conf.set(key, coalesce)
    want = []
    for q, x in rows[::10]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_mixing(spark, tmp_path, texts):
    r = random.Random(2)
    rows = [(i, t, "en", r.choice(["a", "b", "ä", "", None, "zero"]), i) for i, t in enumerate(texts)] + [(500, None, "en", "nothing", 0), (5, texts[20], None, "a", 1), (5, texts[20], None, "a", 1), (None, "x y z", None, None, None)]
    put(spark, str(tmp_path), "documents", rows, DOCS)
    matches_sql(spark, str(tmp_path), "op2_mixing", ["documents"])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = Counter({(x.doc_id, x.source): 0 for x in mixing.copies(docs).collect()})
    for x in mixing.copies(docs).collect():
        want[x.doc_id, x.source] += x.copies
    got = Counter((x.doc_id, x.source) for x in mixing.mix(docs).collect())
    assert got == +want and mixing.mix(docs).columns == docs.columns
    assert rows_of(mixing.copies(docs.limit(0))) == []


def test_mix_does_not_depend_on_where_rows_stand(spark):
    r = random.Random(16)
    rows = [(None, f"w{i} x y z", "s", i % 3) for i in range(200)] + [(7, f"a b {i % 5}", None, i) for i in range(60)]
    seen = []
    for _ in range(3):
        r.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(r.randint(2, 7))
        seen.append(Counter(rows_of(mixing.mix(docs))))
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) > 1


def test_jaccard(spark, texts, monkeypatch):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, node string").repartition(3)
    want = brute.jaccard(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs).collect()} == want
    monkeypatch.setattr(jaccard, "SMALL", 3)  # regions are cut again
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs).collect()} == want
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)  # wanted texts are found by a shuffle of those that may be
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs).collect()} == want
    real = jaccard._node
    monkeypatch.setattr(jaccard, "_node", lambda salt: real(salt) if salt > 1 else F.pmod(real(salt), F.lit(5)))  # sets share keys, and meet others once more when they move
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs).collect()} == want
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (7, "a b c d e f")], "doc_id long, text string")
    assert Counter(rows_of(jaccard.join(odd))) == Counter({(None, 2, 7): 1, (7, 2, 7): 2, (None, 0, None): 1})
    assert rows_of(jaccard.join(odd.limit(0))) == []


def test_jaccard_links_through_null_ids(spark):
    """A hangs together with C only by B; B's id does not matter for that."""
    w = [f"w{i}" for i in range(63)]
    a, b, c = " ".join(w[:50]), " ".join(w[:56]), " ".join(w)
    chain = brute.jaccard([(1, a), (2, b), (3, c)])
    assert {x for _, x in chain.values()} == {1} and {x for _, x in brute.jaccard([(1, a), (3, c)]).values()} == {1, 3}
    for given in (2, None, -9):
        got = jaccard.join(spark.createDataFrame([(1, a), (given, b), (3, c)], "doc_id long, text string"))
        assert {x.component_id for x in got.collect()} == {min(1, given or 1)}
    alone = jaccard.labelled(spark.createDataFrame([(None, a), (None, b), (None, c), (4, "x y")], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.component_id) for x in alone} == {(None, None), (4, 4)} and sum(x.first for x in alone) == 2


def test_long_words_are_told_apart():
    """A Thue-Morse word and its complement have equal sums modulo 2^64."""
    import numpy as np

    def one(text):
        return jaccard.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist()

    morse = [bin(i).count("1") % 2 for i in range(4096)]
    x, y = "".join("ab"[i] for i in morse), "".join("ba"[i] for i in morse)
    assert one(x) != one(y) and one(x) == one(x.upper())
    z = np.frombuffer((x + y).encode(), np.uint8)
    row, start, n, _, run, _ = repeats.window_runs(z, np.array([0, 4096, 8192]))
    text = {r: z[s : s + k - 1 + repeats.WIDTH].tobytes() for r, s, k in zip(run.tolist(), start.tolist(), n.tolist(), strict=True)}
    assert all(text[r] == z[s : s + k - 1 + repeats.WIDTH].tobytes() for r, s, k in zip(run.tolist(), start.tolist(), n.tolist(), strict=True))


def test_repeats(spark, tmp_path, texts, monkeypatch):
    r = random.Random(3)
    base = "".join(r.choice("abcdé ") for _ in range(2500))
    passage = " ".join(f"p{i}q" for i in range(56))  # over 50 words, under 400 bytes
    more = [base, base[:1200] + "#" + base[1201:], base[300:900], base[300:700], "a" * 399, "a" * 400, "a" * 401, base[:450] * 2, f"one {passage} way", f"or {passage} another"]
    all_texts = texts[:60] + more + [more[0], texts[20]]
    put(spark, str(tmp_path), "documents", [(i, t, "en", "s", 1, 2, "x", 3) for i, t in enumerate(all_texts)], DOCS + ", row_id int, th string, spans int")
    put_wide = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want, short = brute.repeats(all_texts), brute.repeats(all_texts, repeats.SHORT)
    for hot in (repeats.HOT, 1000):  # all buckets by tasks; large ones by counts
        monkeypatch.setattr(repeats, "HOT", hot)
        got = {x.doc_id: x for x in repeats.op8_suffix_dedup(spark, str(tmp_path)).collect()}
        for i, (kept, removed, spans) in enumerate(want):
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len((all_texts[i] or "").encode()), removed, spans, brute.sha(kept)), i
            assert got[i].n_repeated == short[i][1], i
        assert got[68].in_passages and got[69].in_passages and not got[68].n_removed and not got[66].in_passages
    monkeypatch.setattr(repeats, "MOST_DOCS", 0)  # texts that may have repeats are shuffled
    assert {x.doc_id: x for x in repeats.op8_suffix_dedup(spark, str(tmp_path)).collect()} == got
    for width, cuts in ((repeats.WIDTH, want), (repeats.SHORT, short)):
        cut = {x.doc_id: x.text for x in repeats.dedup(put_wide, width).collect()}
        assert all(cut[i] == (t if not cuts[i][1] else cuts[i][0].decode(errors="ignore")) for i, t in enumerate(all_texts))
    assert repeats.dedup(put_wide).columns == put_wide.columns and rows_of(repeats.dedup(put_wide.limit(0))) == []


def test_repeats_of_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(13)
    x, y = ("".join(r.choice("abcdef") for _ in range(600)) for _ in range(2))
    rows = [(None, x), (None, x[:500]), (7, y), (7, y), (7, None), (8, y[:399]), (8, y[:400]), (None, None)]
    put(spark, str(tmp_path), "documents", rows, "doc_id long, text string")
    want = Counter((i, len((t or "").encode()), n, k, brute.sha(kept)) for (i, t), (kept, n, k) in zip(rows, brute.repeats([t for _, t in rows]), strict=True))
    assert Counter(tuple(x)[:5] for x in repeats.op8_suffix_dedup(spark, str(tmp_path)).collect()) == want
    put(spark, str(tmp_path), "documents", [], "doc_id long, text string")
    assert rows_of(repeats.op8_suffix_dedup(spark, str(tmp_path))) == []


def test_long_text_in_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "STRIDE", 500)
    data = np.frombuffer(random.Random(4).randbytes(3000), np.uint8)
    starts = sorted(s + shift for piece, bounds, shift in repeats._pieces(data, np.array([0, 3000])) for _, s, n, *_ in [repeats.window_runs(piece, bounds)] for s, n in zip(s.tolist(), n.tolist()) for s in range(s, s + n))
    assert starts == list(range(3000 - repeats.WIDTH + 1))


def test_sentencepiece(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    r = random.Random(6)
    parts = [" ", "  ", "    ", "a", "th", "tion", "é", "日", "😀", "\n", "\t", "0", ".", "▁", "\x00", "ข", "<s>", "\xa0"]
    made = texts + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["a" * 5000, " " * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], "doc_id long, text string, ids string")
    for x in tokens.encode(docs, tokens.model_path(), texts=True).collect():
        ids = sp.encode(made[x.doc_id] or "")
        assert (x.ids, x.n_tokens, x.ids_sha256) == (ids, len(ids), brute.sha(",".join(map(str, ids))))
        assert (x.decoded, x.decoded_sha256) == (sp.decode(ids), brute.sha(sp.decode(ids)))
    assert rows_of(tokens.encode(docs.limit(0), tokens.model_path())) == []


def test_url_filter(spark, tmp_path):
    given = [None, "", "no scheme", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/a?b#c", "x://example.com/en", "x://a.example.com/en/", "x://badexample.com/en/x", "x://a.net/fr/", "x://net/es/", "x://net#/es/", "a://b://net/es/", "x://example.com\n/en/", "x://.com/", "x://com./", "x://é.com/é?", "https://user@www.example.com:80/en/"]
    put(spark, str(tmp_path), "pages", [(i, u, "", "r") for i, u in enumerate(given)] + [(None, given[4], None, None)] * 2, "page_id long, url string, html string, rule string")
    matches_sql(spark, str(tmp_path), "op5_url_filter", ["pages"])
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    by_join = urls.judge_by_join(pages, spark.createDataFrame(urls.RULES, "host string, path string, verdict string"))
    assert Counter(rows_of(by_join)) == Counter(rows_of(urls.judge(pages, urls.RULES)))
    assert {x.verdict for x in urls.judge(pages, [], "block").collect()} == {"block"}
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    long = spark.createDataFrame([(1, "x://www.example.com/en/" + "a/" * 50_000), (2, "x://" + "a." * 300 + "net/fr/")], "page_id long, url string")
    assert sorted(rows_of(urls.judge_by_join(long, rules))) == sorted(rows_of(urls.judge(long, urls.RULES)))
    assert rows_of(urls.judge_by_join(pages.limit(0), rules)) == [] == rows_of(urls.judge(pages.limit(0), urls.RULES))
    assert {x.verdict for x in urls.judge_by_join(pages, rules.limit(0), "block").collect()} == {"block"}


def test_digests_that_collide(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: 7)
    array = urls.DigestArray(*urls.DigestArray.parts([("a", "/", "allow"), ("b", "/", "block")]))
    assert array.find([b"b\0/", b"a\0/", b"c\0/"]) == [b"b\0/\0block", b"a\0/\0allow", None]


def test_fingerprints(spark, tmp_path, texts):
    put(spark, str(tmp_path), "documents", [(i * 7 - 50, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    given = sorted((i * 7 - 50, t or "") for i, t in enumerate(texts))
    got = {x.doc_id: x for x in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(given)
    for k, (i, t) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), brute.sha(edited))
        marks = [fingerprints.Walk(s).fingerprint() for s in (t, edited, after)]
        assert [x.fingerprint, x.edited_fingerprint] == marks[:2]
        assert (x.near_edited, x.near_next) == (fingerprints.likeness(*marks[:2]), fingerprints.likeness(marks[0], marks[2]))
        assert 0 <= x.near_next <= 1 and 0 <= x.near_edited <= 1 and (t != edited or x.near_edited == 1)
    docs = spark.createDataFrame([(3, "a"), (3, "a"), (None, "b"), (1, None)], "doc_id long, text string")
    assert fingerprints.in_stretches(docs, 1).filter("NOT guest").count() == 4
    assert rows_of(fingerprints.fingerprint(docs.limit(0))) == []


def test_near_documents(spark):
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh ") for _ in range(2000))
    rows = [(0, base), (1, base), (2, base[:1800] + "x" + base[1801:]), (3, base[::-1]), (4, ""), (5, None)]
    got = dict(rows_of(fingerprints.near_documents(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    many = [(i, base[: 1700 + i] + str(i) * 3 + base[1703 + i :]) for i in range(60)]  # a group that is large
    assert {c for _, c in rows_of(fingerprints.near_documents(spark.createDataFrame(many, "doc_id long, text string")))} == {0}
    assert rows_of(fingerprints.near_documents(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_near_documents_recall(spark):
    """Of all pairs that are alike, by brute force over all, at least 0.9 share a class; no class is larger than links make it."""
    r = random.Random(14)
    made = []
    template = "".join(r.choice("abcdefgh ") for _ in range(400))
    for size in (40, 90, 300, 1500):
        for _ in range(12):
            own = "".join(r.choice("abcdefgh ") for _ in range(size))
            for _ in range(4):
                at = r.randrange(size)
                made.append(own[:at] + r.choice(["", "x", "yz"]) + own[at + r.randint(0, 2) :])
    made += [template + "".join(r.choice("abcdefgh ") for _ in range(r.randint(50, 400))) for _ in range(60)]  # a shared head in all
    marks = [fingerprints.Walk(t).fingerprint() for t in made]
    links = [(i, j) for i in range(len(made)) for j in range(i) if fingerprints.likeness(marks[i], marks[j]) >= 0.8]
    up = list(range(len(made)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        up[max(find(i), find(j))] = min(find(i), find(j))
    got = dict(rows_of(fingerprints.near_documents(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3))))
    assert len(links) > 100 and sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    assert all(find(i) == find(c) for i, c in got.items())


def test_chat(spark, tmp_path):
    control = ["<s>", "</s>", "[INST]", "[/INST]", "[+]", "\\", "[\\INST]", "<\\\\/s>", "a", "\n", "é", "$1", "<", "[", "s>"]
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "[INST]", None]), r.choice([None, ""] + ["".join(r.choice(control) for _ in range(r.randint(0, 6))) for _ in range(5)]), "x") for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(41, 1, "user", "a", "x"), (41, 1, "user", "a", "x"), (41, None, "assistant", "b", "x"), (None, 0, "user", "q", "x")] + [(42, i, "assistant", "long " * 50, "x") for i in range(400)]
    put(spark, str(tmp_path), "conversations", rows, "conv_id long, turn long, role string, text string, pieces string")
    matches_sql(spark, str(tmp_path), "op7_chat_formatting", ["conversations"])
    for x in chat.format_chats(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect():
        assert "".join(p.piece for p in x.pieces) == x.formatted
    put(spark, str(tmp_path), "conversations", [], "conv_id long, turn long, role string, text string")
    matches_sql(spark, str(tmp_path), "op7_chat_formatting", ["conversations"])


def test_language_id(spark, texts):
    got = languages.op9_language_id(spark, SF).alias("p").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").alias("d"), "doc_id").filter("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got)
    a, b, c, d = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    held = next(i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1)
    train = spark.createDataFrame([(a, "the cat sat on the mat", "en"), (b, "der hund und die katze", "de"), (c, None, "fr"), (d, "texte", None), (held, "the und die mat", "xx")], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ² !"), (4, "the mat"), (None, "und die"), (4, "the mat")] + [(9, "the " * 30_000)], "doc_id long, text string")
    judged = Counter((x.doc_id, x.lang_pred) for x in languages.identify(odd, train).collect())
    assert judged == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "en"): 2, (None, "de"): 1, (9, "en"): 1})
    assert {x.lang_pred for x in languages.identify(odd, train.limit(0)).collect()} == {"und"}
    assert rows_of(languages.identify(odd.limit(0), train)) == []


def test_cross_parsing():
    r = random.Random(10)
    learned = "".join(r.choice("abc") for _ in range(300))
    start = languages.suffix_automaton(learned)
    for _ in range(200):
        text = "".join(r.choice("abcd") for _ in range(30))
        n, at = 0, 0
        while at < len(text):
            to = at + 1
            while to < len(text) and text[at : to + 1] in learned:
                to += 1
            n, at = n + 1, to
        assert languages.phrases(text, start) == n


def test_quality(spark, monkeypatch):
    from tests.llm.kneser_ney import perplexities

    given = [None, "", "abcab", "abcabd", "xyz abc", "abcabcabc", "日本\x02é"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(given)], "doc_id long, lang string, text string")
    want = perplexities(given[2:5], [t for t in given if t])
    model = quality.train(docs.filter("doc_id IN (2, 3, 4)"))
    for shard in (quality.SHARD, 7):
        monkeypatch.setattr(quality, "SHARD", shard)
        got = {x.doc_id: x.perplexity for x in quality.perplexities(docs, quality.log_probabilities(quality.strings(docs), model)).collect()}
        assert got[0] is None and got[1] is None
        assert all(got[i] == pytest.approx(want[t], rel=1e-5) for i, t in enumerate(given) if t)
    r = random.Random(11)
    clean = [(i, "en", " ".join(r.choice(["the", "cat", "sat", "mat"]) for _ in range((60, 60, 20, 5, 3)[i % 5]))) for i in range(120)]
    odd = clean + [(900, "en", "$%&" * 80), (901, None, "the cat sat"), (902, "xx", None), (None, "en", "the mat"), (5, "en", clean[5][2])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(900, 0, 0), (100, None, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(odd, "doc_id long, lang string, text string"), labels).collect()
    assert len(out) == len(odd)
    gone = {x.doc_id for x in out if not x.keep}
    assert {900, 902} <= gone and not {901, None} & gone and len(gone) <= 5  # the quantile leaves out a hundredth or so of the clean
    assert all(x.keep for x in quality.classify(spark.createDataFrame(clean, "doc_id long, lang string, text string"), labels.limit(0)).collect())


def test_short_texts_have_a_threshold(spark):
    """Every text has a threshold. Short bad texts all go; of twenty good ones of two to five words some go too (15 stay here, see README)."""
    r = random.Random(15)
    some = lambda least, most: " ".join(r.choice(["the", "cat", "sat", "mat"]) for _ in range(r.randint(least, most)))
    rows = [(i, "en", some(*((4, 60) if i % 3 else (2, 5)))) for i in range(240)] + [(1000 + i, "en", some(2, 5)) for i in range(20)]
    rows += [(2000 + i, "en", "".join(r.choice("$%&#@!~^") for _ in range(r.randint(4, 30)))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels).collect()
    kept = {x.doc_id for x in out if x.keep}
    assert sum(1000 <= i < 2000 for i in kept) >= 14 and not any(i >= 2000 for i in kept) and all(x.threshold for x in out)


def test_quality_broadcasts_a_bounded_table(spark, monkeypatch):
    """Whatever the number of strings, SHARD of them at most pass the driver, and the documents are read once."""
    r = random.Random(12)
    docs = spark.createDataFrame([(i, "en", "".join(r.choice("abcdefg") for _ in range(300))) for i in range(30)] + [(3, "en", "twice " * 9)] * 2 + [(None, None, "")], "doc_id long, lang string, text string").repartition(3)
    log_p = quality.log_probabilities(quality.strings(docs), quality.train(docs.limit(10))).cache()
    want = sorted((str(x.doc_id), x.n_chars, round(x.perplexity or 0, 3)) for x in quality.perplexities(docs, log_p).collect())
    sent, send, passes, walk = [], type(spark.sparkContext).broadcast, [], type(docs).mapInArrow
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(value[0])) or send(self, value))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: passes.append(1) or walk(self, *a, **b))
    monkeypatch.setattr(quality, "SHARD", 200)
    monkeypatch.setattr(quality, "PIECE", 50, raising=False)
    got = sorted((str(x.doc_id), x.n_chars, round(x.perplexity or 0, 3)) for x in quality.perplexities(docs, log_p).collect())
    assert got == want and len(got) == 33
    assert 0 < sum(sent) <= 200 < log_p.count() and len(passes) == 1


def test_pipeline(spark, tmp_path, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    put(spark, str(tmp_path), "documents", rows, DOCS)
    got = Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = [x for x in rows if languages.words_of(x[1])]
    groups = brute.jaccard([x[:2] for x in kept])
    kept = [x for x in kept if groups[x[0]][1] == x[0]]
    kept = [(x[0], k.decode(errors="ignore") if n else x[1], *x[2:]) for x, (k, n, _) in zip(kept, brute.repeats([x[1] for x in kept], corpus_pipeline.PASSAGE))]
    times = {x.doc_id: x.copies for x in mixing.copies(spark.createDataFrame(kept, DOCS)).collect()}
    want = Counter()
    for x in kept:
        ids = sp.encode(x[1])
        want[x[0], len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids))] += times[x[0]]
    assert got == +want and len(want) > 20
    odd = [(None, None, None, None, None), (None, "some words here", None, None, 3), (7, "a b c", "en", "s", 5), (7, "a b c", "en", "s", 5)]
    put(spark, str(tmp_path), "documents", [(*x, 1, 2, 3) for x in odd], DOCS + ", score int, _n int, n int")
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 7}
    wide = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert Counter((x.doc_id, x.text) for x in corpus_pipeline.identify_languages(spark, wide, "").collect()) == Counter({(None, "some words here"): 1, (7, "a b c"): 2})
    given = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "q"), (7, "q"), (7, "q"), (8, None), (None, None), (None, " ")]
    stay = corpus_pipeline.join_near_copies(spark, spark.createDataFrame([(*x, 1, 2) for x in given], "doc_id long, text string, th int, first int"), "")
    kept = Counter((x.doc_id, x.text and x.text.lower()) for x in stay.collect())
    assert stay.columns == ["doc_id", "text", "th", "first"] and kept == Counter({(None, "a b c d e f"): 1, (7, "q"): 1, (8, None): 1, (None, None): 1, (None, " "): 1})
    put(spark, str(tmp_path), "documents", [], DOCS)
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == []
