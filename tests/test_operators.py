"""Small hand-computed cases and properties of the operators."""

import json
import math
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import filters, identity, vectors
from loam.functions import text as T
from loam.operators import caches, chunking, context, dense, evals, fusion, keyword, lifecycle, telemetry
from loam.sources import parsers, readers
from loam.streaming import pipeline


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# points: c_c has no year

A, B, C = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]


@pytest.fixture(scope="module")
def points(spark):
    rows = [("c_a", A, "legal", 2024, ["x", "y"]), ("c_b", B, "legal", 2020, ["y"]), ("c_c", C, "finance", None, None)]
    return spark.createDataFrame(rows, "point_id string, embedding array<double>, department string, year int, tags array<string>")


@pytest.mark.parametrize(
    ("spec", "missing", "want"),
    [
        ({"department": "finance"}, "differs", "c"),
        ({"year": {"$gte": 2024}}, "differs", "a"),
        ({"department": {"$in": ["finance", "hr"]}}, "differs", "c"),
        ({"year": {"$ne": 2024}}, "differs", "bc"),
        ({"year": {"$ne": 2024}}, "fails", "b"),
        ({"year": {"$nin": [2024]}, "department": "finance"}, "differs", "c"),
        ({"year": {"$in": []}}, "differs", ""),
        ({"year": {"$nin": []}}, "differs", "abc"),
        ({}, "differs", "abc"),
        ({"tags": "y"}, "differs", "ab"),
    ],
)
def test_filters(points, spec, missing, want):
    found = points.filter(filters.compiled(spec, missing=missing, arrays=frozenset({"tags"})))
    assert sorted(r.point_id[2:] for r in found.collect()) == list(want)


@pytest.mark.parametrize("spec", [{"a": {"$gt": 1, "$lt": 2}}, {"a": {"$like": 1}}, {"a": {"$in": 3}}, {"a": {}}])
def test_filters_refused(spec):
    with pytest.raises(ValueError):
        filters.validated(spec)


def test_dense_and_upsert(spark, points):
    asked = spark.createDataFrame([(1, A)], "query_id int, query_vector array<double>")
    assert [r.point_id for r in dense.nearest(points, asked, 3).orderBy("rank").collect()] == ["c_a", "c_b", "c_c"]
    assert [r.point_id for r in dense.nearest(points, asked, 1, "euclid").collect()] == ["c_a"]
    assert lifecycle.upserted(points, points, "point_id").count() == 3
    with pytest.raises(Exception, match="expected 3 dimensions"):
        dense.checked_dimensions(points, 3).collect()
    zero = spark.createDataFrame([(A, [0.0] * 4)], "x array<double>, y array<double>")
    assert rows_of(zero.select(vectors.cosine(F.col("x"), F.col("y")), vectors.cosine_distance(F.col("x"), F.col("y")))) == [(0.0, 1.0)]
    again = points.select(vectors.float32_vector(vectors.float32_bytes(F.col("embedding"))).alias("v"))
    assert [r.v for r in again.collect()] == [A, B, C]


def test_dense_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    p = spark.createDataFrame(rows, "point_id int, embedding array<double>")
    q = p.withColumnsRenamed({"point_id": "query_id", "embedding": "query_vector"})
    want = rows_of(dense.nearest(p, q, 4))
    monkeypatch.setattr(dense, "MOST_QUERIES", 7)
    assert sorted(rows_of(dense.nearest(p, q, 4))) == sorted(want)


def leg(spark, ids):
    return spark.createDataFrame([(1, x, i + 1, 1.0 / (i + 1)) for i, x in enumerate(ids)], "query_id int, point_id string, rank int, score double")


def test_fusion(spark):
    a, b = leg(spark, ["x", "y"]), leg(spark, ["y", "x"])
    out = fusion.fused({"dense": (a, 1.0), "bm25": (b, 1.0)}).orderBy("final_rank").collect()
    assert [(r.point_id, r.score) for r in out] == [(p, pytest.approx(1 / 61 + 1 / 62)) for p in "xy"]
    silent = fusion.fused({"dense": (a, 1.0), "bm25": (leg(spark, ["z", "y"]), 0.0)}).collect()
    assert {r.point_id: r.bm25_rank for r in silent} == {"x": None, "y": 2}
    twice = fusion.fused({"dense": (leg(spark, ["x", "x", "y"]), 1.0)}).orderBy("final_rank").collect()
    assert [(r.point_id, r.dense_rank) for r in twice] == [("x", 1), ("y", 3)]
    assert fusion.fused({"dense": (a, 0.0)}).collect() == []
    with pytest.raises(ValueError):
        fusion.fused({"dense": (a, 1.0)}, k=0)
    assert [fusion.depth(10, 100, r) for r in (True, False)] == [100, 10]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 8), unique=True, min_size=1), st.lists(st.integers(0, 8), unique=True, min_size=1))
def test_fusion_properties(spark, x, y):
    a, b = leg(spark, list(map(str, x))), leg(spark, list(map(str, y)))
    one = {r.point_id: (round(r.score, 10), r.final_rank) for r in fusion.fused({"a": (a, 1.0), "b": (b, 2.0)}).collect()}
    other = {r.point_id: (round(r.score, 10), r.final_rank) for r in fusion.fused({"b": (b, 2.0), "a": (a, 1.0)}).collect()}
    assert one == other and set(one) == set(map(str, x)) | set(map(str, y))


def test_rerank_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, 0.0), (1, "c", 3, 0.5)], "query_id int, point_id string, final_rank int, s double")
    assert [r.point_id for r in fusion.reranked(rows, F.col("s"), 3).orderBy("final_rank").collect()] == ["c", "a", "b"]


def test_packing(spark):
    texts = ["  ", "alpha beta gamma", "alpha beta gamma", "one two three four five six seven eight nine ten", "ONE two three four five six seven eight nine ten", "w " * 60, "small one"]
    rows = spark.createDataFrame([(1, i + 1, f"c{i}", t) for i, t in enumerate(texts)], "query_id int, rank int, chunk_id string, text string")
    verdicts = context.packed(rows, budget=40)
    assert [r.verdict for r in verdicts.orderBy("rank").collect()] == ["empty", "used", "duplicate", "used", "duplicate", "budget", "used"]
    assert rows_of(context.tallies(verdicts)) == [(1, 3, 2, 1, 1, sum(r.tokens for r in verdicts.collect() if r.verdict == "used"))]


def test_hybrid_without_a_leg(spark):
    found = spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 2, 0.8)], "query_id int, point_id int, rank int, score double")
    asked = []
    leg = lambda n, where: asked.append(n) or found
    out = fusion.hybrid({"dense": (leg, 1.0), "bm25": (None, 1.0)}, 1, 20, score=lambda s: s.withColumn("rerank_score", F.col("point_id").cast("double"))).collect()
    assert asked == [20] and [(r.point_id, r.final_rank, r.mode, r.degraded, r.found_by_both) for r in out] == [(6, 1, "dense_only", True, False)]
    assert [r.mode for r in fusion.hybrid({"dense": (leg, 1.0), "bm25": (leg, 1.0)}, 2).collect()] == ["hybrid_only"] * 2 and asked[1:] == [2, 2]
    with pytest.raises(ValueError):
        fusion.hybrid({"dense": (None, 1.0)}, 1)


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [^c2] b [^zz] [^c1] [^c2]")], "answer_id int, answer string")
    known = spark.createDataFrame([(1, "c1"), (1, "c2")], "answer_id int, chunk_id string")
    assert sorted(rows_of(context.resolved(answers, known))) == [(1, "c1", 2), (1, "c2", 1)]
    said = ['{"score": 1.7}', 'x ```json\n{"score": 0.25}\n```', '{"score": true}', "none", '{"score": "0.5"}', None]
    graded = spark.createDataFrame([(s,) for s in said], "a string").select(context.verdict(F.col("a")))
    assert [r[0] for r in graded.collect()][:4] == [1.0, 0.25, None, None]
    assert [r[0] for r in graded.collect()][4:] == [None, None]


def test_metrics(spark):
    golden = spark.createDataFrame([("hit", ["a"], []), ("second", [], ["d2"]), ("missed", ["zz"], []), ("none", ["a"], []), ("adversarial", [], []), ("two", [], ["d1", "d2"])], "query_id string, chunks array<string>, documents array<string>")
    found = [(q, i + 1, c, d) for q in ("hit", "second", "missed", "adversarial", "two") for i, (c, d) in enumerate([("a", "d1"), ("b", "d2"), ("e", "d2")])]
    scores = evals.query_scores(golden, spark.createDataFrame(found, "query_id string, rank int, chunk_id string, document_id string"), 3)
    got = {r.query_id: r for r in scores.collect()}
    assert (got["hit"].recall, got["hit"].reciprocal_rank, got["hit"].ndcg) == (1.0, 1.0, 1.0)
    assert got["second"].reciprocal_rank == 0.5 and got["second"].ndcg == pytest.approx(min(1.0, 1 / math.log2(3) + 0.5))
    assert (got["missed"].recall, got["none"].recall, got["two"].recall) == (0.0, 0.0, 1.0)
    whole = evals.report(scores).first()
    assert (whole.scored, whole.adversarial, whole.missed) == (5, 1, 2)


def test_stems():
    want = "consign consign consist consist consol knack knight generat general communiti skate hope run fli die news ski inning abil ration"
    assert " ".join(map(T.stem, "consigned consignment consistency consistently consolation knacks knights generate generally community skates hopes running flies dying news skis innings ability rational".split())) == want


def test_terms(spark):
    df = spark.createDataFrame([("Running the bge-small-en v1.9.0, café x doing",)], "t string")
    assert df.select(T.terms(F.col("t"))).first()[0] == ["run", "bge-small-en", "v1.9.0", "caf"]
    assert df.select(T.raw_terms(F.col("t"))).first()[0] == ["running", "bge-small-en", "v1.9.0", "caf", "doing"]


def test_keyword_weights(spark):
    chunks = spark.createDataFrame([(1, "apple apple banana"), (2, "banana"), (3, "the of")], "point_id int, text string")
    posted = {(r.point_id, r.term): r.weight for r in keyword.postings(chunks, stems=False).collect()}
    assert posted[1, "apple"] == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 256)))
    asked = keyword.query_terms(spark.createDataFrame([(1, "apple apple"), (2, "the")], "query_id int, text string"), stems=False)
    hits = keyword.search(keyword.postings(chunks, stems=False), asked, chunks.agg(F.count("*").alias("n")), 5).collect()
    assert [(r.query_id, r.point_id) for r in hits] == [(1, 1)]
    assert hits[0].score == pytest.approx(posted[1, "apple"] * math.log(1 + 2.5 / 1.5))


text_cases = st.text(alphabet=st.sampled_from(list("ab .,;\n\r\u00a0é😀-!?")), max_size=400)


@settings(max_examples=150, deadline=None)
@given(text_cases, st.sampled_from(["fixed", "recursive", "semantic", "layout", "late"]), st.integers(4, 20), st.integers(0, 3))
def test_chunks_tile(text, strategy, size, overlap):
    count = chunking.estimate
    edges = chunking.edges_of(text, strategy, size * 4, size, None, chunking.hashed_embedding, 0.95, count)
    if text:
        assert edges[0] == 0 and edges[-1] == len(text) and edges == sorted(set(edges))
    assert all(b - a <= size * 4 for a, b in zip(edges, edges[1:]))
    made = chunking.spans_of(text, edges, overlap * 4, overlap, count)
    assert all(text[a:e].strip() and s <= a < e for s, a, e in made)
    assert "".join(text[a:e] for _, a, e in made).strip() == text.strip() or not text.strip()


def test_chunk_strategies(spark):
    long = "x" * 5000
    docs = spark.createDataFrame([(1, long), (2, "  "), (3, None), (4, "a\r\nb. c")], "doc_id long, text string")
    out = chunking.chunked(docs, "recursive", 64, 8).collect()
    whole = {1: long, 4: "a\r\nb. c"}
    assert all(r.text == whole[r.doc_id][r.start : r.end] for r in out)
    assert {r.doc_id for r in out} == {1, 4} and all(len(r.text) <= (64 + 8) * 4 for r in out)
    with pytest.raises(ValueError):
        chunking.chunked(docs, "other")
    with pytest.raises(ValueError):
        chunking.chunked(docs, "semantic", embed=None)


def test_identity(spark):
    names = ["d:\\Docs\\a.md", "D:/docs/A.md", "https://X/y", "a\\b", "a\0b"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select("s", identity.document_id(F.col("s")).alias("id"), identity.normalise_source(F.col("s")).alias("n"))
    got = df.collect()
    assert got[0].id == got[1].id and got[2].n == "https://X/y" and got[3].n == "a/b" and got[4].n is None
    assert identity.chunker_hash("fixed", 1, 2) != identity.chunker_hash("fixed", 2, 2)
    for bad in ("a__b", "a_", "", "A"):
        with pytest.raises(ValueError):
            identity.scoped(bad, F.lit("x"))


def test_html():
    page = "<html><head><title>T</title><meta name=author content=Me></head><body><nav>no</nav><h1>One</h1><p>a <b>bold</p><script>x</script><h2>Two</h2><ul><li>i<li>j</ul><table><tr><th>h<td>d</table><pre>c\nd</pre><blockquote><p>q</p></blockquote></body>"
    out = parsers.parse(page, "html")
    assert [(b["kind"], b["text"]) for b in out["blocks"]] == [("heading", "One"), ("paragraph", "a bold"), ("heading", "Two"), ("list_item", "i"), ("list_item", "j"), ("table", "h | d"), ("code", "c\nd"), ("paragraph", "q"), ("paragraph", "q")]
    assert out["metadata"] == {"title": "T", "author": "Me"} and out["flags"] == ["tables_detected"]
    assert out["blocks"][3]["section"] == "One > Two" and all(out["text"][b["start"] : b["end"]] == b["text"] for b in out["blocks"])


def test_other_parsers(tmp_path):
    md = parsers.parse("# T\n\npara\nmore\n\n- a\n- b\n\n```py\ncode\n```\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\nUnder\n---\n", "markdown")
    assert [b["kind"] for b in md["blocks"]] == ["heading", "paragraph", "list_item", "list_item", "code", "table", "heading"] and md["metadata"]["title"] == "T"
    table = parsers.parse("a,b\n1,x\n2,\n", "csv")
    assert table["text"] == "a: 1; b: x\na: 2" and table["metadata"] == {"columns": "a,b", "row_count": "2"}
    tree = parsers.parse(json.dumps({"a": 1, "b": {"c": [1, {"d": 2}]}}), "json")
    assert [b["text"] for b in tree["blocks"]] == ["a: 1", "b", "b.c", "b.c[0]: 1", "d: 2"]
    assert parsers.parse("{", "json")["error"]
    assert parsers.parse(b"\xff\xfeabc", "plaintext")["flags"] == ["encoding_fallback"]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>P</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert [(b["kind"], b["section"]) for b in parsers.parse((tmp_path / "x.docx").read_bytes(), "docx")["blocks"]] == [("heading", "H"), ("paragraph", "H")]


def test_files(spark, tmp_path):
    for name, text in (("a.md", "# A\n\nx"), ("b.txt", "one\n\ntwo"), (".hidden", "no"), ("big.txt", "x" * 500)):
        (tmp_path / name).write_text(text)
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "d.txt").write_text("no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.txt").write_text("no")
    found, refused = readers.files(spark, str(tmp_path), max_bytes=100)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.txt"] and refused.count() == 1
    read = parsers.parsed(found.withColumn("doc_id", F.xxhash64("path"))).collect()
    assert sorted(r.parser for r in read) == ["markdown", "plaintext"] and all(r.error is None for r in read)
    values = spark.createDataFrame([("aGk=",), ("hi!",)], "v string").select(F.decode(readers.inline(F.col("v")), "utf-8"))
    assert [r[0] for r in values.collect()] == ["hi", "hi!"]


def test_golden_file(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"1","query":"a"}\n{"id":"1","query":"b"}\n')
    with pytest.raises(ValueError):
        readers.golden(spark, str(tmp_path / "g.jsonl"))


def test_archive(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "u"), ("d1", "u"), ("d2", "v")], "document_id string, source_uri string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, document_id string")
    lifecycle.export_archive(docs, chunks, None, str(tmp_path / "x"))
    assert lifecycle.open_archive(spark, str(tmp_path / "x"))["documents"].count() == 2
    lifecycle.export_archive(docs.filter("document_id = 'd1'"), chunks, None, str(tmp_path / "y"))
    with pytest.raises(ValueError, match="refers"):
        lifecycle.open_archive(spark, str(tmp_path / "y"))
    with pytest.raises(ValueError, match="version"):
        lifecycle.open_archive(spark, str(tmp_path / "x"), major=2)
    with pytest.raises(ValueError):
        lifecycle.deleted(docs)
    with pytest.raises(ValueError, match="everything"):
        lifecycle.deleted(docs, filters.compiled({}))
    assert lifecycle.deleted(docs, filters.compiled({"document_id": "d1"})).count() == 1
    one = lifecycle.upserted(chunks, spark.createDataFrame([("c1", "d8"), ("c9", "d9"), ("c9", "d9")], chunks.schema), "chunk_id")
    assert sorted(rows_of(one)) == [("c1", "d8"), ("c2", "d2"), ("c9", "d9")]
    pay = spark.createDataFrame([(1, {"a": "x"})], "id int, payload map<string,string>")
    new = spark.createDataFrame([(1, {"b": "old"}, 1), (1, {"b": "new"}, 2)], "id int, payload map<string,string>, seq int")
    assert rows_of(lifecycle.merged(pay, new, "id")) == [(1, {"a": "x", "b": "new"})]
    shrunk = lifecycle.replaced_documents(chunks, spark.createDataFrame([("c9", "d1")], "chunk_id string, document_id string"))
    assert sorted(r.chunk_id for r in shrunk.collect()) == ["c2", "c9"]


def test_limits(spark):
    at = [0, 10, 59, 60, 61, 200]
    df = spark.createDataFrame([("u", i) for i in range(len(at))], "k string, id int").withColumn("ts", F.timestamp_seconds(F.element_at(F.array(*map(F.lit, at)), F.col("id") + 1)))
    got = {r.id: (r.allowed, r.retry_after) for r in telemetry.rate_limited(df, 2, 60, "k", "id").collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 2), 3: (True, 0), 4: (False, 10), 5: (True, 0)}
    spent = {r.id: r.verdict for r in telemetry.admitted(df.withColumn("t", F.lit(40) + F.col("id") * 10), 85, 100, 60, "k", "id", "t").collect()}
    assert spent == {0: "admitted", 1: "admitted", 2: "tenant", 3: "tenant", 4: "tenant", 5: "query"}


def test_breaker():
    s = ("closed", 0, 0)
    seen = []
    for us, o in [(1, "failure"), (2, "fatal"), (3, "failure"), (4, "success"), (103, "failure"), (104, "success")]:
        *s, refused = telemetry.breaker_step(*s, us, o, 2, 100)
        seen.append((s[0], refused))
    assert seen == [("closed", False), ("closed", False), ("open", False), ("open", True), ("open", False), ("open", True)]


def test_caches(spark):
    e = spark.createDataFrame([(1, None, A), (2, None, A), (3, "t", A)], "entry_id int, tenant string, embedding array<double>")
    q = spark.createDataFrame([(1, None, A), (2, "other", A)], "asked_id int, tenant string, embedding array<double>")
    assert [(r.asked_id, r.entry_id) for r in caches.semantic_lookup(q, e).collect()] == [(1, 1)]


def test_ingest_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    index = lambda b: b.withColumn("error", F.when(F.col("text").isNull(), "empty"))
    for _ in range(2):  # a restart finds nothing new
        pipeline.ingest(stream, index, str(tmp_path / "out"), str(tmp_path / "dlq"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in pipeline.latest(spark.read.parquet(str(tmp_path / "out")), "doc_id").collect()) == [1, 3]
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "dlq")).collect()] == [2]


def test_folds_hold_no_group(spark):
    """A key's rows come batch by batch, and state goes over from one batch to the next."""
    rows = [(k, i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}", "failure" if i % 50 < 3 else "success", 1) for k in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, ts string, outcome string, n long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folds = telemetry.rate_limited(df, 20, 100, "k", "id"), telemetry.admitted(df, 5, 20, 100, "k", "id", "n"), telemetry.breaker_states(df, 3, 10, "k", "id")
        assert all("FlatMapGroups" not in f._jdf.queryExecution().toString() for f in folds)
        allowed, verdicts, states = [{(x[0], x[1]): x[2] for x in f.collect()} for f in folds]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("a", "b", None):
        assert [i for i in range(200) if allowed[k, i]] == [*range(20), *range(100, 120)]
        assert [i for i in range(200) if verdicts[k, i] == "admitted"] == [*range(20), *range(100, 120)]
        assert [i for i in range(200) if states[k, i] == "open"] == [j + d for j in range(0, 200, 50) for d in range(2, 12)]


def test_breaker_and_window_streams(spark, tmp_path):
    rows = spark.createDataFrame([("p", i, o) for i, o in enumerate(["failure", "failure", "success"])], "provider string, s int, outcome string").select("provider", F.timestamp_seconds("s").alias("ts"), "outcome", F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("b", pipeline.breakers(stream, 2, 60), "append"), ("w", pipeline.windowed(stream, "ts", "1 minute", "1 minute", "value", "provider"), "complete")):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.state for r in spark.table("out_b").orderBy("ts").collect()] == ["closed", "open", "open"]
    assert rows_of(spark.table("out_w").select("n", "sum")) == [(3, 3.0)]
