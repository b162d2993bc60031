"""The search for settings, traces, refusals, prices, offsets, sparse vectors, contexts, DOCX properties and golden files: odd rows."""

import io
import os
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loam.functions.text import raw_terms
from loam.operators import autopilot, chunking, context, keyword, telemetry, traces
from loam.operators.autopilot import Retrieval
from loam.sources import parsers, readers


def test_candidates_differ_from_the_settings_in_use():
    tried = autopilot.candidates(Retrieval(1.0, 0.5, 30.0, True, 5))
    assert tried[0] == Retrieval(1.0, 0.5, 30.0, True, 5) and len(tried) == len(set(tried)) == 1 + 3 + 2 + 1
    assert all(c.rerank for c in tried[:-1]) and not tried[-1].rerank and tried[-1].depth(3) == 3 and tried[0].depth(3) == 5
    assert all(c.rerank is False for c in autopilot.candidates(Retrieval(rerank=False))) and len(autopilot.candidates(Retrieval(rerank=False))) == 1 + 4 + 2
    assert autopilot.overrides(Retrieval(0.5, 1.0, 60.0, False), Retrieval()) == {"retrieval.dense_weight": "0.5", "retrieval.rerank": "false"}


def test_trials_against_a_plain_fold(spark):
    legs = {"dense": [(q, p, (p * 7 + q) % 11 + 1) for q in (1, 2, 3) for p in range(11)], "bm25": [(q, p, (p * 3 + q * 5) % 11 + 1) for q in (1, 2) for p in range(4, 15)]}
    rerank = {p: (None if p == 9 else (p * 5) % 4 / 4) for p in range(15)}
    golden = {1: ["d1", "d3"], 2: ["d0"], 3: [], 4: ["d2"]}
    k, tried = 3, [*autopilot.candidates(Retrieval(1.0, 1.0, 60.0, True, 6)), Retrieval(0.0, 1.0, 60.0, False, 6)]
    want = {}
    for i, c in enumerate(tried):
        per = []
        for q, relevant in golden.items():
            score = Counter()
            for leg, w in (("dense", c.dense_weight), ("bm25", c.bm25_weight)):
                for a, p, r in legs[leg]:
                    if a == q and r <= c.depth(k) and w > 0:
                        score[p] += w / (c.rrf_k + r)
            short = sorted(score, key=lambda p: (-round(score[p], 12), p))[: c.depth(k)]
            if c.rerank:
                short = sorted(short, key=lambda p: -(rerank[p] or 0))
            hits = [f"d{p % 5}" in relevant for p in short[:k]]
            if relevant:
                per.append((min(sum(hits) / len(relevant), 1), 1 / (hits.index(True) + 1) if any(hits) else 0))
        want[i] = tuple(round(sum(x) / len(per), 6) for x in zip(*per))
    df = {leg: spark.createDataFrame(rows, "query_id long, point_id long, rank int") for leg, rows in legs.items()}
    documents = spark.createDataFrame([(p, f"d{p % 5}") for p in range(15)], "point_id long, document_id string")
    asked = spark.createDataFrame([(q, [], d) for q, d in golden.items()], "query_id long, chunks array<string>, documents array<string>")
    scores = spark.createDataFrame(list(rerank.items()), "point_id long, rerank_score double")
    got = autopilot.trials(df["dense"], df["bm25"], asked, documents, tried, k, lambda pairs: pairs.join(scores, "point_id"))
    assert {r.candidate: (round(r.recall, 6), round(r.mrr, 6)) for r in got.collect()} == want
    assert {(r.scored, r.adversarial) for r in got.collect()} == {(3, 1)} and len(set(want.values())) > 1


def test_what_measures_the_same_is_no_suggestion(spark):
    tried = autopilot.candidates(Retrieval())
    rows = lambda *ndcg: spark.createDataFrame([(i, 0.5, 0.5, x) for i, x in enumerate(ndcg)], "candidate int, recall double, mrr double, ndcg double")
    same = autopilot.suggestion(rows(0.7, 0.7, 0.6), tried, 5).first()
    assert (same.candidate, same.improves, same.evaluated, same.skipped) == (0, False, 3, len(tried) - 3) and same.yaml.endswith("\n{}\n")
    better = autopilot.suggestion(rows(0.7, 0.8, 0.8), tried, 5).first()
    assert (better.candidate, better.improves, better.ndcg) == (1, True, 0.1) and better.yaml.endswith("\nretrieval:\n  bm25_weight: 0.5\n")


def _trace(id, at, tenant="a", response="r", **more):
    return {"trace_id": id, "query": "q", "collection": None, "tenant": tenant, "filters": None, "prompt": "p", "response": response, "created_at": at, "settings": {"retrieval.top_k": "5", "chunking.a.b": "1", "llm.api_key": "x", "llm.model": "m", "server.port": "1"}, **more}


SCHEMA = "trace_id string, query string, collection string, tenant string, filters map<string,string>, prompt string, response string, created_at timestamp, settings map<string,string>"


def test_traces_are_kept_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, h=12: datetime(2024, 1, d, h)
    none = spark.createDataFrame([], "trace_id string, chunk_id string, final_rank int")
    no_steps = spark.createDataFrame([], "trace_id string, name string, began timestamp, ended timestamp")
    put = lambda *rows: traces.store(traces.recorded(spark.createDataFrame(list(rows), SCHEMA), none, no_steps), path)
    put(_trace("old", day(1)), _trace("edge", day(10, 11)), _trace("in", day(10, 13)), _trace("b", day(15), "b"), _trace("x", day(12), response="first"))
    put(_trace("x", day(16), response="second"), _trace("none", day(16), None))
    now = day(20)
    ids = lambda tenant=None: {r.trace_id: r.response for r in traces.kept(spark, path, now, 10, tenant).collect()}
    assert ids() == {"in": "r", "b": "r", "x": "second", "none": "r"} and ids("a") == {"in": "r", "x": "second"} and ids("c") == {}
    assert [r.trace_id for r in traces.newest(spark, path, 3, "a").collect()] == ["x", "in", "edge"]
    assert [r.trace_id for r in traces.newest(spark, path, 2).collect()] == ["none", "x"] and traces.newest(spark, path, 5, "c").count() == 0
    assert traces.prune(spark, path, now, 10) == 1 and traces.prune(spark, path, now, 10) == 0
    assert sorted(p for p in os.listdir(path) if p.startswith("day=")) == ["day=2024-01-10", "day=2024-01-12", "day=2024-01-15", "day=2024-01-16"]
    assert ids()["x"] == "second" and traces.kept(spark, path, now, 10).filter("trace_id = 'x'").first().config == {"retrieval.top_k": "5", "chunking.a.b": "1", "llm.model": "m"}
    assert traces.prune(spark, str(tmp_path / "absent"), now, 10) == 0


def test_trace_lists_its_chunks_and_steps_in_order(spark):
    chunks = spark.createDataFrame([("t", "c2", 2, 0.1), ("t", "c1", 1, 0.3)], "trace_id string, chunk_id string, final_rank int, rrf_score double")
    at = lambda ms: datetime(2024, 1, 1, 0, 0, 0, ms * 1000)
    steps = spark.createDataFrame([("t", "reranker", at(30), at(45)), ("t", "retrieval", at(10), at(30))], "trace_id string, name string, began timestamp, ended timestamp")
    row = traces.recorded(spark.createDataFrame([_trace("t", at(0)), _trace("bare", at(0))], SCHEMA), chunks, steps).orderBy("trace_id").collect()
    assert row[0].retrieved is None and row[0].spans is None
    assert [(c.chunk_id, c.final_rank, c.rrf_score, c.dense_rank) for c in row[1].retrieved] == [("c1", 1, 0.3, None), ("c2", 2, 0.1, None)]
    assert [(s.name, s.start_ms, s.end_ms) for s in row[1].spans] == [("retrieval", 0.0, 20.0), ("reranker", 20.0, 35.0)]


def test_refusals_offer_what_there_was(spark):
    answers = spark.createDataFrame([("low", "x", 0.69), ("even", "x", 0.7), ("ungraded", "x", None), ("bare", "x", 0.0)], "answer_id string, answer string, score double")
    chunks = spark.createDataFrame([(a, i + 1, f"c{i}", "s", 0.5 if i % 2 else None, 0.1) for a in ("low", "even") for i in range(7)], "answer_id string, final_rank int, chunk_id string, source string, rerank_score double, rrf_score double")
    got = {r.answer_id: r for r in context.grounded_or_refused(answers, chunks, 0.7).collect()}
    assert {k: (r.answer, r.refused) for k, r in got.items()} == {"low": (None, True), "even": ("x", False), "ungraded": ("x", False), "bare": (None, True)}
    assert [(c.chunk_id, c.score) for c in got["low"].candidates] == [("c0", 0.1), ("c1", 0.5), ("c2", 0.1), ("c3", 0.5), ("c4", 0.1)]
    assert got["bare"].candidates == [] and got["even"].candidates is None and got["ungraded"].candidates is None


def test_prices_are_of_a_provider(spark):
    prices = spark.createDataFrame([("openai", "m", 2.0, 8.0, "page", "2024-01-01", None), ("openai", "m", 2.0, 8.0, "page", "2024-01-01", None), ("openai", "e", 1.0, None, "page", "2024-01-01", "old")], "provider string, model string, input_rate double, output_rate double, source string, checked string, note string")
    used = spark.createDataFrame([(1, "openai", "m", 1000000, 500000), (2, "gateway", "m", 10, 10), (3, "ollama", "m", 10, 10), (4, "openai", "e", 500000, None), (5, "openai", "e", 5, 1), (6, None, None, 5, None), (7, "openai", "m", 0, 0)], "id int, provider string, model string, prompt_tokens long, completion_tokens long")
    got = {r.id: (r.cost, r.basis) for r in telemetry.priced(used, prices).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 6.0, 2: None, 3: 0.0, 4: 0.5, 5: None, 6: None, 7: 0.0}
    assert got[4][1] == "1.0 USD a million tokens, page, checked 2024-01-01 (old)" and got[2][1] == "no published rate for m of gateway" and got[6][1] == "no published rate for ? of ?"


def test_offsets_between_blocks_have_no_block(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 5, "A", 1), (1, 1, 7, 9, None, None), (1, 2, 9, 9, "B", 2), (2, 0, 3, 4, "C", 7)], "doc_id long, position int, start int, end int, section string, page int")
    asked = spark.createDataFrame([(1, o) for o in (0, 4, 5, 6, 7, 8, 9, 50)] + [(2, 2), (2, 3), (3, 0)], "doc_id long, offset long")
    got = {(r.doc_id, r.offset): (r.block, r.section, r.page) for r in parsers.located(asked, blocks).collect()}
    assert got == {(1, 0): (0, "A", 1), (1, 4): (0, "A", 1), (1, 5): (None, "A", 1), (1, 6): (None, "A", 1), (1, 7): (1, None, None), (1, 8): (1, None, None), (1, 9): (None, "B", 2), (1, 50): (None, "B", 2), (2, 2): (None, None, None), (2, 3): (0, "C", 7), (3, 0): (None, None, None)}


def test_colliding_terms_saturate_together(spark):
    texts = {1: "alpha beta beta gamma alpha delta", 2: "", 3: None, 4: "the of"}
    rows = spark.createDataFrame(list(texts.items()), "point_id long, text string")
    index = lambda term: F.ascii(term).cast("long") % 2  # noqa: E731  alpha, gamma: 1; beta, delta: 0
    got = {(r.point_id, r.term_id): (r.term, r.tf, round(r.weight, 9)) for r in keyword.encoded(rows, stems=False, index=index).collect()}
    weight = lambda tf, n: round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256)), 9)
    assert got == {(1, 1): ("alpha", 3, weight(3, 6)), (1, 0): ("beta", 3, weight(3, 6))}
    words = rows.select(F.explode(raw_terms(F.col("text")))).count()
    assert words >= 6 and keyword.encoded(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("said", "kept"),
    [('Context: "About  x."', "About x."), ('"Context: About\nx."', "About x."), ("Here is the context: 'Situating context: y'", "y"), ("  ''  ", ""), ("context:", ""), ("plain 'quoted' end", "plain 'quoted' end"), ("Context:Context:Context:Context:Context: z", "Context: z")],
)
def test_contexts_are_cleaned(spark, said, kept):
    assert spark.createDataFrame([(said,)], "t string").select(chunking.cleaned(F.col("t")).alias("t")).first().t == kept


def test_a_failed_context_leaves_its_chunk(spark):
    rows = spark.createDataFrame([(1, "own", None), (2, "own", '"\'"'), (3, "own", "Context: c")], "id int, text string, said string")
    got = {r.id: (r.text, r.enrichment_failed, r.context_prefix) for r in chunking.enriched(rows, F.col("said")).collect()}
    assert got == {1: ("own", True, None), 2: ("own", True, None), 3: ("c\n\nown", False, "c")}
    prompt = spark.createDataFrame([("d" * 70_000, "c")], "d string, c string").select(chunking.situating_prompt(F.col("d"), F.col("c")).alias("p")).first().p
    assert prompt == "<document>\n" + "d" * 60_000 + "\n</document>\n\n<chunk>\nc\n</chunk>"


def test_docx_properties_and_styles_by_name():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, inner: f'<w:p><w:pPr><w:tabs><w:tab/></w:tabs><w:pStyle w:val="{style}"/></w:pPr>{inner}</w:p>'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = p("a1", run("Top")) + p("Heading9", run("Deep")) + p("a2", run("item")) + p("x", "<w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r>") + p("x", run("  "))
    core = '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><dc:title>T</dc:title><dc:creator> A </dc:creator><dc:subject/><t:created>2024-01-01T00:00:00Z</t:created></c:coreProperties>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="a2"><w:name w:val="My List"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", core)
    got = parsers.parse(made.getvalue(), "docx")
    assert got["metadata"] == {"title": "T", "author": "A", "created": "2024-01-01T00:00:00Z"}
    assert [(b["kind"], b["text"], b["level"]) for b in got["blocks"]] == [("heading", "Top", 1), ("heading", "Deep", 6), ("list_item", "item", None), ("paragraph", "one\ttwo", None)]


def test_golden_files_come_back_as_they_were(spark, tmp_path):
    rows = [("q_0002", "b\n?", ["c"], [], None, {"k": "v"}, "s", None), ("q_0001", 'ü "a"', [], ["d"], "r", {}, None, "2024")]
    schema = "id string, query string, relevant_chunk_ids array<string>, relevant_document_ids array<string>, answer_reference string, metadata map<string,string>, source string, created_at string"
    path = str(tmp_path / "g")
    readers.write_golden(spark.createDataFrame(rows, schema), path)
    assert sorted(tuple(r) for r in readers.golden(spark, path).collect()) == sorted(rows)
    lines = [line for r in spark.read.text(path).collect() for line in [r.value]]
    assert lines[0].startswith('{"answer_reference":"r","created_at":"2024","id":"q_0001"') and '"created_at":null' in lines[1]
    readers.write_golden(spark.createDataFrame([rows[0], rows[0]], schema), str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="an id of their own"):
        readers.golden(spark, str(tmp_path / "twice"))
