"""Every registered query runs, and gives the rows of its SQL where it has some."""

import hashlib
import math
import os
from collections import Counter

import duckdb
import pytest

from loam.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = Counter(tuple(plain(v) if not isinstance(v, list) else tuple(v) for v in r) for r in got.collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert rows == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["chunks_recursive", "chunks_semantic", "chunks_late", "chunks_layout"])
def test_sliced_chunks(spark, name):
    """Chunks are exact slices that leave no letter out."""
    from loam.plans import documents

    texts = documents._pages(spark, SF) if name == "chunks_layout" else spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r.text or "" for r in texts.select("doc_id", "text").collect()}
    seen = {}
    for r in catalogue.QUERIES[name](spark, SF).orderBy("doc_id", "chunk_index").collect():
        assert hashlib.sha256(whole[r.doc_id][r.start : r.end].encode()).hexdigest() == r.text_sha256
        assert whole[r.doc_id][seen.get(r.doc_id, 0) : r.start].strip() == ""
        seen[r.doc_id] = r.end
    assert all(whole[d][end:].strip() == "" for d, end in seen.items()) and {d for d, t in whole.items() if t.strip()} == set(seen)


@pytest.mark.parametrize("name", ["chunk_ids_fixed", "chunk_rows", "corpus_estimate", "enrichment_by_chunk"])
def test_fixed_chunks_of_short_words_and_blanks(spark, tmp_path, name):
    """Spans of more words than the chunk's size in tokens, and blank ones, are chunks as the SQL has them."""
    texts = ["Of " * 700, "a b c " * 50 + " " * 1700 + "end", "  \n\t", "word " * 400, "", None, "é " * 900, "x" * 2000]
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)), own.sql(catalogue.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
