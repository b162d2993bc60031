"""Postings are counted where their chunk lies."""

import pytest

from loam.operators import keyword


@pytest.mark.parametrize("make", [keyword.postings, keyword.encoded])
def test_no_posting_is_shuffled(spark, make):
    chunks = spark.createDataFrame([(1, "red red blue v1.2"), (2, "blue blue blue"), (3, None), (4, ""), (5, "the of")], "point_id long, text string")
    rows = make(chunks, stems=False)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.point_id, r.term, r.tf) for r in rows.collect()) == [(1, "blue", 1), (1, "red", 2), (1, "v1.2", 1), (2, "blue", 3)]


@pytest.mark.parametrize("make", [keyword.postings, keyword.encoded])
def test_chunks_of_one_id_and_length_are_counted_together(spark, make):
    chunks = spark.createDataFrame([(1, "red blue"), (1, "red green"), (1, "red"), (None, "red"), (None, "red"), (2, "red")], "point_id long, text string")
    got = sorted(((r.point_id or 0, r.term, r.tf, round(r.weight, 6)) for r in make(chunks, stems=False).collect()))
    weight = lambda tf, n: round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256)), 6)
    want = [(0, "red", 2, weight(2, 1)), (1, "blue", 1, weight(1, 2)), (1, "green", 1, weight(1, 2)), (1, "red", 1, weight(1, 1)), (1, "red", 2, weight(2, 2)), (2, "red", 1, weight(1, 1))]
    assert got == sorted(want)
