"""Postings of the queries' terms alone, and searches over them."""

from pyspark.sql import functions as F

from loam.operators import keyword


def test_postings_of_wanted_terms_alone(spark):
    texts = ["apple pear apple", "pear plum", "plum plum fig", "", None, "fig apple"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "point_id long, text string")
    asked = keyword.query_terms(spark.createDataFrame([(1, "apple fig"), (2, "apple quince")], "query_id int, text string"), False)
    every, wanted = ({tuple(r) for r in keyword.postings(chunks, stems=False, **more).collect()} for more in ({}, {"only": asked}))
    assert wanted == {r for r in every if r[1] in ("apple", "fig")} and len(wanted) < len(every)
    total = chunks.agg(F.count("*").alias("n"))
    found = [sorted(map(tuple, keyword.search(keyword.postings(chunks, stems=False, **more), asked, total, 2).collect())) for more in ({}, {"only": asked})]
    assert found[0] == found[1] and len(found[0]) == 4
