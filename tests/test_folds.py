"""Folds in segments give the rows of one fold from the start, however long a key's rows go on."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from loam.operators import folds, telemetry

T0 = 1_700_000_000


def events(seed, n):
    r = random.Random(seed)
    out, at = [], {}
    for i in range(n):
        key = r.choice(["hot"] * 8 + ["a", "b", None])
        at[key] = at.get(key, T0 * 1_000_000) + r.choice([0, 500_000, 1_000_000, 2_500_000])
        out.append((key, i, at[key], r.choice(["failure", "failure", "success", "fatal", "none"]), r.randint(1, 12)))
    return out


def plain(rows, begin, using):
    """Each key's rows by time and id, one after another."""
    out = []
    for key in {x[0] for x in rows}:
        step = begin(None, None)
        for x in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])):
            out.append((key, x[1], *step(*[x[i] for i in using])))
    return sorted(out, key=lambda x: x[1])


CASES = {
    "limit": (lambda df: telemetry.rate_limited(df, 7, 10, "k", "id"), partial(telemetry._Limit, 7, 10_000_000), [2]),
    "budget": (lambda df: telemetry.admitted(df, 11, 60, 15, "k", "id", "n"), partial(telemetry._Budget, 11, 60, 15_000_000), [2, 4]),
    "breaker": (lambda df: telemetry.breaker_states(df, 3, 4, "k", "id"), partial(telemetry._Breaker, 3, 4_000_000), [2, 3]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_segments_join(spark, name, monkeypatch):
    ask, begin, using = CASES[name]
    rows = events(5, 4000)
    df = spark.createDataFrame([(k, i, o, n, us) for k, i, us, o, n in rows], "k string, id long, outcome string, n long, us long").withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(5)
    want = plain(rows, begin, using)
    for segment in (10**6, 300, 40):
        monkeypatch.setattr(folds, "SEGMENT", segment)
        got = sorted((tuple(x) for x in ask(df).collect()), key=lambda x: x[1])
        assert got == want, segment
    assert ask(df.limit(0)).count() == 0


def test_states_that_never_meet(spark, monkeypatch):
    """An event a second and one allowed every seven: the phase goes through all segments."""
    monkeypatch.setattr(folds, "SEGMENT", 60)
    df = spark.range(400).select(F.lit("k").alias("k"), "id", F.timestamp_seconds(F.col("id") + T0).alias("ts"))
    allowed = {x.id for x in telemetry.rate_limited(df, 1, 7, "k", "id").filter("allowed").collect()}
    assert allowed == set(range(0, 400, 7))


def test_a_key_that_is_never_quiet_is_many_tasks(spark, monkeypatch):
    run = folds._run
    folder = spark.sparkContext.accumulator(0)

    def counted(*a):
        folder.add(1)
        return run(*a)

    monkeypatch.setattr(folds, "_run", counted)
    monkeypatch.setattr(folds, "SEGMENT", 20_000)
    df = spark.range(200_000).select(F.lit("k").alias("k"), "id", F.timestamp_micros(F.col("id") * 400_000 + T0 * 1_000_000).alias("ts"), F.when(F.col("id") % 13 < 4, "failure").otherwise("success").alias("outcome"))
    found = telemetry.breaker_states(df, 3, 2, "k", "id")
    assert found.filter("refused").count() > 0 and found.count() == 200_000
    assert 10 <= folder.value <= 22  # ten segments, those that meet no state folded once more
