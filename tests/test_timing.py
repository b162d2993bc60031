import pytest

from loam.operators import timing


def test_harness(spark):
    calls = []
    made = timing.measured(spark, {"a": lambda: spark.range(3), "b": lambda: spark.range(4)}, iterations=4, repetitions=3, call=lambda q: calls.append(q().count()))
    assert calls == [3] * 13 + [4] * 13
    rows = made.collect()
    assert sum(r.cold for r in rows) == 2 and all(r.cold == (r.repetition == 0) for r in rows) and all(r.seconds >= 0 for r in rows)
    fixed = spark.createDataFrame([("a", 0, 0, 9.0, True)] + [("a", n, i, n * 0.1 + i * 0.01, False) for n in (1, 2, 3) for i in range(4)], made.schema)
    (got,) = timing.report(fixed).collect()
    assert (got.suite, got.repetitions, got.cold_ms, got.operations, got.max) == ("a", 3, 9000.0, 4, 230.0)
    assert got.p50 == pytest.approx(210.0, abs=10.1) and got.seconds == pytest.approx(0.86)
    whole = timing.measured(spark, {"a": lambda: spark.range(5)}, iterations=1, repetitions=1)
    assert whole.count() == 2 and timing.report(whole).count() == 1
    with pytest.raises(ValueError):
        timing.measured(spark, {}, iterations=0)
    assert timing.fingerprint(spark)["spark"] == spark.version
