"""The timing harness: a query's cold call and its warmed repetitions, as tables."""

from __future__ import annotations

import os
import platform
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.telemetry import bench_medians, bench_runs

#: Warmed repetitions, and calls of each.
REPETITIONS, ITERATIONS = 3, 5


def run_whole(query: Callable[[], DataFrame]) -> None:
    """Makes every row of a query, and keeps none."""
    query().write.format("noop").mode("overwrite").save()


def measured(spark: SparkSession, suites: Mapping[str, Callable[[], DataFrame]], iterations: int = ITERATIONS, repetitions: int = REPETITIONS, call: Callable[[Callable[[], DataFrame]], None] = run_whole) -> DataFrame:
    """suite, repetition, iteration, seconds, cold of every call: each suite is called once cold, and then for each warmed repetition."""
    if iterations < 1 or repetitions < 1:
        raise ValueError("at least one repetition of one call")
    rows = []
    for name, query in suites.items():
        for repetition in range(repetitions + 1):
            for iteration in range(iterations if repetition else 1):
                began = time.perf_counter()
                call(query)
                rows.append((name, repetition, iteration, time.perf_counter() - began, not repetition))
    return spark.createDataFrame(rows, "suite string, repetition int, iteration int, seconds double, cold boolean")


def report(samples: DataFrame) -> DataFrame:
    """A row a suite: the medians of its warmed repetitions, and cold_ms of its first call, which is in no median."""
    warm = bench_medians(bench_runs(samples.filter("NOT cold"), "suite", "repetition"), "suite")
    return warm.join(samples.filter("cold").select("suite", F.round(F.col("seconds") * 1000, 2).alias("cold_ms")), "suite")


def fingerprint(spark: SparkSession) -> dict[str, str]:
    """What the figures were measured on."""
    return {
        "machine": platform.machine(),
        "system": platform.platform(),
        "python": platform.python_version(),
        "spark": spark.version,
        "cores": str(os.cpu_count()),
        "master": spark.sparkContext.master,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
