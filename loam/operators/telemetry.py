"""Run control and telemetry: percentiles, histograms, budgets, rate limits, breakers, job states."""

from __future__ import annotations

from collections import deque
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.operators.folds import Fold, folded


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """Nearest-rank percentiles: the value at rank clamp(round(f * n + 0.5), 1, n), halves rounded to even.

    Ranks come from counts of distinct values, so no group is gathered in a list."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy(*by)))
    rank = lambda f: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(f) * F.col("n") + 0.5, 0)))
    return upto.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= rank(f), F.col(value))).alias(name) for name, f in fractions.items()])


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """le, n: rows up to each bound (cumulative), and all at infinity."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("b_inf")]
    wide = df.groupBy(*by).agg(*sums, F.round(F.sum(value), 6).alias("total"))
    pairs = F.array(*[F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("b_inf").alias("n")))
    return wide.select(*by, "total", F.explode(pairs).alias("x")).select(*by, "total", "x.*")


def rolling_sum(df: DataFrame, value: str, time: str, seconds: int, by: str) -> DataFrame:
    """df with spent: the sum over rows of the same key no older than the window (a row expires at exactly its age)."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    order = W.partitionBy(by).orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("_us", micros).withColumn("spent", F.sum(value).over(order)).drop("_us")


class _Limit:
    def __init__(self, limit: int, micros: int, log: list | None, us: int | None) -> None:
        self.limit, self.micros, self.log = limit, micros, deque(log or ())

    def state(self) -> list:
        return list(self.log)

    def __call__(self, us: int) -> tuple[bool, int]:
        while self.log and us - self.log[0] >= self.micros:
            self.log.popleft()
        if len(self.log) < self.limit:
            self.log.append(us)
            return True, 0
        waited = (us - self.log[0]) / 1e6
        return False, max(1, int(self.micros / 1e6 - waited) + 1) if waited == waited else 1


def rate_limited(df: DataFrame, limit: int, seconds: int, by: str, id: str) -> DataFrame:
    """by, id, allowed, retry_after: at most `limit` allowed rows in any window; refused ones are not counted. Rows without a time come last and count by themselves."""
    fold = Fold(["_us"], partial(_Limit, limit, seconds * 1_000_000), [("allowed", "boolean", pa.bool_()), ("retry_after", "int", pa.int32())])
    return folded(_timed(df), fold, by, id)


class _Budget:
    def __init__(self, per_query: int, per_tenant: int, micros: int, log: list | None, us: int | None) -> None:
        self.per_query, self.per_tenant, self.micros = per_query, per_tenant, micros
        self.log = deque(map(tuple, log or ()))
        self.spent = sum(n for _, n in self.log)

    def state(self) -> list:
        return list(self.log)

    def __call__(self, us: int, n: int) -> tuple[str]:
        while self.log and us - self.log[0][0] >= self.micros:
            self.spent -= self.log.popleft()[1]
        verdict = "query" if self.per_query and n > self.per_query else "tenant" if self.per_tenant and self.spent + n > self.per_tenant else "admitted"
        if verdict == "admitted":
            self.log.append((us, n))
            self.spent += n
        return (verdict,)


def admitted(df: DataFrame, per_query: int, per_tenant: int, seconds: int, by: str, id: str, tokens: str) -> DataFrame:
    """by, id, verdict (admitted, query, tenant): token budgets a query and, over a rolling window, a tenant (0: none). Only admitted requests are charged."""
    fold = Fold(["_us", tokens], partial(_Budget, per_query, per_tenant, seconds * 1_000_000), [("verdict", "string", pa.string())])
    return folded(_timed(df), fold, by, id)


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))


def breaker_step(state: str, failures: int, opened_us: int, us: int, outcome: str, threshold: int, reset_us: int) -> tuple[str, int, int, bool]:
    """A breaker after one call: state, failures, when it opened, and whether the call was refused. outcome: success, failure, or fatal (which is ignored)."""
    if state == "open" and us - opened_us >= reset_us:
        state = "half_open"
    if state == "open":
        return state, failures, opened_us, True
    if outcome == "success":
        return "closed", 0, opened_us, False
    if outcome == "failure":
        failures += 1
        if state == "half_open" or failures >= threshold:
            return "open", failures, us, False
    return state, failures, opened_us, False


class _Breaker:
    def __init__(self, threshold: int, reset_us: int, held: list | None, us: int | None) -> None:
        self.threshold, self.reset_us, self.held = threshold, reset_us, tuple(held or ("closed", 0, 0))

    def state(self) -> list:
        name, failures, opened = self.held  # what does not bear on what follows is left out, so that states meet
        return [name, failures if name == "closed" else 0, opened if name == "open" else 0]

    def __call__(self, us: int, outcome: str) -> tuple[str, bool]:
        *self.held, refused = breaker_step(*self.held, us, outcome, self.threshold, self.reset_us)
        return self.held[0], refused


def breaker_states(df: DataFrame, threshold: int, reset_seconds: int, by: str, id: str) -> DataFrame:
    """by, id, state, refused: the breaker of each key after each call (columns ts and outcome)."""
    fold = Fold(["_us", "outcome"], partial(_Breaker, threshold, reset_seconds * 1_000_000), [("state", "string", pa.string()), ("refused", "boolean", pa.bool_())])
    return folded(_timed(df), fold, by, id)


def job_status(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of document outcomes a job, and the job's state: completed, partial or failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = outcomes.groupBy(*by).agg(F.count("*").alias("total"), n("indexed").alias("indexed"), n("skipped").alias("skipped"), n("failed").alias("failed"))
    return counted.withColumn("state", F.when(F.col("failed") == 0, "completed").when(F.col("failed") < F.col("total"), "partial").otherwise("failed"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def error_kind(status: Column) -> Column:
    """What an HTTP status says of an error; null is a lost connection."""
    return F.when(status.isNull(), "retryable").when(status.isin(401, 403), "fatal").when(status.isin(408, 504), "timeout").when((status == 429) | (status >= 500), "retryable").otherwise("fatal")


def kind_of(error: BaseException) -> str:
    """The same of an exception, by its attribute status if it has one: timeouts and lost connections pass, anything else is fatal."""
    status = getattr(error, "status", None)
    if status is not None:
        return "timeout" if status in (408, 504) else "retryable" if status == 429 or (status >= 500) else "fatal"
    return "timeout" if isinstance(error, TimeoutError) else "retryable" if isinstance(error, ConnectionError) else "fatal"


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt - 1), F.lit(most)).cast("long")


def cost(tokens: Column, rate: Column, is_local: Column) -> Column:
    """Tokens at a price a million; local models cost nothing, unknown prices are null."""
    return F.when(is_local, 0.0).otherwise(tokens / 1e6 * rate)


#: Providers that run on one's own machines.
LOCAL = ("huggingface", "ollama")


def priced(usage: DataFrame, prices: DataFrame, local: tuple[str, ...] = LOCAL) -> DataFrame:
    """usage (provider, model, prompt_tokens, completion_tokens) with cost and basis, what the figure rests on.

    prices: provider, model, input_rate, output_rate (a million tokens; null: not sold), source, checked, note: published rates, one a model of a
    provider and no more rows than those, so they are broadcast. The provider must match: what one asks for a model says nothing of what another asks for its
    namesake. A local provider costs nothing; without a rate that is needed the cost is null, never a guess. completion_tokens null: an embedding, which has one rate."""
    one = prices.select("provider", "model", "input_rate", "output_rate", F.concat(F.col("input_rate").cast("string"), F.lit(" USD a million tokens, "), "source", F.lit(", checked "), "checked", F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise(F.lit(""))).alias("_basis"))
    rows = usage.join(F.broadcast(one.dropDuplicates(["provider", "model"])), ["provider", "model"], "left")
    said = F.when(F.col("completion_tokens").isNotNull(), F.col("completion_tokens") * F.col("output_rate")).otherwise(0.0)
    own = F.coalesce(F.col("provider").isin(*local), F.lit(False))
    cost_ = F.when(own, 0.0).otherwise((F.col("prompt_tokens") * F.col("input_rate") + said) / 1e6)
    basis = F.when(own, "runs locally").when(cost_.isNull(), F.concat(F.lit("no published rate for "), F.coalesce("model", F.lit("?")), F.lit(" of "), F.coalesce("provider", F.lit("?")))).otherwise(F.col("_basis"))
    return rows.withColumn("cost", cost_).withColumn("basis", basis).drop("input_rate", "output_rate", "_basis")


def bench_runs(samples: DataFrame, *by: str) -> DataFrame:
    """operations, seconds, throughput (a second) and p50, p95, p99, max (ms) of each run of timed samples (column seconds)."""
    sums = samples.groupBy(*by).agg(F.count("*").alias("operations"), F.sum("seconds").alias("s"), F.max("seconds").alias("m"))
    ranks = nearest_rank(samples, "seconds", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *by)
    ms = [F.round(F.col(p) * 1000, 2).alias(p) for p in ("p50", "p95", "p99")]
    rate = F.when(F.col("s") > 0, F.round(F.col("operations") / F.col("s"), 3)).otherwise(0.0)
    return sums.join(ranks, list(by), "left").select(*by, "operations", F.round("s", 4).alias("seconds"), rate.alias("throughput"), *ms, F.round(F.col("m") * 1000, 2).alias("max"))


def bench_medians(runs: DataFrame, *by: str) -> DataFrame:
    """The median of each statistic over the runs of a suite."""
    names = ("operations", "seconds", "throughput", "p50", "p95", "p99", "max")
    return runs.groupBy(*by).agg(*[F.round(F.median(c), 3).alias(c) for c in names], F.count("*").alias("repetitions"))


def estimated(documents: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """by, documents, unreadable, chunks, tokens, bytes. documents: doc_id, text (null: unreadable) and by; chunks: doc_id, token_count."""
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    rows = documents.select("doc_id", by, F.col("text").isNull().alias("bad"), F.octet_length("text").alias("b")).join(made, "doc_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(by).agg(F.count_if(~F.col("bad")).alias("documents"), F.count_if("bad").alias("unreadable"), zero("n").alias("chunks"), zero("t").alias("tokens"), zero("b").alias("bytes"))


def enrichment(documents: DataFrame, chunks: DataFrame, by: str, context_tokens: int = 80) -> DataFrame:
    """by, calls, completion, prompt: what giving each chunk a context would take; each call reads the whole document and its chunk."""
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    rows = documents.select("doc_id", by, F.floor(F.length("text") / 4).alias("whole")).join(made, "doc_id")
    return rows.groupBy(by).agg(F.sum("n").alias("calls"), F.sum(F.col("n") * context_tokens).alias("completion"), F.sum(F.col("whole") * F.col("n") + F.col("t")).alias("prompt"))
