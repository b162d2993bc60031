"""Queries of run control: costs, budgets, limits, breakers, percentiles, histograms, job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import caches
from loam.operators import telemetry as R
from loam.plans.registry import Catalogue, table

C = Catalogue()
_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
_EST = f"(CASE WHEN {_TRIM} = '' THEN 0 ELSE greatest(length({_TRIM}) // 4, len(string_split_regex({_TRIM}, '\\s+'))) END)"


def _prices(spark):
    return spark.createDataFrame([("en", 0.02, False), ("fr", 0.1, False), ("de", None, True)], "lang string, rate double, is_local boolean")


@C.query(f"""WITH t AS (SELECT lang, count(*) AS documents, sum({_EST})::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang)
  SELECT lang, documents, tokens, bytes, round(CASE WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN tokens / 1e6 * 0.02::DOUBLE WHEN lang = 'fr' THEN tokens / 1e6 * 0.1::DOUBLE END, 9) AS cost FROM t""")
def estimate_cost(spark, sf):
    used = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"))
    priced = used.join(F.broadcast(_prices(spark)), "lang", "left")
    return priced.select("lang", "documents", "tokens", "bytes", F.round(R.cost(F.col("tokens"), F.col("rate"), F.coalesce("is_local", F.lit(False))), 9).alias("cost"))


@C.query(f"""WITH u AS (SELECT doc_id, lang AS provider, source AS model, {_EST}::BIGINT AS p, CASE WHEN doc_id % 2 = 0 THEN doc_id % 100 END AS c FROM documents),
  t(provider, model, i, o, basis) AS (VALUES ('en', 'src0', 0.02::DOUBLE, NULL::DOUBLE, '0.02 USD a million tokens, list, checked 2024-01-01'), ('en', 'src1', 3.0, 15.0, '3.0 USD a million tokens, list, checked 2024-01-01 (batch is less)'), ('fr', 'src0', 0.1, 0.4, '0.1 USD a million tokens, page, checked 2024-02-01'))
  SELECT doc_id, round(CASE WHEN u.provider = 'de' THEN 0 WHEN t.i IS NULL OR (c IS NOT NULL AND o IS NULL) THEN NULL ELSE (p * i + coalesce(c * o, 0)) / 1e6 END, 9) AS cost,
    CASE WHEN u.provider = 'de' THEN 'runs locally' WHEN t.i IS NULL OR (c IS NOT NULL AND o IS NULL) THEN 'no published rate for ' || coalesce(u.model, '?') || ' of ' || coalesce(u.provider, '?') ELSE t.basis END AS basis
  FROM u LEFT JOIN t ON t.provider = u.provider AND t.model = u.model""")
def price_by_provider(spark, sf):
    """Rates of (provider, model); another provider's model of one name has no rate, and 'de' runs locally."""
    prices = spark.createDataFrame([("en", "src0", 0.02, None, "list", "2024-01-01", None), ("en", "src1", 3.0, 15.0, "list", "2024-01-01", "batch is less"), ("fr", "src0", 0.1, 0.4, "page", "2024-02-01", "")], "provider string, model string, input_rate double, output_rate double, source string, checked string, note string")
    used = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("provider"), F.col("source").alias("model"), T.token_estimate(F.col("text")).alias("prompt_tokens"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 100).alias("completion_tokens"))
    return R.priced(used, prices, ("de",)).select("doc_id", F.round("cost", 9).alias("cost"), "basis")


@C.query(f"""SELECT source, sum(n)::BIGINT AS calls, sum(n * 80)::BIGINT AS completion, sum((length(text) // 4) * n + {_EST})::BIGINT AS prompt FROM (SELECT *, 1 + n_chars // 2000 AS n FROM documents) GROUP BY source""")
def enrichment_estimate(spark, sf):
    docs = table(spark, sf, "documents").withColumn("n", 1 + F.floor(F.col("n_chars") / 2000))
    return docs.groupBy("source").agg(F.sum("n").alias("calls"), F.sum(F.col("n") * 80).alias("completion"), F.sum(F.floor(F.length("text") / 4) * F.col("n") + T.token_estimate(F.col("text"))).alias("prompt"))


@C.query("""SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 6) AS spent FROM events""")
def rolling_spend(spark, sf):
    rows = R.rolling_sum(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "value", "ts", 86400, "user_id")
    return rows.select("event_id", "user_id", F.round("spent", 6).alias("spent"))


_FOLD_EVENTS = "SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


@C.query(f"""WITH RECURSIVE e AS ({_FOLD_EVENTS}), fold AS (
    SELECT user_id, event_id, rn, [us] AS log, true AS allowed, 0 AS retry_after FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN len(l.live) < 2 THEN list_append(l.live, e.us) ELSE l.live END, len(l.live) < 2,
      CASE WHEN len(l.live) < 2 THEN 0 ELSE greatest(1, trunc(86400 - (e.us - l.live[1]) / 1e6)::INT + 1) END
    FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1, LATERAL (SELECT list_filter(f.log, lambda x: e.us - x < 86400000000) AS live) l)
  SELECT user_id, event_id, allowed, retry_after FROM fold""")
def rate_limit(spark, sf):
    return R.rate_limited(table(spark, sf, "events").select("event_id", "user_id", "ts"), 2, 86400, "user_id", "event_id")


@C.query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, (event_id % 90 + 10)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), fold AS (
    SELECT user_id, event_id, rn, CASE WHEN t > 90 OR t > 150 THEN [] ELSE [{{us: us, t: t}}] END AS log, CASE WHEN t > 90 THEN 'query' WHEN t > 150 THEN 'tenant' ELSE 'admitted' END AS verdict FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN v.verdict = 'admitted' THEN list_append(v.live, {{us: e.us, t: e.t}}) ELSE v.live END, v.verdict
    FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1, LATERAL (SELECT live, CASE WHEN e.t > 90 THEN 'query' WHEN coalesce(list_sum(list_transform(live, lambda x: x.t)), 0) + e.t > 150 THEN 'tenant' ELSE 'admitted' END AS verdict
      FROM (SELECT list_filter(f.log, lambda x: e.us - x.us < 172800000000) AS live)) v)
  SELECT user_id, event_id, verdict FROM fold""")
def budget_admission(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 90 + 10).alias("t"))
    return R.admitted(rows, 90, 150, 172800, "user_id", "event_id", "t")


@C.query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS provider, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'fatal' WHEN 'purchase' THEN 'success' ELSE 'none' END AS outcome,
      row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS rn FROM events),
  fold AS (SELECT DISTINCT provider, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS failures, 0::BIGINT AS opened, false AS refused FROM e
    UNION ALL SELECT e.provider, e.rn, e.event_id,
      CASE WHEN s.at = 'open' THEN 'open' WHEN e.outcome = 'success' THEN 'closed' WHEN e.outcome = 'failure' AND (s.at = 'half_open' OR f.failures + 1 >= 3) THEN 'open' ELSE s.at END,
      CASE WHEN s.at = 'open' THEN f.failures WHEN e.outcome = 'success' THEN 0 WHEN e.outcome = 'failure' THEN f.failures + 1 ELSE f.failures END,
      CASE WHEN s.at <> 'open' AND e.outcome = 'failure' AND (s.at = 'half_open' OR f.failures + 1 >= 3) THEN e.us ELSE f.opened END, s.at = 'open'
    FROM fold f JOIN e ON e.provider = f.provider AND e.rn = f.rn + 1, LATERAL (SELECT CASE WHEN f.state = 'open' AND e.us - f.opened >= 36000000000 THEN 'half_open' ELSE f.state END AS at) s)
  SELECT provider, event_id, state, refused FROM fold WHERE rn > 0""")
def breaker_states(spark, sf):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failure").when(kind == "signup", "fatal").when(kind == "purchase", "success").otherwise("none")
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("provider"), "event_id", "ts", outcome.alias("outcome"))
    return R.breaker_states(rows, 3, 36000, "provider", "event_id")


_RANK = "list_sort(list(value))[greatest(1, least(count(*), round_even({f} * count(*) + 0.5, 0)))::BIGINT]"


@C.query(f"SELECT event_type, {_RANK.format(f=0.5)} AS p50, {_RANK.format(f=0.95)} AS p95, {_RANK.format(f=0.99)} AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_rank_percentiles(spark, sf):
    return R.nearest_rank(table(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_type")


@C.query("""WITH b(le, x) AS (VALUES ('1.0', 1), ('10.0', 10), ('50.0', 50), ('100.0', 100), ('+Inf', 'inf'::DOUBLE))
  SELECT event_type, round(sum(value), 6) AS total, le, count(*) FILTER (value <= x) AS n FROM events, b GROUP BY event_type, le""")
def metric_histogram(spark, sf):
    return R.histogram(table(spark, sf, "events"), "value", [1, 10, 50, 100], "event_type")


@C.query("""SELECT user_id, round(CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) > 0 THEN count(*) FILTER (event_type = 'view')::DOUBLE / count(*) FILTER (event_type IN ('view', 'click')) ELSE 0 END, 9) AS rate FROM events GROUP BY user_id""")
def cache_hit_rate(spark, sf):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf, "events").groupBy("user_id").agg(n("view").alias("h"), n("click").alias("m")).select("user_id", F.round(R.hit_rate(F.col("h"), F.col("m")), 9).alias("rate"))


@C.query("""SELECT source AS job, count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS indexed, count(*) FILTER (quality = 1 AND toxic = 1) AS skipped, count(*) FILTER (quality = 0) AS failed,
  CASE WHEN count(*) FILTER (quality = 0) = 0 THEN 'completed' WHEN count(*) FILTER (quality = 0) < count(*) THEN 'partial' ELSE 'failed' END AS state FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def job_status_counts(spark, sf):
    status = F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "skipped").otherwise("indexed")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("job")), "doc_id").withColumn("status", status)
    return R.job_status(rows, "job")


@C.query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'retryable' WHEN event_id % 9 IN (1, 2) THEN 'fatal' WHEN event_id % 9 IN (3, 4) THEN 'timeout' WHEN event_id % 9 IN (5, 6) THEN 'retryable' ELSE 'fatal' END AS kind,
  least(100 * power(2, event_id % 9), 5000)::BIGINT AS wait_ms FROM events""")
def error_classification(spark, sf):
    status = F.get(F.array(*[F.lit(s).cast("int") for s in (None, 401, 403, 408, 504, 429, 503, 404, 400)]), (F.col("event_id") % 9).cast("int"))
    return table(spark, sf, "events").select("event_id", R.error_kind(status).alias("kind"), R.backoff_ms(F.col("event_id") % 9 + 1, 100, 5000).alias("wait_ms"))


@C.query("""SELECT user_id AS tenant, sum(n)::BIGINT AS tokens, round(sum(CASE WHEN event_type = 'click' THEN n / 1e6 * 2.5::DOUBLE WHEN event_type = 'view' THEN 0 END), 9) AS cost,
  coalesce(sum(n) FILTER (event_type NOT IN ('click', 'view')), 0)::BIGINT AS unpriced FROM (SELECT *, event_id % 1000 AS n FROM events) GROUP BY user_id""")
def generation_accounting(spark, sf):
    rows = table(spark, sf, "events").withColumn("n", F.col("event_id") % 1000)
    price = R.cost(F.col("n"), F.when(F.col("event_type") == "click", 2.5), F.col("event_type") == "view")
    return rows.groupBy(F.col("user_id").alias("tenant")).agg(F.sum("n").alias("tokens"), F.round(F.sum(price), 9).alias("cost"), F.coalesce(F.sum(F.when(price.isNull(), F.col("n"))), F.lit(0)).alias("unpriced"))


@C.query("""SELECT event_type, greatest(count(*) - count(*) FILTER (value < 5) - count(*) FILTER (value > 90), 0) AS succeeded, round(count(*) / 60.0::DOUBLE, 9) AS per_second FROM events GROUP BY event_type""")
def ingest_metrics(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.greatest(F.count("*") - F.count_if(F.col("value") < 5) - F.count_if(F.col("value") > 90), F.lit(0)).alias("succeeded"), F.round(F.count("*") / 60.0, 9).alias("per_second"))


@C.query("""SELECT event_id AS key FROM events WHERE event_id % 5 = 0 OR value > 20 ORDER BY ts DESC, event_id LIMIT 100""")
def cache_evict(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("last_used"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("deadline"))
    return caches.evicted(rows, F.lit(20.0), 100).select("key")


@C.query("""SELECT event_type, time_bucket(INTERVAL 1 day, ts) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def daily_telemetry(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


@C.query("""SELECT source, count(*) FILTER (score IS NOT NULL) AS graded, count(*) FILTER (score IS NULL) AS ungraded, count(*) FILTER (score < 0.7) AS refused, round(avg(score), 9) AS faithfulness
  FROM (SELECT source, CASE WHEN quality = 1 THEN 0.5::DOUBLE + toxic / 2.0::DOUBLE END AS score FROM labels JOIN documents USING (doc_id)) GROUP BY source""")
def faithfulness_summary(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumn("score", F.when(F.col("quality") == 1, F.lit(0.5) + F.col("toxic") / 2))
    return rows.groupBy("source").agg(F.count("score").alias("graded"), F.count_if(F.col("score").isNull()).alias("ungraded"), F.count_if(F.col("score") < 0.7).alias("refused"), F.round(F.avg("score"), 9).alias("faithfulness"))
