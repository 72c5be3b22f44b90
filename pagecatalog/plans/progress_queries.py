"""Batches, progress and request metrics, over the events table read as a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagecatalog.functions.ordering import rank_within
from pagecatalog.operators import progress as P
from pagecatalog.plans.registry import query, table

# An event is an attempt to read what its user asked for on its day.
LOG = """
log AS (SELECT event_id, user_id || '/' || strftime(ts, '%Y%m%d') AS url, ts,
    (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))::INTEGER AS attempt,
    CASE event_type WHEN 'signup' THEN 429 WHEN 'error' THEN 500 WHEN 'purchase' THEN NULL ELSE 200 END AS status,
    event_type IN ('view', 'click') AS ok, value AS elapsed,
    CASE event_type WHEN 'signup' THEN 'rate limited' WHEN 'error' THEN 'server error' WHEN 'purchase' THEN 'timeout' END AS error,
    event_id // 50 AS batch_no FROM events)
"""
US_SECONDS = "epoch_us(ts) / 1e6"


def fetch_log(spark: SparkSession, folder: str, attempts: bool = False) -> DataFrame:
    """The log; numbering the attempts costs a shuffle, so only where they are used."""
    kind = F.col("event_type")
    log = table(spark, folder, "events").select(
        "event_id", F.concat_ws("/", "user_id", F.date_format("ts", "yyyyMMdd")).alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", 429).when(kind == "error", 500).when(kind != "purchase", 200).alias("status"),
        kind.isin("view", "click").alias("ok"), F.col("value").alias("elapsed"),
        F.when(kind == "signup", "rate limited").when(kind == "error", "server error")
        .when(kind == "purchase", "timeout").alias("error"),
        P.batch_of(F.col("event_id"), 50).alias("batch_no"))
    if attempts:
        log = rank_within(log, ["url"], ["ts", "event_id"], "attempt")
        log = log.withColumn("attempt", F.col("attempt").cast("int"))
    return log


@query("""
SELECT c_custkey, idx, (idx - 120) // 50 AS batch_no
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) WHERE idx >= 120""")
def batch_assignment(spark, folder):
    return P.assign_batches(table(spark, folder, "customer").select("c_custkey"), ["c_custkey"], 50, 120)


@query("""
SELECT idx // 50 AS batch_no, count(*) AS n, min(c_custkey) AS first_key, round(max(c_acctbal), 2) AS top_balance
FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) GROUP BY 1""")
def apply_per_batch(spark, folder):
    import pandas as pd

    def summarise(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "batch_no": [batch["batch_no"].iloc[0]], "n": [len(batch)],
            "first_key": [batch["c_custkey"].min()], "top_balance": [round(batch["c_acctbal"].max(), 2)]})

    batches = P.assign_batches(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"], 50)
    return P.apply_per_batch(batches, summarise, "batch_no long, n long, first_key long, top_balance double")


@query(f"""WITH {LOG} SELECT batch_no, count(*) AS links, count(*) FILTER (ok) AS records,
    round(count(*) FILTER (ok) * 100.0 / count(*), 4) AS success_pct FROM log GROUP BY 1""")
def batch_success_rate(spark, folder):
    return P.batch_success(fetch_log(spark, folder)).withColumn("success_pct", F.round("success_pct", 4))


@query(f"""
WITH {LOG}, per_batch AS (SELECT batch_no, count(*) AS n, count(*) FILTER (ok) AS n_ok,
    count(*) FILTER (NOT ok AND attempt >= 3) AS n_failed, count(*) FILTER (NOT ok AND attempt < 3) AS n_retried,
    min({US_SECONDS}) AS started, max({US_SECONDS} + elapsed) AS ended FROM log GROUP BY 1)
SELECT batch_no, least((batch_no + 1) * 50, (SELECT count(*) FROM events)) AS current_index,
    (SELECT count(*) FROM events) AS total_links, (sum(n) OVER w)::BIGINT AS total_processed,
    (sum(n_ok) OVER w)::BIGINT AS successful, (sum(n_failed) OVER w)::BIGINT AS failed,
    (sum(n_retried) OVER w)::BIGINT AS retried, round(ended - started, 2) AS batch_time,
    round(started, 2) AS start_time, round(ended, 2) AS last_update
FROM per_batch WINDOW w AS (ORDER BY batch_no)""")
def progress_records(spark, folder):
    total = table(spark, folder, "events").count()
    progress = P.progress_records(fetch_log(spark, folder, attempts=True), total, 50)
    return progress.select(
        "batch_no", "current_index", "total_links", "stats.total_processed", "stats.successful", "stats.failed",
        "stats.retried", F.round(F.get("stats.batch_times", F.lit(0)), 2).alias("batch_time"),
        F.round("stats.start_time", 2).alias("start_time"), F.round("last_update", 2).alias("last_update"))


@query("SELECT least((max(event_id) // 50 + 1) * 50, count(*)) AS current_index FROM events")
def resume_point(spark, folder):
    log = fetch_log(spark, folder)
    total = log.count()
    progress = log.select(F.least((F.col("batch_no") + 1) * 50, F.lit(total)).alias("current_index"))
    return P.resume_index(progress)


@query(f"""
WITH {LOG}, by_batch AS (SELECT max({US_SECONDS} + elapsed) - min({US_SECONDS}) AS seconds FROM log GROUP BY batch_no),
by_url AS (SELECT bool_or(ok) AS done FROM log GROUP BY url)
SELECT count(*) AS attempts, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok AND attempt >= 3) AS failed,
    count(*) FILTER (NOT ok AND attempt < 3) AS retried,
    round(count(*) FILTER (ok) * 100.0 / count(*), 4) AS success_pct_of_attempts,
    (SELECT count(*) FROM by_url) AS urls,
    round((SELECT count(*) FILTER (done) * 100.0 / count(*) FROM by_url), 4) AS success_pct_of_urls,
    round((SELECT avg(seconds) FROM by_batch), 2) AS mean_batch_seconds FROM log""")
def run_summary(spark, folder):
    summary = P.run_summary(fetch_log(spark, folder, attempts=True))
    return summary.withColumns({
        "success_pct_of_attempts": F.round("success_pct_of_attempts", 4),
        "success_pct_of_urls": F.round("success_pct_of_urls", 4),
        "mean_batch_seconds": F.round("mean_batch_seconds", 2)})


@query(f"""WITH {LOG} SELECT url, count(*) AS attempts FROM log GROUP BY 1
HAVING NOT bool_or(ok) AND count(*) < 3""")
def retry_candidates(spark, folder):
    return P.retry_candidates(fetch_log(spark, folder))


@query(f"""WITH {LOG} SELECT url, arg_max(error, ts) AS error, count(*) AS attempts FROM log GROUP BY 1
HAVING NOT bool_or(ok) AND count(*) >= 3""")
def dead_letters(spark, folder):
    return P.dead_letters(fetch_log(spark, folder))


@query(f"""WITH {LOG} SELECT url, attempt, 0.5 * 2.0 ** (attempt - 1) AS wait_seconds,
    epoch_us(ts) + (500000 * 2 ** (attempt - 1))::BIGINT AS retry_at_us FROM log WHERE NOT ok AND attempt < 3""")
def backoff_schedule(spark, folder):
    due = P.backoff_schedule(fetch_log(spark, folder, attempts=True))
    return due.select("url", "attempt", "wait_seconds", F.unix_micros("retry_at").alias("retry_at_us"))


@query(f"""WITH {LOG} SELECT count(*) AS requests_total, count(*) FILTER (ok) AS requests_success,
    count(*) FILTER (NOT ok) AS requests_failed, round(avg(elapsed), 4) AS avg_request_time,
    min(elapsed) AS min_request_time, max(elapsed) AS max_request_time,
    round(count(*) FILTER (ok) * 100.0 / count(*), 4) AS success_pct FROM log""")
def request_stats(spark, folder):
    return P.request_stats(fetch_log(spark, folder)).withColumns({
        "avg_request_time": F.round("avg_request_time", 4), "success_pct": F.round("success_pct", 4)})


@query(f"""WITH {LOG}, classed AS (SELECT CASE WHEN status = 200 THEN 'ok' WHEN status IN (429, 503) THEN 'retry_later'
    WHEN status IS NOT NULL THEN 'http_error' ELSE error END AS response_class FROM log)
SELECT response_class, count(*) AS responses, (count(*) * CASE response_class WHEN 'retry_later' THEN 1.5
    WHEN 'timeout' THEN 1.0 ELSE 0.0 END)::DOUBLE AS delay_seconds FROM classed GROUP BY 1""")
def response_classes(spark, folder):
    return P.response_classes(fetch_log(spark, folder))


@query(f"""WITH {LOG}, classed AS (SELECT CASE WHEN status = 403 THEN 'retry_later' WHEN status IS NOT NULL THEN 'ok'
    ELSE 'unexpected' END AS response_class FROM (SELECT * REPLACE (CASE WHEN status = 429 THEN 403 ELSE status END AS status) FROM log))
SELECT response_class, count(*) AS responses,
    (count(*) * CASE WHEN response_class = 'ok' THEN 0.0 ELSE 5.0 END)::DOUBLE AS delay_seconds FROM classed GROUP BY 1""")
def response_classes_second_source(spark, folder):
    """The second source refuses with 403 where the first one says 429."""
    log = fetch_log(spark, folder)
    return P.response_classes(log.withColumn("status", F.when(F.col("status") == 429, 403).otherwise(F.col("status"))), second_source=True)


@query(f"""WITH {LOG} SELECT epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS requests FROM log
GROUP BY 1 HAVING count(*) > 20""")
def rate_violations(spark, folder):
    return P.rate_violations(fetch_log(spark, folder), 20, "1 hour").select(
        F.unix_micros("window_start").alias("window_us"), "requests")


@query("""
WITH resume_at AS (SELECT coalesce(max(n), 0) AS start FROM (SELECT count(DISTINCT user_id) AS n FROM events GROUP BY event_type))
SELECT c_custkey, idx, (idx - start) // 50 AS batch_no
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer), resume_at WHERE idx >= start""")
def resume_pending(spark, folder):
    progress = table(spark, folder, "events").groupBy("event_type") \
        .agg(F.count_distinct("user_id").alias("current_index"))
    return P.resume_pending(table(spark, folder, "customer").select("c_custkey"), progress, ["c_custkey"])
