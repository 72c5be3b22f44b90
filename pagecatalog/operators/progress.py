"""Batches, progress, retries and request metrics, from a log with one row per attempt:
``url, attempt, status, ok, elapsed, error, ts``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagecatalog import defaults as D
from pagecatalog.functions.ordering import global_index, rank_within, running_totals


def batch_of(index: Column, batch_size: int, start_index: int = 0) -> Column:
    return F.floor((index - start_index) / F.lit(batch_size)).cast("long")


def assign_batches(df: DataFrame, order: Sequence[str], batch_size: int = D.BATCH_SIZE,
                   start_index: int = 0) -> DataFrame:
    """Rows from ``start_index`` on, with their index and batch number; none if it is
    beyond the end."""
    if batch_size < 1 or start_index < 0:
        raise ValueError("batch_size must be positive and start_index not negative")
    indexed = global_index(df, order, "idx").filter(F.col("idx") >= start_index)
    return indexed.withColumn("batch_no", batch_of(F.col("idx"), batch_size, start_index))


def apply_per_batch(batches: DataFrame, fn: Callable, schema) -> DataFrame:
    """``fn`` (pandas in, pandas out) on each batch, results concatenated. A batch is
    bounded by its size, so each group is."""
    return batches.groupBy("batch_no").applyInPandas(fn, schema)


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def _side_by_side(*totals: DataFrame) -> DataFrame:
    """One-row frames of different columns as one row, by a union instead of a product."""
    rows = totals[0]
    for other in totals[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def batch_success(log: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Links, records and success rate of each batch."""
    ok = F.count_if("ok")
    return log.groupBy(batch).agg(
        F.count(F.lit(1)).alias("links"), ok.alias("records"),
        _percent(ok, F.count(F.lit(1))).alias("success_pct"))


def _retried(max_attempts: int) -> Column:
    return ~F.col("ok") & (F.col("attempt") < max_attempts)


def _failed(max_attempts: int) -> Column:
    return ~F.col("ok") & (F.col("attempt") >= max_attempts)


def progress_records(log: DataFrame, total_links: int, batch_size: int = D.BATCH_SIZE, batch: str = "batch_no",
                     max_attempts: int = D.MAX_ATTEMPTS, start_index: int = 0, retries: Column | None = None,
                     before: dict[str, int] | None = None) -> DataFrame:
    """One progress record per batch, counters running over the batches before.

    ``retries`` counts a row's repeated attempts where the log has one row per URL;
    ``before`` holds the counters of an earlier part of the run. Without times in the log
    the times are NULL.

    ``batch_times`` holds this batch's time only: a list that repeats all earlier ones
    in every record would grow with the square of the run.
    """
    epoch = F.unix_micros("ts") / 1e6
    per_batch = log.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"),
        F.count_if(_failed(max_attempts)).alias("n_failed"),
        (F.count_if(_retried(max_attempts)) if retries is None else F.coalesce(F.sum(retries), F.lit(0))).alias("n_retried"),
        F.min(epoch).alias("started"), F.max(epoch + F.col("elapsed")).alias("ended"))
    totals = running_totals(per_batch, [batch], {
        "total_processed": F.col("n"), "successful": F.col("n_ok"),
        "failed": F.col("n_failed"), "retried": F.col("n_retried")})
    totals = totals.withColumns({c: F.col(c) + (before or {}).get(c, 0) for c in ("total_processed", "successful", "failed", "retried")})
    return totals.select(
        F.col(batch).cast("long").alias("batch_no"),
        F.least((F.col(batch) + 1) * batch_size + start_index, F.lit(total_links)).cast("long").alias("current_index"),
        F.lit(total_links).cast("long").alias("total_links"),
        F.struct("total_processed", "successful", "failed", "retried",
                 F.array(F.col("ended") - F.col("started")).alias("batch_times"),
                 F.col("started").alias("start_time")).alias("stats"),
        F.col("ended").alias("last_update"))


def run_summary(log: DataFrame, batch: str = "batch_no", max_attempts: int = D.MAX_ATTEMPTS) -> DataFrame:
    """Totals of a run. Success is given of attempts and, apart, of URLs."""
    epoch = F.unix_micros("ts") / 1e6
    by_batch = log.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"),
        F.count_if(_failed(max_attempts)).alias("n_failed"),
        F.count_if(_retried(max_attempts)).alias("n_retried"),
        (F.max(epoch + F.col("elapsed")) - F.min(epoch)).alias("seconds"))
    totals = by_batch.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"),
        F.coalesce(F.sum("n_ok"), F.lit(0)).alias("successful"),
        F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("n_retried"), F.lit(0)).alias("retried"),
        F.avg("seconds").alias("mean_batch_seconds"))
    urls = log.groupBy("url").agg(F.max("ok").alias("done")) \
        .agg(F.count(F.lit(1)).alias("urls"), F.count_if("done").alias("urls_done"))
    return _side_by_side(totals, urls).select(
        "attempts", "successful", "failed", "retried",
        _percent(F.col("successful"), F.col("attempts")).alias("success_pct_of_attempts"),
        "urls", _percent(F.col("urls_done"), F.col("urls")).alias("success_pct_of_urls"),
        F.coalesce("mean_batch_seconds", F.lit(0.0)).alias("mean_batch_seconds"))


def _outcomes(log: DataFrame) -> DataFrame:
    return log.groupBy("url").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("ok").alias("done"),
        F.max_by("error", "ts").alias("last_error"))


def retry_candidates(log: DataFrame, max_attempts: int = D.MAX_ATTEMPTS) -> DataFrame:
    """URLs without success so far and with attempts left."""
    return _outcomes(log).filter(~F.col("done") & (F.col("attempts") < max_attempts)).select("url", "attempts")


def dead_letters(log: DataFrame, max_attempts: int = D.MAX_ATTEMPTS) -> DataFrame:
    """URLs that used up their attempts, with the last error."""
    return _outcomes(log).filter(~F.col("done") & (F.col("attempts") >= max_attempts)) \
        .select("url", F.col("last_error").alias("error"), "attempts")


def backoff_seconds(attempt: Column, delay: float = D.REQUEST_DELAY) -> Column:
    return F.lit(delay) * F.pow(F.lit(2.0), attempt - 1)


def backoff_schedule(log: DataFrame, max_attempts: int = D.MAX_ATTEMPTS,
                     delay: float = D.REQUEST_DELAY) -> DataFrame:
    """When each failed attempt with attempts left is due again."""
    wait = backoff_seconds(F.col("attempt"), delay)
    return log.filter(_retried(max_attempts)).select(
        "url", "attempt", "ts", wait.alias("wait_seconds"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)).alias("retry_at"))


def request_stats(log: DataFrame) -> DataFrame:
    """Request counts, times and success rate; zeros on an empty log."""
    n, ok = F.count(F.lit(1)), F.count_if("ok")
    zero = F.lit(0.0)
    return log.agg(
        n.alias("requests_total"), ok.alias("requests_success"), (n - ok).alias("requests_failed"),
        F.coalesce(F.avg("elapsed"), zero).alias("avg_request_time"),
        F.coalesce(F.min("elapsed"), zero).alias("min_request_time"),
        F.coalesce(F.max("elapsed"), zero).alias("max_request_time"),
        _percent(ok, n).alias("success_pct"))


# Kind of failure without a status -> seconds waited.
FAILURE_DELAYS = {
    "connection": 0.5,
    "payload": 0.5,
    "response": 0.5,
    "client": 0.5,
    "timeout": 1.0,
}
UNEXPECTED_DELAY = 0.5
RATE_LIMIT_DELAY = 1.5
# The second source waits from 5 to 10 s.
SECOND_SOURCE_DELAY = 5.0
SECOND_SOURCE_MOST = 10.0


def response_class(status: Column, failure: Column, second_source: bool = False) -> Column:
    """What a response counts as. The second source retries status 403."""
    if second_source:  # only a refusal and a failed load make it wait; any other status gives a page
        return F.when(status == 403, "retry_later").when(status.isNotNull(), "ok").otherwise("unexpected")
    limited = status.isin(429, 503)
    return (F.when(status == 200, "ok")
            .when(limited, "retry_later")
            .when(status.isNotNull(), "http_error")
            .when(failure.isin(*FAILURE_DELAYS), failure)
            .otherwise("unexpected"))


def class_delay(kind: Column, second_source: bool = False) -> Column:
    """Seconds waited after a response of this class; of the second source, at least."""
    if second_source:
        return F.when(kind.isin("retry_later", "unexpected"), SECOND_SOURCE_DELAY).otherwise(0.0)
    delay = F.when(kind == "retry_later", RATE_LIMIT_DELAY).when(kind == "unexpected", UNEXPECTED_DELAY)
    for failure, seconds in FAILURE_DELAYS.items():
        delay = delay.when(kind == failure, seconds)
    return delay.otherwise(0.0)


def response_classes(log: DataFrame, second_source: bool = False) -> DataFrame:
    """Responses per class, and the waiting they caused."""
    kind = response_class(F.col("status"), F.col("error"), second_source)
    counts = log.groupBy(kind.alias("response_class")).agg(F.count(F.lit(1)).alias("responses"))
    return counts.withColumn("delay_seconds", F.col("responses") * class_delay(F.col("response_class"), second_source))


def rate_violations(log: DataFrame, per_window: int = D.REQUESTS_PER_SECOND, window: str = "1 second") -> DataFrame:
    """Windows with more requests than allowed."""
    counts = log.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.filter(F.col("requests") > per_window).select(F.col("w.start").alias("window_start"), "requests")


def request_schedule(urls: DataFrame, host: str, order: Sequence[str], delay: float = D.PAGE_DELAY,
                     batch_size: int = D.BATCH_SIZE, batch_delay: float = D.BATCH_DELAY) -> DataFrame:
    """Planned start of each request, in seconds after its host's first: ``delay`` apart,
    and ``batch_delay`` more between batches. Pass ``REQUEST_DELAY`` for single records."""
    ranked = rank_within(urls, [host], order, "nth")
    earlier = F.col("nth") - 1
    return ranked.withColumn("start_offset", earlier * F.lit(delay) + F.floor(earlier / batch_size) * F.lit(batch_delay))


def resume_index(progress: DataFrame) -> DataFrame:
    """The index to go on from: the largest stored one, 0 if there is none."""
    return progress.agg(F.coalesce(F.max("current_index"), F.lit(0)).cast("long").alias("current_index"))


def resume_pending(urls: DataFrame, progress: DataFrame, order: Sequence[str],
                   batch_size: int = D.BATCH_SIZE) -> DataFrame:
    """Batches of what is left. One number passes through the driver."""
    start = resume_index(progress).first()["current_index"]
    return assign_batches(urls, order, batch_size, start)


def discovery_summary(links: DataFrame, log: DataFrame, key: str = "link") -> DataFrame:
    """Distinct URLs found and time per URL, NULL when none was found."""
    found = links.select(key).distinct().agg(F.count(F.lit(1)).alias("unique_urls"))
    spent = log.agg(F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("total_seconds"))
    return _side_by_side(found, spent).select(
        "unique_urls", "total_seconds",
        F.try_divide("total_seconds", "unique_urls").alias("seconds_per_url"))
