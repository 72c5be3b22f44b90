"""Request metrics of a running query, from the rows it reads and without another pass.

The counts ride along as observed metrics: Spark sums them up in the tasks of each micro-batch
and reports them with its progress. A listener adds the batches up into the figures that
``progress.request_stats`` computes from a whole log.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

NAME = "requests"

STATS = T.StructType([
    T.StructField("requests_total", T.LongType()), T.StructField("requests_success", T.LongType()), T.StructField("requests_failed", T.LongType()),
    T.StructField("avg_request_time", T.DoubleType()), T.StructField("min_request_time", T.DoubleType()),
    T.StructField("max_request_time", T.DoubleType()), T.StructField("success_pct", T.DoubleType())])


def observed(log: DataFrame, name: str = NAME) -> DataFrame:
    """``log (ok, elapsed)``, its requests counted as they pass."""
    return log.observe(name, F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count("elapsed").alias("timed"),
                       F.sum("elapsed").alias("elapsed"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"))


class RequestMetrics(StreamingQueryListener):
    """Adds up what :func:`observed` counted, per query and batch: a batch that is run again counts once.

    Only the counts of each batch are kept.
    """

    def __init__(self, name: str = NAME):
        self.name = name
        self._batches: dict[tuple[str, int], Row] = {}
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(self.name)
        if counts is not None:
            with self._changed:
                self._batches[str(event.progress.id), event.progress.batchId] = counts

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait_for(self, query, seconds: float = 60.0) -> None:
        """Wait until a query has ended and all its batches are counted: reports come after the fact."""
        query.awaitTermination()
        with self._changed:
            self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds)

    def stats(self) -> Row:
        """Zeros where nothing was requested."""
        with self._changed:
            found = list(self._batches.values())
        total, ok, timed = (sum(r[c] for r in found) for c in ("total", "ok", "timed"))
        elapsed = sum(r["elapsed"] or 0.0 for r in found)
        least = min((r["least"] for r in found if r["least"] is not None), default=0.0)
        most = max((r["most"] for r in found if r["most"] is not None), default=0.0)
        return Row(requests_total=total, requests_success=ok, requests_failed=total - ok, avg_request_time=elapsed / timed if timed else 0.0,
                   min_request_time=float(least), max_request_time=float(most), success_pct=100.0 * ok / total if total else 0.0)


def as_frame(spark: SparkSession, metrics: RequestMetrics) -> DataFrame:
    return spark.createDataFrame([tuple(metrics.stats())], STATS)
