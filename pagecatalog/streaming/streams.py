"""Streaming forms of the long-running queue: file sources in, files out.

Every sink is a function of ``(DataFrame, batch_id)`` whose effect is named by the batch,
so a batch that is replayed after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from pagecatalog import defaults as D
from pagecatalog.operators.catalog import latest
from pagecatalog.operators.progress import backoff_seconds
from pagecatalog.session import materialize, remove_path, scratch, session_conf
from pagecatalog.sources.keyed import KeyedTable
from pagecatalog.sources.readers import read_table_files

BatchSink = Callable[[DataFrame, int], None]

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to Parquet files, then stop."""
    return df.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint).option("path", path) \
        .trigger(availableNow=True).start()


def to_sink(df: DataFrame, sink: BatchSink, checkpoint: str, flush_seconds: int | None = None,
            mode: str = "append") -> StreamingQuery:
    """Hand micro-batches to ``sink``: all that is there and stop, or every
    ``flush_seconds`` until stopped."""
    trigger = {"processingTime": f"{flush_seconds} seconds"} if flush_seconds else {"availableNow": True}
    return df.writeStream.outputMode(mode).foreachBatch(sink) \
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()


def batch_files(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> BatchSink:
    """A sink that keeps each batch in a folder of its own, overwritten on replay."""
    def sink(df: DataFrame, batch_id: int) -> None:
        out = transform(df) if transform else df
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink


def snapshot_sink(path: str, key: str, every: int = D.SNAPSHOT_EVERY) -> BatchSink:
    """Keep the batches, and on every ``every``-th write the distinct keys seen so far."""
    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")
        if batch_id % every == 0:
            take_snapshot(df.sparkSession, path, key, batch_id)

    return sink


def take_snapshot(spark: SparkSession, path: str, key: str, upto: int) -> None:
    """The distinct keys of all batches up to this one: those of the snapshot before, and
    of the batches since."""
    at = T.StructType([T.StructField(key, T.StringType()), T.StructField("at", T.LongType())])
    snapshots = read_table_files(spark, f"{path}/snapshots", at).filter(F.col("at") < upto)
    last = snapshots.agg(F.max("at").alias("at")).first()["at"]
    since = spark.read.parquet(f"{path}/seen").filter(F.col("batch_id").between((-1 if last is None else last) + 1, upto)).select(key)
    kept = since if last is None else since.union(snapshots.filter(F.col("at") == last).select(key))
    materialize(kept.distinct(), "snapshot").write.mode("overwrite").parquet(f"{path}/snapshots/at={upto}")


def upsert_sink(path: str) -> BatchSink:
    """Records as they arrive. A batch is only written, not merged: rewriting the whole
    table per batch would cost the size of the table. See :func:`read_upserted`."""
    return batch_files(f"{path}/changes")


_FOLDED = T.StructType([T.StructField("upto", T.LongType())])


def _changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Changes that no compaction has folded in yet."""
    folded = read_table_files(spark, f"{path}/folded", _FOLDED).agg(F.max("upto").alias("upto")).first()["upto"]
    changes = read_table_files(spark, f"{path}/changes", T.StructType(
        [*schema.fields, T.StructField("batch_id", T.LongType())]))
    return changes if folded is None else changes.filter(F.col("batch_id") > folded)


def read_upserted(spark: SparkSession, path: str, schema: T.StructType, key: list[str], seq: str) -> DataFrame:
    """The table as of now: the compacted rows, and over them, per key, the change with the
    largest ``seq``, of repeats the last to arrive. Folders of folded batches are not read."""
    base = _table(spark, path, schema, key).read()
    new = latest(_changes(spark, path, schema), key, [F.desc(seq), F.desc("batch_id")]).drop("batch_id")
    return _laid_over(base, new, key, seq)


def _table(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> KeyedTable:
    return KeyedTable(spark, f"{path}/table", schema, tuple(key))


def _laid_over(base: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    both = base.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
    return latest(both, key, [F.desc_nulls_last(seq), F.desc("_new")]).drop("_new")


def start_from(base: DataFrame, path: str, key: list[str]) -> int:
    """Make ``base`` the table that changes are laid over."""
    return _table(base.sparkSession, path, base.schema, key).save(base)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: list[str], seq: str) -> int:
    """Fold the changes so far into the table, and note up to which batch; returns the table's
    version. Only rows of changed keys are written. Batches that the compaction before folded
    are deleted; those of this one stay for readers that have them open."""
    folded = read_table_files(spark, f"{path}/folded", _FOLDED).agg(F.max("upto").alias("upto")).first()["upto"]
    changes = _changes(spark, path, schema)
    upto = changes.agg(F.max("batch_id").alias("upto")).first()["upto"]
    table = _table(spark, path, schema, key)
    if upto is None:
        return table.version()
    with scratch(spark):
        new = latest(changes.filter(F.col("batch_id") <= upto), key, [F.desc(seq), F.desc("batch_id")]).drop("batch_id")
        changed = new.select(*[F.col(k).alias(f"_{k}") for k in key])
        base = table.read()
        met = base.join(changed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_semi")
        version = table.save(materialize(_laid_over(met, new, key, seq), "folded"))
    spark.createDataFrame([(upto,)], _FOLDED).coalesce(1).write.mode("append").parquet(f"{path}/folded")
    if folded is not None:
        for batch in (r["batch_id"] for r in spark.read.parquet(f"{path}/changes").select("batch_id").distinct().collect()):
            if batch <= folded:
                remove_path(spark, f"{path}/changes/batch_id={batch}")
    table.retire()
    return version


def pending_with_captures(frontier: DataFrame, attempted: DataFrame, captures: DataFrame) -> DataFrame:
    """Streamed frontier rows that were never attempted, with their captures."""
    todo = frontier.join(attempted.select("url").distinct(), "url", "left_anti")
    return todo.join(captures, "url", "inner")


def pending_as_captured(frontier: DataFrame, attempted: DataFrame, captures: DataFrame, wait: str, keep: str,
                        late: str) -> DataFrame:
    """Streamed frontier rows ``(pos, url, listed_at)`` that were never attempted, with captures
    ``(url, html, fetched_at)`` that are streamed too, in whichever order they come.

    A capture belongs to a row if it is at most ``keep`` older and ``wait`` younger. A row that
    none came for by then is handed on without HTML; rows and captures are forgotten when their
    time is over, ``late`` after the newest seen.
    """
    todo = frontier.withWatermark("listed_at", late).join(attempted.select("url").distinct(), "url", "left_anti")
    pages = captures.select(F.col("url").alias("_url"), "html", "fetched_at").withWatermark("fetched_at", late)
    on = F.expr(f"url = _url AND fetched_at >= listed_at - INTERVAL {keep} AND fetched_at <= listed_at + INTERVAL {wait}")
    return todo.join(pages, on, "left_outer").select("pos", "url", "listed_at", "fetched_at", "html")


def captured_sink(path: str, error: str = "no capture") -> BatchSink:
    """Rows of :func:`pending_as_captured`: pages with HTML, and the error ledger for the others."""
    def sink(df: DataFrame, batch_id: int) -> None:
        with scratch(df.sparkSession):
            rows = materialize(df, "captured")
            rows.filter("html is not null").write.mode("overwrite").parquet(f"{path}/captured/batch_id={batch_id}")
            missing = rows.filter("html is null").select("url", F.lit(error).alias("error"))
            missing.write.mode("overwrite").parquet(f"{path}/errors/batch_id={batch_id}")

    return sink


def seen_once(urls: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """Each key once within the horizon; state older than it is dropped, so a key that
    returns later counts as new."""
    return urls.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def request_rate(log: DataFrame, window: str, late: str = "10 minutes") -> DataFrame:
    """Requests per window, final once no later row can arrive."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")) \
        .agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("window_start"), "requests")


def track_retries(log: DataFrame, max_attempts: int = D.MAX_ATTEMPTS, delay: float = D.REQUEST_DELAY) -> DataFrame:
    """Standing of each URL that a batch of the log ``(url, ok, error, ts)`` touched:
    ``done``, ``retry`` with when it is due again, or ``dead`` with its last error.

    Counts and maxima per URL are all the state there is, so this is a streaming
    aggregation; use update mode. No URL's rows are ever held together.
    """
    at = F.unix_micros("ts")
    seen = log.groupBy("url").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("ok").alias("done"),
        F.max_by("error", at).alias("last_error"), F.max(at).alias("last_us"))
    state = F.when(F.col("done"), "done").when(F.col("attempts") < max_attempts, "retry").otherwise("dead")
    wait_us = (backoff_seconds(F.col("attempts"), delay) * 1_000_000).cast("long")
    return seen.select("url", "attempts", state.alias("state"), "last_error", "last_us").select(
        "url", "attempts", "state",
        F.when(F.col("state") == "dead", F.col("last_error")).alias("error"),
        F.when(F.col("state") == "retry", F.col("last_us") + wait_us).alias("retry_at_us"))


def with_rocksdb(spark: SparkSession):
    """Keep streaming state on disk while a query starts: for state that outgrows memory."""
    return session_conf(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB)
