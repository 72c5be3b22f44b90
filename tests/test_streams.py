import pytest
from pyspark.sql import Row, functions as F

from pagecatalog.operators import progress as P
from pagecatalog.session import fresh_path
from pagecatalog.sources.keyed import KeyedTable
from pagecatalog.streaming import metrics as M, retries as R, streams as S


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def urls(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "url string, seq long")


@pytest.fixture
def place(spark):
    return fresh_path(spark, "stream-test")


def test_snapshots_on_every_nth_batch(spark, place):
    for name in "abcdef":
        write(urls(spark, name, "always"), f"{place}/in")
    stream = S.read_stream(spark, f"{place}/in", urls(spark).schema, files_per_batch=1)
    S.to_sink(stream, S.snapshot_sink(f"{place}/out", "url", every=4), f"{place}/cp").awaitTermination()
    sizes = {r["at"]: r["count"] for r in spark.read.parquet(f"{place}/out/snapshots").groupBy("at").count().collect()}
    assert sizes == {0: 2, 4: 6}


def test_upsert_takes_later_rows_and_survives_replay(spark, place):
    schema = spark.createDataFrame([], "id string, v int, seq long").schema
    first = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema)
    second = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 1, 1)], schema)
    sink = S.upsert_sink(place)
    for batch_id, df in ((0, first), (1, second), (1, second), (0, first)):  # both batches replayed
        sink(df, batch_id)
    now = S.read_upserted(spark, place, schema, ["id"], "seq")
    assert sorted(map(tuple, now.collect())) == [("a", 1, 1), ("b", 3, 3), ("c", 1, 1)]
    base = spark.createDataFrame([("a", 0, 0), ("z", 9, 0)], schema)
    S.start_from(base, place, ["id"])
    S.compact(spark, place, schema, ["id"], "seq")
    table = KeyedTable(spark, f"{place}/table", schema, ("id",)).read()
    assert sorted(map(tuple, table.collect())) == [("a", 1, 1), ("b", 3, 3), ("c", 1, 1), ("z", 9, 0)]


def test_compaction_writes_what_changed_and_retires_what_it_folded(spark, place):
    schema = spark.createDataFrame([], "id int, v int, seq long").schema
    S.start_from(spark.range(4000).selectExpr("cast(id as int) id", "0 v", "cast(0 as long) seq"), place, ["id"])
    sink = S.upsert_sink(place)
    sizes = []
    for batch_id in range(6):
        sink(spark.createDataFrame([(batch_id, batch_id + 1, batch_id + 1), (99, batch_id, -1 if batch_id else 5), (5000 + batch_id, 1, 1)], schema), batch_id)
        before = S.read_upserted(spark, place, schema, ["id"], "seq")
        S.compact(spark, place, schema, ["id"], "seq")
        assert before.count() == 4000 + batch_id + 1  # opened before the compaction
        sizes.append(sum(s.n_rows for s in KeyedTable(spark, f"{place}/table", schema, ("id",)).manifest()[1] if s.seq == batch_id + 2))
    now = {r.id: r.v for r in S.read_upserted(spark, place, schema, ["id"], "seq").collect()}
    assert len(now) == 4006 and now[99] == 0 and all(now[i] == i + 1 for i in range(6)) and now[7] == 0
    assert sizes == [3] * 6
    assert spark.read.parquet(f"{place}/changes").select("batch_id").distinct().count() == 1


def test_a_restarted_stream_goes_on_where_it_stopped(spark, place):
    def run():
        stream = S.read_stream(spark, f"{place}/in", urls(spark).schema, files_per_batch=1)
        S.to_files(stream.select("url"), f"{place}/out", f"{place}/cp").awaitTermination()

    write(urls(spark, "a", "b"), f"{place}/in")
    run()
    write(urls(spark, "c"), f"{place}/in")
    run()
    run()
    assert sorted(r.url for r in spark.read.parquet(f"{place}/out").collect()) == ["a", "b", "c"]


def test_frontier_stream(spark, place):
    write(urls(spark, "a", "b"), f"{place}/in")
    write(urls(spark, "c", "d"), f"{place}/in")
    captures = spark.createDataFrame([("a", "A"), ("c", "C"), ("d", "D")], "url string, html string")
    stream = S.read_stream(spark, f"{place}/in", urls(spark).schema, files_per_batch=1)
    todo = S.pending_with_captures(stream, urls(spark, "c"), captures)
    S.to_files(todo, f"{place}/out", f"{place}/cp").awaitTermination()
    assert sorted(r.html for r in spark.read.parquet(f"{place}/out").collect()) == ["A", "D"]


def test_captures_that_come_before_with_and_after_their_url(spark, place):
    at = lambda df, name: df.withColumn(name, F.col(name).cast("timestamp"))
    listed = [[("early", 1, "2024-01-01 10:00:00"), ("late", 2, "2024-01-01 10:00:00"), ("never", 3, "2024-01-01 10:00:00"), ("too late", 4, "2024-01-01 10:00:00"),
               ("tried", 5, "2024-01-01 10:00:00")], [("end", 9, "2024-01-05 00:00:00")]]
    stored = [[("early", "E", "2024-01-01 09:00:00"), ("tried", "T", "2024-01-01 10:00:00")],
              [("late", "L", "2024-01-01 11:30:00"), ("too late", "X", "2024-01-01 13:00:00"), ("end", "", "2024-01-05 00:00:00")]]
    for rows in listed:
        write(at(spark.createDataFrame(rows, "url string, pos long, listed_at string"), "listed_at"), f"{place}/listed")
    for rows in stored:
        write(at(spark.createDataFrame(rows, "url string, html string, fetched_at string"), "fetched_at"), f"{place}/stored")
    one, two = (S.read_stream(spark, f"{place}/{n}", spark.read.parquet(f"{place}/{n}").schema, files_per_batch=1) for n in ("listed", "stored"))
    joined = S.pending_as_captured(one, urls(spark, "tried"), two, wait="2 hours", keep="24 hours", late="1 hour")
    S.to_sink(joined, S.captured_sink(f"{place}/out"), f"{place}/cp").awaitTermination()
    found = {r.url: r.html for r in spark.read.parquet(f"{place}/out/captured").collect()}
    assert found == {"early": "E", "late": "L", "end": ""}
    assert sorted(r.url for r in spark.read.parquet(f"{place}/out/errors").collect()) == ["never", "too late"]


def test_metrics_of_a_running_query_equal_those_of_its_log(spark, place):
    rows = [("a", True, 0.5), ("a", False, 1.5), ("b", True, None), ("c", False, 0.25), ("d", True, 3.0)]
    for row in rows:
        write(spark.createDataFrame([row], "url string, ok boolean, elapsed double"), f"{place}/in")
    log = spark.read.parquet(f"{place}/in")
    metrics = M.RequestMetrics()
    assert metrics.stats().requests_total == 0 and metrics.stats().success_pct == 0.0
    spark.streams.addListener(metrics)
    try:
        stream = S.read_stream(spark, f"{place}/in", log.schema, files_per_batch=2)
        metrics.wait_for(S.to_files(M.observed(stream).select("url"), f"{place}/out", f"{place}/cp"))
    finally:
        spark.streams.removeListener(metrics)
    assert metrics.stats() == P.request_stats(log).first() and len(metrics._batches) >= 3
    assert M.as_frame(spark, metrics).first() == metrics.stats()


def stamped(spark, *rows):
    return spark.createDataFrame(rows, "url string, ok boolean, error string, t string") \
        .select("url", "ok", "error", F.col("t").cast("timestamp").alias("ts"))


def test_dedup_within_the_horizon(spark, place):
    write(stamped(spark, ("a", True, None, "2024-01-01 00:00:00"), ("a", True, None, "2024-01-01 00:01:00")), f"{place}/in")
    write(stamped(spark, ("a", True, None, "2024-01-01 00:02:00"), ("b", True, None, "2024-01-01 00:03:00")), f"{place}/in")
    stream = S.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema, files_per_batch=1)
    S.to_files(S.seen_once(stream, "url", "ts", "1 hour").select("url"), f"{place}/out", f"{place}/cp").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{place}/out").collect()) == ["a", "b"]


@pytest.mark.parametrize("on_disk", [False, True])
def test_retry_standing_over_batches_equals_the_batch_operators(spark, place, on_disk):
    rows = [("a", False, "e1", "2024-01-01 00:00:00"), ("a", True, None, "2024-01-01 00:00:01"),
            ("b", False, "e1", "2024-01-01 00:00:00"), ("b", False, "e3", "2024-01-01 00:00:09"),
            ("b", False, "e2", "2024-01-01 00:00:05"), ("c", False, "e", "2024-01-01 00:00:02")]
    for row in rows:
        write(stamped(spark, row), f"{place}/in")
    whole = spark.read.parquet(f"{place}/in")

    def run():
        standing = S.track_retries(S.read_stream(spark, f"{place}/in", whole.schema, files_per_batch=2))
        S.to_sink(standing, S.batch_files(f"{place}/out"), f"{place}/cp", mode="update").awaitTermination()

    if on_disk:
        with S.with_rocksdb(spark):
            run()
    else:
        run()
    last = S.latest(spark.read.parquet(f"{place}/out"), ["url"], [F.desc("batch_id")])
    got = {r.url: (r.attempts, r.state, r.error) for r in last.collect()}
    assert got == {"a": (2, "done", None), "b": (3, "dead", "e3"), "c": (1, "retry", None)}
    assert {r.url for r in P.dead_letters(whole).collect()} == {"b"}
    assert {r.url for r in P.retry_candidates(whole).collect()} == {"c"}
    due = last.filter("url = 'c'").select(F.timestamp_micros("retry_at_us").cast("string").alias("t")).first().t
    assert due == "2024-01-01 00:00:02.5"


def test_dedup_forgets_after_the_horizon(spark, place):
    """A key is dropped from state once a batch ends with the watermark past its horizon."""
    days = (1, 2, 3, 4, 9, 10)
    for day in days:
        write(stamped(spark, ("a", True, None, f"2024-01-{day:02d} 00:00:00"), (f"only {day}", True, None, f"2024-01-{day:02d} 00:00:00")), f"{place}/in")
    stream = S.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema, files_per_batch=1)
    S.to_files(S.seen_once(stream, "url", "ts", "26 hours").select("url"), f"{place}/out", f"{place}/cp").awaitTermination()
    counts = {r.url: r["count"] for r in spark.read.parquet(f"{place}/out").groupBy("url").count().collect()}
    assert counts == {"a": 2, **{f"only {d}": 1 for d in days}}  # the first day's, and the last's


class _Held:
    """A state handle that counts what it is asked."""

    def __init__(self):
        self.value, self.set, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("timer")
        self.set.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.set.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_retry_standing_takes_rows_and_asks_state_once(spark):
    """Every call on the state leaves the Python process, and a frame per URL costs more than its work."""
    held = _Held()
    standing = R.RetryStanding(max_attempts=3, delay=0.5, horizon_seconds=10)
    standing.init(held)
    one = [Row(url="a", ok=False, error="e2", at_us=2_000_000), Row(url="a", ok=None, error="e1", at_us=1_000_000)]
    assert list(standing.handleInputRows(("a",), iter(one), held)) == [
        Row(url="a", attempts=2, state="retry", error=None, retry_at_us=3_000_000)]
    assert held.calls == ["get", "timer", "timer", "update"] and held.set == {3000, 12000}
    two = [Row(url="a", ok=False, error="e0", at_us=500_000)]
    assert list(standing.handleInputRows(("a",), iter(two), held)) == [
        Row(url="a", attempts=3, state="dead", error="e2", retry_at_us=None)]
    assert held.calls[4:] == ["get", "timer", "update"] and held.set == {12000}


def test_retry_state_ends_and_says_what_is_due(spark, place):
    """``late`` is long after every retry, so what is due says so, and what is old is gone."""
    arrivals = [
        [("done", False, "e1", "2024-01-01 00:00:00"), ("done", True, None, "2024-01-01 00:00:01"), ("again", False, "e", "2024-01-01 00:00:10")],
        [("dead", False, f"e{i}", f"2024-01-01 00:01:0{i}") for i in range(3)],
        [("later", False, "x", "2024-01-01 01:00:00")],
        [("between", True, None, "2024-01-01 01:10:00")],
        [("again", False, "e2", "2024-01-01 01:30:00"), ("newest", True, None, "2024-01-01 06:00:00")],
        [("done", False, "back", "2024-01-01 07:00:00")],
        [("last", True, None, "2024-01-01 08:00:00")]]
    for rows in arrivals:
        write(stamped(spark, *rows), f"{place}/in")
    with S.with_rocksdb(spark):
        stream = S.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema, files_per_batch=1)
        standing = R.retry_standing(stream, horizon="2 hours", late="30 minutes")
        S.to_sink(standing, S.batch_files(f"{place}/out"), f"{place}/cp", mode="update").awaitTermination()
        held = {r.url: r.attempts for r in R.remembered(spark, f"{place}/cp").collect()}
    rows = [(r.url, r.state, r.attempts, r.error) for r in spark.read.parquet(f"{place}/out").orderBy("batch_id", "url").collect()]
    assert ("done", "done", 2, None) in rows and ("dead", "dead", 3, "e2") in rows
    assert [r for r in rows if r[0] == "again" and r[1] == "due"] == [("again", "due", 1, None), ("again", "due", 2, None)]
    assert ("later", "due", 1, None) in rows and ("dead", "due", 3, None) not in rows
    assert ("done", "retry", 1, None) in rows  # came back after its horizon and was not known
    assert held == {"newest": 1, "done": 1, "last": 1}


def test_rate_counts_late_rows_within_the_delay(spark, place):
    write(stamped(spark, *[("a", True, None, f"2024-01-01 00:{m:02d}:00") for m in (1, 2, 20)]), f"{place}/in")
    write(stamped(spark, ("late", True, None, "2024-01-01 00:03:00")), f"{place}/in")
    write(stamped(spark, ("b", True, None, "2024-01-01 02:00:00")), f"{place}/in")
    stream = S.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema, files_per_batch=1)
    S.to_files(S.request_rate(stream, "10 minutes", late="20 minutes"), f"{place}/out", f"{place}/cp").awaitTermination()
    got = {str(r.window_start)[11:16]: r.requests for r in spark.read.parquet(f"{place}/out").collect()}
    assert got == {"00:00": 3, "00:20": 1}


def test_flush_on_a_timer(spark, place):
    write(urls(spark, "a"), f"{place}/in")
    query = S.to_sink(S.read_stream(spark, f"{place}/in", urls(spark).schema), S.batch_files(f"{place}/out"),
                      f"{place}/cp", flush_seconds=1)
    try:
        query.processAllAvailable()
        write(urls(spark, "b"), f"{place}/in")
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(f"{place}/out").select("batch_id").distinct().count() == 2
