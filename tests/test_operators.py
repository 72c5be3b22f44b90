import pytest
from pyspark.sql import functions as F

from pagecatalog import schemas
from pagecatalog.functions import array_to_json, join_array, split_text
from pagecatalog.operators import catalog as C, enrich as E, frontier as R, links as L, progress as P


def urls(spark, *names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, url string")


def names(df):
    return [r.url for r in df.orderBy("pos").collect()]


def test_pagination(spark):
    groups = spark.createDataFrame([("g",), ("g",), ("gone",), ("h?x=1",)], "group_url string")
    stored = urls(spark, "g", "g?page=2", "g?page=4", "g?page=6", "g?page=02", "g?page=0", "gone?page=2",
                  "h?x=1", "h?x=1?page=3", "g?page=2", "g?page=999999999999")
    got = {(r.group_url, r.page_no, r.url) for r in L.paginated_captures(groups, stored, 5).collect()}
    assert got == {("g", 1, "g"), ("g", 2, "g?page=2"), ("g", 4, "g?page=4"), ("h?x=1", 1, "h?x=1"),
                   ("h?x=1", 3, "h?x=1?page=3")}
    assert L.paginated_captures(groups, stored, 1).count() == 2
    assert L.paginated_captures(groups, stored, 5).count() == 5


def test_frontier_merge_keeps_order_and_state_first(spark):
    merged = R.merge_frontier(urls(spark, "c", "a", "c"), urls(spark, "b", "a", "d", "b"))
    assert names(merged) == ["c", "a", "b", "d"]
    assert [r.pos for r in merged.orderBy("pos").collect()] == [0, 1, 2, 3]


def test_pending_and_attempted_are_disjoint_and_whole(spark):
    frontier, tried = urls(spark, "a", "b", "c"), urls(spark, "b", "b", "z")
    assert names(R.pending(frontier, tried)) == ["a", "c"]
    assert names(R.known(frontier, tried)) == ["b"]
    assert R.attempted_again(tried, frontier).count() == 4


def test_discovery_is_skipped_when_there_is_a_frontier(spark):
    def fail():
        raise AssertionError("discovery ran")

    assert names(R.frontier_or_discover(urls(spark, "a"), fail)) == ["a"]
    assert names(R.frontier_or_discover(urls(spark, "a").limit(0), lambda: urls(spark, "x"))) == ["x"]


@pytest.mark.parametrize("n,want", [(None, 3), (0, 3), (2, 2), (9, 3)])
def test_first_n(spark, n, want):
    assert R.first_n(urls(spark, "a", "b", "c"), n, "pos").count() == want


def test_first_n_of_many(spark):
    assert names(R.first_n(urls(spark, "a", "b", "c"), 2, "pos")) == ["a", "b"]


def test_first_n_rejects_negative_limits(spark):
    with pytest.raises(ValueError):
        R.first_n(urls(spark, "a"), -1, "pos")


@pytest.fixture(scope="module")
def family(spark):
    parents = spark.createDataFrame([("p1", "e1"), ("p2", None), ("p3", "e3")], "id string, english_name string") \
        .withColumns({"persian_name": F.lit("نام"), "url": F.concat(F.lit("http://a/"), "id")})
    rows = [("p1", i, f"c{i}") for i in range(25)] + [("p2", 7, "only"), ("orphan", 0, "lost")]
    children = spark.createDataFrame(rows, "id string, pos int, english_name string").withColumns({
        "persian_name": F.lit(""), "manufacturer": F.lit("m"), "url": F.col("english_name"),
        "image_url": F.when(F.col("pos") % 2 == 0, F.array(F.lit("x"), F.lit("y")))})
    return parents, children


FIELDS = ["persian_name", "english_name", "manufacturer", "url", "image_url"]


@pytest.mark.parametrize("limit", [None, 4, 100])
def test_nesting_keeps_every_child_in_order(family, limit):
    parents, children = family
    nested = E.nest_children(parents, children, "id", ["pos"], FIELDS, limit)
    rows = nested.orderBy("id", "part").collect()
    by_parent = {}
    for row in rows:
        by_parent.setdefault(row.id, []).extend(c.url for c in row.children)
        assert limit is None or len(row.children) <= limit
    assert by_parent == {"p1": [f"c{i}" for i in range(25)], "p2": ["only"], "p3": []}
    assert len(rows) == (9 if limit == 4 else 3)


@pytest.mark.parametrize("largest", [1_000_000, 10])
def test_nesting_large_parents_and_null_keys(spark, family, monkeypatch, largest):
    monkeypatch.setattr(E, "TASK_CHILDREN", largest)
    parents, children = family
    lost = children.limit(1).withColumn("id", F.lit(None).cast("string"))
    nested = E.nest_children(parents, children.unionByName(lost), "id", ["pos"], FIELDS, 4).orderBy("id", "part").collect()
    assert [(r.id, r.part, [c.url for c in r.children]) for r in nested] == [
        *(("p1", i, [f"c{j}" for j in range(4 * i, min(25, 4 * i + 4))]) for i in range(7)), ("p2", 0, ["only"]), ("p3", 0, [])]


def test_nesting_deals_children_out_once(family):
    """One exchange of the children and one of the parents, nothing written in between."""
    parents, children = family
    nested = E.nest_children(parents, children, "id", ["pos"], FIELDS, 4)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "FileScan" not in plan


def test_flatten_of_nested_gives_the_children_back(family):
    parents, children = family
    flat = C.flatten_children(E.nest_children(parents, children, "id", ["pos"], FIELDS, 4))
    assert flat.schema.fieldNames() == schemas.CATALOG.fieldNames()
    got = sorted((r.generic_id, r.url, r.image_url) for r in flat.collect())
    want = sorted((r.id, r.url, r.image_url) for r in children.filter("id <> 'orphan'").collect())
    assert got == want


def test_top_images(spark):
    children = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "none")], "url string, query string")
    found = spark.createDataFrame([("q", i, f"i{i}") for i in range(9, 0, -1)], "query string, rank int, image string")
    got = {r.url: r.image_url for r in E.top_images(children, found).collect()}
    assert got == {"a": ["i1", "i2", "i3", "i4", "i5"], "b": ["i1", "i2", "i3", "i4", "i5"], "c": []}


def test_fill(spark):
    rows = spark.createDataFrame([
        ("n", "hn", "", "hm", "", "hi"), ("n", None, "Unknown", None, None, None), ("n", "hn", "kept", "hm", "kept", "hi")],
        "name string, hn string, m string, hm string, i string, hi string")
    got = rows.select(*[c.alias(n) for n, c in E.filled(*[F.col(c) for c in rows.columns]).items()]).collect()
    assert [tuple(r) for r in got] == [("hn", "hm", "hi"), ("n", "Unknown", None), ("hn", "kept", "kept")]


def test_enrich_first_n_passes_the_rest_through(spark):
    df = urls(spark, *"abcd")
    change = {"url": F.upper("url")}
    assert names(E.enrich_first_n(df, ["pos"], 2, change, ["pos"])) == ["A", "B", "c", "d"]
    assert names(E.enrich_first_n(df, ["pos"], None, change, ["pos"])) == ["A", "B", "C", "D"]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "id string, v int, seq int")
    once = C.upsert(base, new, ["id"], "seq")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 6), ("c", 7)]
    assert sorted(map(tuple, C.upsert(once, new, ["id"], "seq").collect())) == [("a", 1), ("b", 6), ("c", 7)]


def test_arrays_as_text(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["x; y", None],)], "a array<string>")
    text = rows.select(join_array(F.col("a")).alias("t"), array_to_json(F.col("a")).alias("j"),
                       array_to_json(F.col("a"), False).alias("e"))
    got = text.select("t", "j", "e", split_text(F.col("t")).alias("back")).collect()
    # a value that holds the separator comes back as two, a NULL item not at all
    assert [tuple(r) for r in got] == [
        ("a; b", '["a","b"]', '["a","b"]', ["a", "b"]), ("", None, "[]", []), ("", None, "[]", []),
        ("x; y", '["x; y",null]', '["x; y",null]', ["x", "y"])]


@pytest.mark.parametrize("start,sizes", [(0, [3, 3, 1]), (5, [2]), (7, []), (99, [])])
def test_batches_partition_the_list(spark, start, sizes):
    batches = P.assign_batches(urls(spark, *"abcdefg"), ["pos"], 3, start)
    assert [r["count"] for r in batches.groupBy("batch_no").count().orderBy("batch_no").collect()] == sizes


@pytest.mark.parametrize("size,start", [(0, 0), (5, -1)])
def test_batches_refuse_bad_numbers(spark, size, start):
    with pytest.raises(ValueError):
        P.assign_batches(urls(spark, "a"), ["pos"], size, start)


LOG = "url string, attempt int, status int, ok boolean, elapsed double, error string, ts timestamp, batch_no long"


def log(spark, rows):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(u, n, s, s == 200, e, x, start + timedelta(seconds=t), b) for u, n, s, e, x, t, b in rows], LOG)


def test_metrics_of_an_empty_log(spark):
    stats = P.request_stats(log(spark, [])).first()
    assert tuple(stats) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    summary = P.run_summary(log(spark, [])).first()
    assert summary.attempts == 0 and summary.success_pct_of_attempts == 0 and summary.mean_batch_seconds == 0
    assert P.discovery_summary(spark.createDataFrame([], "link string"), log(spark, [])).first().seconds_per_url is None


def test_retries_and_dead_letters(spark):
    runs = log(spark, [("a", 1, 500, 1.0, "e1", 0, 0), ("a", 2, 200, 1.0, None, 1, 0), ("b", 1, 500, 1.0, "e1", 0, 0),
                       ("b", 2, None, 1.0, "timeout", 5, 0), ("b", 3, 503, 1.0, "e3", 9, 1), ("c", 1, None, 2.0, "odd", 2, 1)])
    assert [tuple(r) for r in P.dead_letters(runs).collect()] == [("b", "e3", 3)]
    assert [tuple(r) for r in P.retry_candidates(runs).collect()] == [("c", 1)]
    summary = P.run_summary(runs).first()
    assert (summary.attempts, summary.successful, summary.failed, summary.retried, summary.urls) == (6, 1, 1, 4, 3)
    waits = {(r.url, r.attempt): r.wait_seconds for r in P.backoff_schedule(runs).collect()}
    assert waits == {("a", 1): 0.5, ("b", 1): 0.5, ("b", 2): 1.0, ("c", 1): 0.5}
    classes = {r.response_class: (r.responses, r.delay_seconds) for r in P.response_classes(runs).collect()}
    assert classes == {"ok": (1, 0.0), "http_error": (2, 0.0), "timeout": (1, 1.0), "retry_later": (1, 1.5), "unexpected": (1, 0.5)}


def test_second_source_retries_403(spark):
    kinds = spark.createDataFrame([(403,), (429,)], "s int").select(
        P.response_class(F.col("s"), F.lit(None)).alias("a"), P.response_class(F.col("s"), F.lit(None), True).alias("b"))
    assert [tuple(r) for r in kinds.collect()] == [("http_error", "retry_later"), ("retry_later", "ok")]


def test_rate_violations(spark):
    runs = log(spark, [("a", 1, 200, 0.1, None, 3 + i / 100, 0) for i in range(11)] + [("a", 1, 200, 0.1, None, 5, 0)])
    assert [r.requests for r in P.rate_violations(runs).collect()] == [11]


def test_resume_index_without_progress(spark):
    assert P.resume_index(spark.createDataFrame([], schemas.PROGRESS)).first().current_index == 0
