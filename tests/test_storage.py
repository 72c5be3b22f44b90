import json
import uuid

import pytest
from pyspark.sql import functions as F

from pagecatalog import schemas
from pagecatalog.operators import frontier as R
from pagecatalog.session import fresh_path, list_names, session_conf, shared_dir
from pagecatalog.sources import readers, state, writers

ROWS = [
    ("1", "Sample", "نمونه", "http://a/1", 'quote " and, comma', "line\nbreak", " spaced ", "http://a/b", ["u1", "u2"]),
    ("2", None, "", "http://a/2", "", None, "back\\slash", "http://a/c", []),
    ("3", "x", "y", "http://a/3", "'", "#hash", "tab\there", "http://a/d", None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(ROWS, schemas.CATALOG)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_text_formats_are_written_compressed(spark, fmt):
    """Far fewer bytes than the text they hold, which any reader of the files gets back."""
    many = spark.range(2000).select(*[F.concat(F.lit("http://a/same/address/"), "id").alias(c) for c in schemas.CATALOG.fieldNames()[:-1]],
                                    F.array(F.lit("u1")).alias("image_url"))
    path = fresh_path(spark, "t")
    writers.write_catalog(many, fmt, path)
    text = spark.read.text(path).agg(F.sum(F.length("value") + 1)).first()[0]
    kept = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    assert kept < text / 5
    assert rows(writers.load_catalog(spark, fmt, path)) == rows(many)


def test_json_round_trip_is_exact(spark, catalog):
    path = fresh_path(spark, "t")
    writers.write_catalog_json(catalog, path)
    assert rows(readers.read_catalog_json(spark, path)) == rows(catalog)
    lines = "".join(r.value for r in spark.read.text(path).collect())
    assert "نمونه" in lines and '"generic_english_name":null' in lines


def test_json_array_file(spark, tmp_path):
    file = tmp_path / "catalog.json"
    names = schemas.CATALOG.fieldNames()
    file.write_text(json.dumps([dict(zip(names, r)) for r in ROWS], ensure_ascii=False, indent=2), encoding="utf-8")
    assert rows(readers.read_catalog_json(spark, str(file), array_file=True)) == sorted(ROWS)


def test_csv_round_trip_loses_only_nulls(spark, catalog):
    path = fresh_path(spark, "t")
    writers.write_catalog_csv(catalog, path)
    want = sorted(tuple([] if v is None and i == 8 else "" if v is None else v for i, v in enumerate(r)) for r in ROWS)
    assert rows(readers.read_catalog_csv(spark, path)) == want
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "u1; u2" in text and text.startswith("generic_id,") and '""' not in text.replace('"" and', "")


def test_csv_splits_values_that_hold_the_separator(spark, catalog):
    path = fresh_path(spark, "t")
    writers.write_catalog_csv(catalog.limit(1).withColumn("image_url", F.array(F.lit("a; b"))), path)
    assert readers.read_catalog_csv(spark, path).first().image_url == ["a", "b"]


def test_table_round_trip(spark, catalog):
    name = f"t_{uuid.uuid4().hex}"
    writers.write_catalog_table(catalog, name, fresh_path(spark, "t"))
    stored = {r.generic_id: r.image_url for r in spark.table(name).collect()}
    assert stored == {"1": '["u1","u2"]', "2": None, "3": None}
    assert {r.generic_id: r.image_url for r in readers.read_catalog_table(spark, name).collect()} == {
        "1": ["u1", "u2"], "2": [], "3": []}


def test_what_is_missing_reads_as_empty(spark):
    nowhere = fresh_path(spark, "nowhere")
    for df in (readers.read_captures(spark, nowhere), readers.read_url_array(spark, nowhere), readers.read_links(spark, nowhere),
               readers.read_catalog_json(spark, nowhere), readers.read_catalog_csv(spark, nowhere),
               readers.read_catalog_table(spark, "no_such_table"), readers.read_progress(spark, nowhere),
               readers.read_errors(spark, nowhere), *state.read_state(spark, nowhere)):
        assert df.count() == 0


def test_url_array_file_keeps_positions(spark, tmp_path):
    file = tmp_path / "urls.json"
    file.write_text(json.dumps(["http://a/ü", "b", "b"], ensure_ascii=False, indent=2), encoding="utf-8")
    got = readers.read_url_array(spark, str(file))
    assert got.schema == schemas.LINK or got.dtypes == [("pos", "bigint"), ("url", "string")]
    assert rows(got) == [(0, "http://a/ü"), (1, "b"), (2, "b")]


def test_capture_files(spark, tmp_path):
    (tmp_path / "one.html").write_text("<p>é", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("x")
    got = readers.read_capture_files(spark, str(tmp_path), "http://a/").collect()
    assert [(r.url, r.html) for r in got] == [("http://a/one", "<p>é")] and got[0].fetched_at is not None


def test_freshness_is_strict(spark):
    captures = spark.createDataFrame([("old", "2024-01-01 00:00:00"), ("new", "2024-01-01 00:00:01")], "url string, t string") \
        .select("url", F.col("t").cast("timestamp").alias("fetched_at"))
    assert [r.url for r in readers.fresh(captures, "2024-01-02 00:00:00").collect()] == ["new"]
    assert readers.fresh(captures, "2024-01-02 00:00:00", hours=48).count() == 2


def test_a_table_may_be_replaced_from_itself(spark, catalog):
    root = fresh_path(spark, "t")
    assert readers.current_version(spark, root, schemas.CATALOG).count() == 0
    writers.replace_all(catalog, root)
    before = readers.current_version(spark, root, schemas.CATALOG)
    writers.replace_all(before.filter("generic_id <> '2'"), root)
    assert rows(readers.current_version(spark, root, schemas.CATALOG)) == [r for r in sorted(ROWS) if r[0] != "2"]
    assert before.count() == 3  # readers of the old version are not disturbed


def test_state(spark):
    root = fresh_path(spark, "t")
    urls = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, url string")
    state.write_state(urls, urls.filter("url = 'a'"), root)
    state.write_state(urls, urls, root)
    frontier, attempted = state.read_state(spark, root)
    assert rows(frontier) == [(0, "a"), (1, "b")] and rows(attempted) == [("a",), ("b",)]


def test_new_links_go_on_after_the_state(spark):
    schema = "pos long, url string"
    held = spark.createDataFrame([(i, f"u{i}") for i in range(500)], schema)
    listed = spark.createDataFrame([(3, "new b"), (1, "new a"), (0, "u7"), (2, "new a"), (9, None)], schema)
    added = R.new_links(held, listed)
    assert sorted(map(tuple, added.collect())) == [(500, "new a"), (501, "new b"), (502, None)]
    merged = R.merge_frontier(held, listed).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, held.union(added).collect()))
    assert sorted(map(tuple, R.new_links(held.filter("false"), listed).collect()))[0] == (0, "u7")


def test_attempted_urls_are_not_shuffled(spark):
    root = fresh_path(spark, "t")
    links = spark.range(400).selectExpr("id pos", "concat('u', id) url")
    for low in (0, 100):  # two runs
        state.write_state(links.filter("false"), links.filter(f"pos >= {low} and pos < {low + 150}").select("url"), root, buckets=8)
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__enabled=False):
        todo = R.pending(links, state.read_state(spark, root)[1])
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "LeftAnti" in plan  # the links alone
        assert sorted(r.pos for r in todo.collect()) == list(range(250, 400))


def test_errors_are_written_only_if_there_are_any(spark):
    path = fresh_path(spark, "t")
    errors = spark.createDataFrame([("a", "e")], schemas.ERROR)
    assert writers.write_errors(errors.limit(0), path) is False
    assert writers.write_errors(errors, path) and writers.write_errors(errors, path)
    assert readers.read_errors(spark, path).count() == 2


def test_sink_by_name(spark, catalog):
    assert writers.write_catalog(catalog, "CSV", fresh_path(spark, "t")) == "csv"
    assert writers.write_catalog(catalog, "nonsense", fresh_path(spark, "t")) == "json"

    def broken(df, path, mode):
        raise ImportError("no engine")

    writers.register_sink("Broken", broken)
    path = fresh_path(spark, "t")
    assert writers.write_catalog(catalog, "broken", path) == "json"
    assert readers.read_catalog_json(spark, path).count() == 3


def test_fan_out_of_nothing_writes_nothing(spark, catalog):
    root = fresh_path(spark, "t")
    assert writers.fan_out(catalog.limit(0), root) is False
    assert readers.read_catalog_json(spark, f"{root}/json").count() == 0
    assert writers.fan_out(catalog, root) is True
    assert readers.read_catalog_csv(spark, f"{root}/csv").count() == 3


def test_ensure_table(spark):
    name = f"t_{uuid.uuid4().hex}"
    assert writers.ensure_table(spark, name, schemas.CATALOG_TEXT, fresh_path(spark, "t")) is True
    assert writers.ensure_table(spark, name, schemas.CATALOG_TEXT) is False


def test_captures_are_kept_by_date(spark):
    path = fresh_path(spark, "t")
    pages = spark.createDataFrame([("http://a/G-1/X", "<p>1"), ("http://a/G-2/X", "<p>2")], "url string, html string") \
        .withColumn("fetched_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    writers.write_captures(pages, path)
    got = spark.read.parquet(path)
    assert got.select("key").distinct().count() == 2  # same last segment, other key
    plan = got.filter("fetch_date = '2024-05-06'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fetch_date" in plan


def test_bucketed_captures_join_without_moving_the_html(spark):
    name = f"t_{uuid.uuid4().hex}"
    pages = spark.range(500).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("<p>x").alias("html"),
                                    F.current_timestamp().alias("fetched_at"))
    writers.write_capture_table(pages, name, 4, fresh_path(spark, "t"))
    urls = spark.range(100).select(F.concat(F.lit("u"), "id").alias("url")).hint("merge")
    found = spark.table(name).select("url", "html").join(urls, "url", "left_semi")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange" not in plan[plan.index("FileScan") - 300:plan.index("FileScan")]
    assert found.count() == 100


def test_image_paths(spark):
    rows_in = spark.createDataFrame([("1", "u", 200, "image/png"), ("2", "u", 200, None), ("3", "", 200, "image/png"),
                                     ("4", None, 200, "x"), ("5", "u", 404, "x"), ("6", "u", None, "x")],
                                    "id string, u string, s int, c string")
    got = rows_in.select(writers.image_path("d", *[F.col(c) for c in rows_in.columns])).collect()
    assert [r[0] for r in got] == ["d/images/1.png", "d/images/2.jpg", None, None, None, None]


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_dispatched_formats_do_not_lie_on_disk_together(spark, tmp_path):
    """Each is written, read back and deleted; the rows of the result are kept apart."""
    from pagecatalog.plans.sink_queries import sink_dispatch
    spark.sql("SELECT id AS o_orderkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM range(3)") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("""SELECT id % 3 AS l_orderkey, id AS l_linenumber, id AS l_partkey, id AS l_suppkey, 1.0D AS l_quantity,
        1.0D AS l_extendedprice, DATE'2024-01-01' AS l_shipdate, 0.0D AS l_discount, 0.0D AS l_tax, 'R' AS l_returnflag,
        'F' AS l_linestatus FROM range(10)""").write.parquet(str(tmp_path / "lineitem.parquet"))
    kept = f"{shared_dir(spark)}/pagecatalog"
    before = set(list_names(spark, kept))
    found = sink_dispatch(spark, str(tmp_path))
    left = {n.split("-")[0] for n in set(list_names(spark, kept)) - before}
    assert not left & {"dispatch", "dispatched"}
    assert [(r.asked, r.written, r.rows) for r in found.orderBy("asked").collect()] == [
        ("Csv", "csv", 10), ("JSON", "json", 10), ("parquet", "parquet", 10), ("xml?", "json", 10)]
