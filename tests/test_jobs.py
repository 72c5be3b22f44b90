"""Whole jobs on a small invented site."""

import pytest
from pyspark.sql import functions as F

from pagecatalog import schemas
from pagecatalog.operators import enrich as E
from pagecatalog.plans import jobs
from pagecatalog.session import fresh_path, session_conf
from pagecatalog.sources import readers, state, writers

BASE = "http://site.example"


def listing(*paths):
    return "".join(f'<div class="col-md-6"><a class="ahref_Generic" href="{p}">x</a></div>' for p in paths)


def record(title, *children, extra=""):
    links = "".join(f'<a class="ahref_Generic" href="{c}">c</a>' for c in children)
    return f"<h1> {title}\n</h1>{extra}<div class='text-xs-center'>{links}</div>"


PAGES = {
    # groups: only the fourth selector form matches; one is listed twice, one has no capture
    "/start": "<a href='/drugs/groups/1'>1</a><a name=x>no</a><a href='/drugs/groups/2'>2</a>"
              "<a href='/drugs/groups/1'>again</a><a href='/drugs/groups/3'>3</a>",
    "/drugs/groups/1": listing("/G-1/X", "/G-1/Y", "/G-1/X"),
    "/drugs/groups/1?page=3": listing("/G-1/Z/"),  # page 2 is missing
    "/drugs/groups/1?page=6": listing("/G-1/toofar"),
    "/drugs/groups/2": listing("/G-2/X", "/G-1/Y", "/G-2/plain", "/G-2/gone"),
    "/G-1/X": record("نمونه", "/B-1/a", "B-1/b", "/B-1/a", "/B-1/missing", extra="<p class=EnglishTopLabel>Sample</p>"
                     "<b class=producer></b><b class=company> Co &amp; Sons </b><i class=image><img src=''></i>"
                     "<ul class=formula><li>one<li> two</ul><script>var x='<h1>no</h1>'</script>"),
    "/G-1/Y": record("no children <b>unclosed", extra="<div class=ingredients>plain</div>"),
    "/G-1/Z/": record("slash", "/B-1/b", extra="<i class=image><img></i><p class=gallery><img src='/g.png'>"),
    "/G-2/X": record("same segment", "http://site.example/B-1/a", "#top"),
    "/G-2/plain": "<p>nothing here",
    "/B-1/a": "<h1 id=h1PersianName>آ</h1><h2 id=h2EnglishName>A</h2><a class=ahref_GenericWhiteColor>M</a>",
    "/B-1/b": "<h2 id=h2EnglishName>B",
}
LINKS = ["/G-1/X", "/G-1/Y", "/G-1/Z/", "/G-2/X", "/G-2/plain", "/G-2/gone"]
SITE = jobs.Site(BASE)


@pytest.fixture(scope="module")
def sources(spark):
    captures = spark.createDataFrame([(BASE + p, h) for p, h in PAGES.items()], "url string, html string")
    images = spark.createDataFrame([("A M", i, f"i{i}") for i in range(1, 8)], schemas.IMAGE_CANDIDATE)
    answers = spark.createDataFrame([(BASE + "/g.png", 200, "image/png")], "url string, status int, content_type string")
    return jobs.Sources(captures.cache(), images, answers)


@pytest.fixture
def root(spark):
    return fresh_path(spark, "jobs-test")


def start(spark):
    return spark.createDataFrame([(BASE + "/start",)], "url string")


def paths(links):
    return [r.url.removeprefix(BASE) for r in links.orderBy("pos").collect()]


def test_discover(spark, sources, root):
    assert paths(jobs.discover(spark, start(spark), sources, SITE, root)) == LINKS
    assert paths(readers.read_links(spark, f"{root}/groups")) == [f"/drugs/groups/{n}" for n in (1, 2, 3)]
    assert paths(jobs.discover(spark, start(spark), sources, SITE, root, max_groups=1)) == LINKS[:3]
    assert paths(jobs.discover(spark, start(spark), sources, SITE, root, max_groups=1, max_pages=1)) == LINKS[:2]


def test_discover_without_a_start_page(spark, sources, root):
    nowhere = spark.createDataFrame([(BASE + "/absent",)], "url string")
    assert jobs.discover(spark, nowhere, sources, SITE, root).count() == 0


CATALOG = sorted([
    ("X", "/G-1/X", "آ", "A", "M", "/B-1/a", 5), ("X", "/G-1/X", "", "B", "", "/B-1/b", 0),
    ("", "/G-1/Z/", "", "B", "", "/B-1/b", 0), ("X", "/G-2/X", "آ", "A", "M", "/B-1/a", 5)])


def catalog(df):
    return sorted((r.generic_id, r.generic_url.removeprefix(BASE), r.persian_name, r.english_name, r.manufacturer,
                   r.url.removeprefix(BASE), len(r.image_url)) for r in df.collect())


def test_process(spark, sources, root):
    jobs.discover(spark, start(spark), sources, SITE, root)
    saved = jobs.process(spark, sources, SITE, root, batch_size=4)
    assert catalog(saved) == CATALOG
    assert catalog(readers.read_catalog_json(spark, f"{root}/export")) == CATALOG
    assert [tuple(r) for r in readers.read_errors(spark, f"{root}/errors").collect()] == [
        (BASE + "/G-2/gone", "Extraction returned None")]
    progress = readers.read_progress(spark, f"{root}/progress").orderBy("batch_no").collect()
    assert [(r.current_index, r.total_links, r.stats.total_processed, r.stats.successful, r.stats.failed) for r in progress] \
        == [(4, 6, 4, 4, 0), (6, 6, 6, 5, 1)]
    # a second run replaces its own rows instead of doubling them
    assert catalog(jobs.process(spark, sources, SITE, root, batch_size=4)) == CATALOG


def exchanged_html(df):
    """The exchanges of a plan that move HTML."""
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [node for node in plan.split("\n\n") if "Exchange" in node.split("\n")[0] and "html#" in node]


@pytest.mark.parametrize("dated", [False, True])
def test_long_lists_come_to_bucketed_captures(spark, root, dated):
    pages = spark.range(500).selectExpr("concat('u', id) url", "concat('<h1>', id, '</h1>') html", "timestamp '2024-01-01' fetched_at")
    if dated:
        pages = pages.union(pages.filter("url like '%7'").selectExpr("url", "'<h1>new</h1>' html", "timestamp '2024-01-02' fetched_at"))
    else:
        pages = pages.drop("fetched_at")
    name = "captures_" + root.rsplit("-", 1)[-1]
    writers.write_capture_table(pages, name, 8, f"{root}/captures")
    urls = spark.range(0, 500, 2).selectExpr("concat('u', id) url", "id pos").union(spark.range(7, 8).selectExpr("'u7' url", "7 pos"))
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__enabled=False):
        got = jobs._captured(urls, spark.table(name))
        again = got.join(urls, "url")  # as links are joined to the pages that hold them
        assert exchanged_html(got) == [] == exchanged_html(again) and got.count() == again.count() == 251
        assert got.filter("html = '<h1>new</h1>'").count() == (1 if dated else 0)
        plain = jobs._captured(urls, spark.read.parquet(f"{root}/captures"))
        assert len(exchanged_html(plain)) == 1
    spark.sql(f"DROP TABLE {name}")


def test_resume_adds_to_the_kept_catalogue(spark, sources, root):
    jobs.discover(spark, start(spark), sources, SITE, root)
    jobs.catalog_table(spark, root).save(spark.createDataFrame([("k", "e", "p", BASE + "/kept", "", "", "", "u", [])], schemas.CATALOG))
    spark.createDataFrame([(0, 2)], "batch_no long, current_index long").write.parquet(f"{root}/progress")
    got = catalog(jobs.resume(spark, sources, SITE, root, batch_size=2, fmt="CSV"))
    assert got == sorted([("k", "/kept", "", "", "", "u", 0), *[r for r in CATALOG if r[1] != "/G-1/X"]])
    last = readers.read_progress(spark, f"{root}/progress").agg(F.max("current_index")).first()[0]
    assert last == 6
    assert readers.read_catalog_csv(spark, f"{root}/export").count() == 3
    # everything is done: resuming again changes nothing
    assert catalog(jobs.resume(spark, sources, SITE, root, batch_size=2)) == got


def test_resume_without_progress_starts_at_the_beginning(spark, sources, root):
    jobs.discover(spark, start(spark), sources, SITE, root)
    assert catalog(jobs.resume(spark, sources, SITE, root)) == CATALOG


def test_full_run(spark, sources, root):
    records = {r.url.removeprefix(BASE): r for r in jobs.full(spark, start(spark), sources, SITE, root).collect()}
    assert sorted(records) == sorted(LINKS[:-1])
    sample = records["/G-1/X"]
    assert (sample.id, sample.english_name, sample.persian_name, sample.manufacturer) == (
        "X", "Sample", "نمونه", "Co & Sons")
    assert sample.combinations == ["one", "two"]
    assert [c.url.removeprefix(BASE) for c in sample.children] == ["/B-1/a", "/B-1/b"]
    assert sample.children[0].image_url == ["i1", "i2", "i3", "i4", "i5"] and sample.children[1].image_url == []
    assert sample.image_path is None and records["/G-1/Z/"].image_path == "catalog/images/.png"
    assert records["/G-1/Y"].children == [] and records["/G-1/Y"].combinations == ["plain"]
    plain = records["/G-2/plain"]
    assert (plain.english_name, plain.persian_name, plain.manufacturer, plain.combinations) == (None, None, "", [])
    frontier, attempted = state.read_state(spark, root)
    assert paths(frontier) == LINKS
    assert attempted.count() == len(LINKS)  # the missing page was tried too
    # nothing is left, so the next run returns nothing and keeps the catalogue
    assert jobs.full(spark, start(spark), sources, SITE, root).count() == 0
    assert catalog(jobs.catalog_table(spark, root).read()) == CATALOG


def test_full_run_from_a_list_does_not_discover(spark, sources, root):
    listed = spark.createDataFrame([(0, BASE + "/G-2/X"), (1, BASE + "/G-2/gone")], schemas.LINK)
    done = jobs.full(spark, start(spark), sources, SITE, root, listed=listed, max_records=1)
    assert [r.url for r in done.collect()] == [BASE + "/G-2/X"]
    assert paths(state.read_state(spark, root)[0]) == ["/G-2/X", "/G-2/gone"]


def test_caps_of_a_full_run(spark, sources, root):
    done = jobs.full(spark, start(spark), sources, SITE, root, max_groups=1, max_pages=1, max_records=1)
    assert [r.url.removeprefix(BASE) for r in done.collect()] == ["/G-1/X"]


FIRST, SECOND = "http://first.example", "http://second.example"


def item(name, maker=None, image=None):
    label = f"<dt>Manufacturer<dd>{maker}" if maker else ""
    picture = f"<div class=ddc-media><img src='{image}'></div>" if image else ""
    return f"<h1>{name}</h1>{picture}<div class=ddc-media-body>About {name}<dl>{label}</dl></div>"


def items(*names):
    return "<ul class=ddc-list-column-2>" + "".join(f"<li><a href='/{n}'>{n}</a>" for n in names) + "</ul>"


ENRICH = {
    f"{FIRST}/az": "<ul class=az-list>" + "".join(f"<li><a href='/letter/{c}'>{c}</a>" for c in "abc") + "</ul>",
    f"{FIRST}/letter/a": items("alpha", "another", "absent", "extra"),
    f"{FIRST}/letter/b": items("beta", "untitled"),
    f"{FIRST}/alpha": item("Alpha"), f"{FIRST}/another": item("Another", "Maker", "/pic.png"),
    f"{FIRST}/extra": item("Extra"), f"{FIRST}/beta": item("Beta"), f"{FIRST}/untitled": "<p>no title",
    f"{SECOND}/search?s=Alpha": "<div class=product-item><h2><a href='/p/1'> آلفا </a></h2></div>"
                                "<div class=product-item><h2><a href='/p/2'>second hit</a></h2></div>",
    f"{SECOND}/search?s=Another": "<div class=product-item><h2><a href='/p/9'>دیگر</a></h2></div>",
    f"{SECOND}/search?s=Beta": "<p>no hits",
    f"{SECOND}/p/1": "<span class=manufacturer>Found</span><div class=product-image><img src='i.png'></div>",
}


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame(list(ENRICH.items()), "url string, html string").cache()


def test_enrich(spark, shop, root):
    first = spark.createDataFrame([(f"{FIRST}/az",)], "url string")
    got = jobs.enrich(spark, first, jobs.Sources(shop), FIRST, SECOND, root, per_letter=3)
    rows = {r.english_name: r for r in got.collect()}
    assert {n: r.id for n, r in rows.items()} == {"Alpha": 1, "Another": 2, "Beta": 3}
    assert (rows["Alpha"].persian_name, rows["Alpha"].manufacturer, rows["Alpha"].image_url) == (
        "آلفا", "Found", f"{SECOND}/i.png")
    assert (rows["Another"].persian_name, rows["Another"].manufacturer, rows["Another"].image_url) == (
        "دیگر", "Maker", f"{FIRST}/pic.png")
    assert (rows["Beta"].persian_name, rows["Beta"].manufacturer, rows["Beta"].image_url) == ("", "Unknown", "")
    assert rows["Another"].description == "About AnotherManufacturerMaker" and rows["Beta"].combinations == []
    assert spark.read.json(f"{root}/export/json").count() == 3
    assert spark.read.option("header", True).csv(f"{root}/export/csv").count() == 3


def test_enrich_limits(spark, shop, root):
    first = spark.createDataFrame([(f"{FIRST}/az",)], "url string")
    got = jobs.enrich(spark, first, jobs.Sources(shop), FIRST, SECOND, root, per_letter=2, max_letters=1, enrich_first=1)
    assert {r.english_name: r.persian_name for r in got.collect()} == {"Alpha": "آلفا", "Another": ""}


def test_enrich_nothing(spark, shop, root):
    nowhere = spark.createDataFrame([("http://nowhere.example",)], "url string")
    assert jobs.enrich(spark, nowhere, jobs.Sources(shop), FIRST, SECOND, root).count() == 0
    with pytest.raises(Exception):
        spark.read.text(f"{root}/export/csv")


def test_enrich_reads_the_newest_of_repeated_captures(spark, shop, root):
    first = spark.createDataFrame([(f"{FIRST}/az",)], "url string")
    at = lambda t: F.lit(t).cast("timestamp").alias("fetched_at")
    newest = shop.select("url", "html", at("2024-01-03"))
    old = shop.select("url", F.concat(F.lit("<ul><li><a href='/drug/old'>o</a></li></ul>"), "html").alias("html"), at("2024-01-01"))
    once = jobs.enrich(spark, first, jobs.Sources(newest), FIRST, SECOND, f"{root}/once", per_letter=3)
    again = jobs.Sources(newest.unionByName(old).unionByName(newest), as_of="2024-01-03 06:00:00")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(jobs.enrich(spark, first, again, FIRST, SECOND, f"{root}/again", per_letter=3)) == rows(once)
    stale = jobs.Sources(newest, as_of="2024-02-01 00:00:00")
    assert jobs.enrich(spark, first, stale, FIRST, SECOND, f"{root}/stale").count() == 0


def test_captures_of_a_long_list_are_neither_sorted_nor_spilled(spark, root):
    """The list is hashed, bucket by bucket, and the HTML passes through."""
    name = "captures_" + root.rsplit("-", 1)[-1]
    writers.write_capture_table(spark.range(500).selectExpr("concat('u', id) url", "concat('<h1>', id, '</h1>') html"), name, 8, f"{root}/captures")
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1), \
            jobs._streamed(spark):
        got = jobs._captured(spark.range(0, 600, 2).selectExpr("concat('u', id) url"), spark.table(name))
        assert got.count() == len(got.collect()) == 250
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_buckets_grow_with_the_captures():
    assert writers.capture_buckets(0) == writers.capture_buckets(1_000_000) == writers.LEAST_BUCKETS
    for pages in (9_000_000, 54_000_000):
        assert pages / writers.capture_buckets(pages) <= writers.PAGES_PER_BUCKET


def test_children_of_bounded_parents_are_shuffled_once(spark):
    parents = spark.range(3).selectExpr("id k")
    children = spark.range(9).selectExpr("id % 2 k", "id n")
    with session_conf(spark, spark__sql__adaptive__enabled=False):
        nested = E.nest_children(parents, children, "k", ["n"], ["n"], None)
        plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the children and the parents
    assert sorted((r.k, r.part, [c.n for c in r.children]) for r in nested.collect()) == [
        (0, 0, [0, 2, 4, 6, 8]), (1, 0, [1, 3, 5, 7]), (2, 0, [])]


def test_records_are_dealt_out_only_if_urls_repeat(spark, monkeypatch):
    dealt = []
    frame = type(spark.range(0))
    drop = frame.dropDuplicates
    monkeypatch.setattr(frame, "dropDuplicates", lambda self, *a: dealt.append(a) or drop(self, *a))
    rows = [(f"u{i}", "x" * i) for i in range(50)]
    once = jobs._written_once(spark.createDataFrame(rows, "url string, html string"), "once-test")
    assert sorted(map(tuple, once.collect())) == sorted(rows) and not dealt
    twice = jobs._written_once(spark.createDataFrame(rows + rows[:9], "url string, html string"), "once-test")
    assert sorted(map(tuple, twice.collect())) == sorted(rows) and len(dealt) == 1


def test_accounts_take_a_link_without_error_for_done(spark):
    batches = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("c", 1), (None, 1)], "url string, batch_no long")
    records = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    log = spark.createDataFrame([("a", 1, 0.5, 10), ("a", 2, 0.25, 9), ("z", 1, 9.0, 1), (None, 1, 9.0, 1)],
                                "url string, attempt int, elapsed double, t int").selectExpr("url", "attempt", "elapsed", "cast(t as timestamp) ts")
    errors = jobs.X.without_record(batches, records)
    assert sorted(str(r.url) for r in errors.collect()) == ["None", "c"]
    found = jobs._accounted(batches, errors, jobs.Sources(records, fetch_log=log)).collect()
    assert sorted((str(r.url), r.batch_no, r.ok, r.retries, r.elapsed) for r in found) == [
        ("None", 1, False, 0, None), ("a", 0, True, 1, 0.75), ("b", 0, True, 0, None), ("b", 1, True, 0, None), ("c", 1, False, 0, None)]
