"""Captures, links, frontier: queries over pages, customer, orders, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagecatalog.functions import host_of, query_url, record_id, resolve_url, site_root
from pagecatalog.operators import extract as X, frontier as R, links as L, progress as P
from pagecatalog.operators.elements import elements
from pagecatalog.plans.registry import query, table
from pagecatalog.session import materialize
from pagecatalog.sources import readers, writers

ROOT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
# every link of every page, its position from 0, and where it leads
LINKS = f"""
hrefs AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages),
links AS (SELECT page_id, url, {ROOT} || unnest(found) AS link,
                 generate_subscripts(found, 1) - 1 AS pos FROM hrefs)
"""


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved links of all pages by the fixed-pattern path."""
    found = L.pattern_hrefs(table(spark, folder, "pages"), ("page_id", "url"))
    return found.select("page_id", "url", "pos", resolve_url(site_root(F.col("url")), F.col("href")).alias("link"))


@query("SELECT page_id, url, length(html) AS html_chars, md5(html) AS html_md5 FROM pages")
def scan_pages(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", "url", F.length("html").alias("html_chars"), F.md5("html").alias("html_md5"))


@query("""
SELECT user_id, epoch_us(max(ts)) AS fetched_us FROM events GROUP BY user_id
HAVING max(ts) > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS""")
def fresh_captures(spark, folder):
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("fetched_at"))
    fresh = readers.fresh(last, "2024-01-31 00:00:00")
    return fresh.select("user_id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"))


@query("SELECT page_id, url, md5(url) AS key FROM pages", name="capture_key")
def capture_key_(spark, folder):
    return writers.with_capture_key(table(spark, folder, "pages").select("page_id", "url"))


@query("SELECT page_id, url, split_part(url, '/', -1) AS record_id FROM pages")
def record_ids(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url", record_id(F.col("url")).alias("record_id"))


@query(f"""
WITH {LINKS}, firsts AS (SELECT page_id, link, min(pos) AS first_pos FROM links GROUP BY ALL)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS pos FROM firsts""")
def group_links(spark, folder):
    docs = elements(table(spark, folder, "pages"), ("page_id", "url"))
    return L.group_links(docs, site_root(F.col("url")), (".card a", ".panel a", "nav a"), ("page_id",))


@query(f"WITH {LINKS} SELECT page_id, pos, link FROM links")
def page_links(spark, folder):
    docs = elements(table(spark, folder, "pages"), ("page_id", "url"))
    return L.page_links(docs, site_root(F.col("url")), ("nav ul li a",), ("page_id",))


@query(f"WITH {LINKS} SELECT page_id, pos, link FROM links")
def resolved_links(spark, folder):
    return links(spark, folder).select("page_id", "pos", "link")


@query(f"""
WITH {LINKS}, firsts AS (SELECT page_id, link, min(pos) AS first_pos FROM links GROUP BY ALL)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS pos FROM firsts""")
def child_links_distinct(spark, folder):
    docs = elements(table(spark, folder, "pages"), ("page_id", "url"))
    return L.child_links(docs, site_root(F.col("url")), ("ul a",), ("page_id",))


# A site whose listing pages are derived from the pages: each page's address without
# query and fragment is a group; its later pages exist for every second link it holds,
# and its first only if the stored page is whole.
PAGED = """
site AS (SELECT regexp_extract(url, '^[^?#]*', 0) AS group_url,
                max(len(regexp_extract_all(html, '<a href="([^"]*)"', 1))) // 2 AS n,
                bool_or(contains(html, '</body>')) AS whole FROM pages GROUP BY 1),
"""


@query(f"""
WITH {PAGED} numbered AS (SELECT group_url, unnest(generate_series(1, n)) AS page_no FROM site WHERE whole)
SELECT group_url, page_no::INTEGER AS page_no,
       CASE WHEN page_no = 1 THEN group_url ELSE group_url || '?page=' || page_no END AS url
FROM numbered WHERE page_no <= 2
UNION ALL SELECT group_url, 1, group_url FROM site WHERE whole AND n = 0""")
def paginated_urls(spark, folder):
    pages = table(spark, folder, "pages")
    site = pages.select(
        F.regexp_extract("url", r"^[^?#]*", 0).alias("group_url"),
        F.floor(F.size(F.regexp_extract_all("html", F.lit(L.HREF_PATTERN), 1)) / 2).alias("n"),
        F.contains("html", F.lit("</body>")).alias("whole"),
    ).groupBy("group_url").agg(F.max("n").alias("n"), F.max("whole").alias("whole"))
    numbers = F.filter(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda k: (k > 1) | F.col("whole"))
    stored = site.select("group_url", F.explode(numbers).alias("k")).select(
        F.when(F.col("k") == 1, F.col("group_url"))
        .otherwise(F.concat("group_url", F.lit("?page="), "k")).alias("url"))
    return L.paginated_captures(site, materialize(stored, "stored"), max_pages=2)


@query(f"WITH {LINKS} SELECT DISTINCT link FROM links")
def distinct_links(spark, folder):
    return L.distinct_links(links(spark, folder))


@query(f"""
WITH {LINKS} SELECT link, first.page_id AS page_id, first.pos AS pos
FROM (SELECT link, min({{'page_id': page_id, 'pos': pos}}) AS first FROM links GROUP BY link)""")
def distinct_links_ordered(spark, folder):
    return L.distinct_ordered(links(spark, folder), ["page_id", "pos"])


@query(f"""
WITH {LINKS} SELECT page_id, link FROM links
UNION ALL SELECT page_id, {ROOT} AS link FROM pages""")
def union_links(spark, folder):
    roots = table(spark, folder, "pages").select("page_id", site_root(F.col("url")).alias("link"))
    return L.union_links(links(spark, folder).select("page_id", "link"), roots)


@query(f"""
WITH {LINKS}, counts AS (SELECT {HOST} AS host, count(*) AS links_found FROM links GROUP BY 1)
SELECT host, links_found, (sum(links_found) OVER (ORDER BY host))::BIGINT AS links_so_far FROM counts""")
def links_running_total(spark, folder):
    return L.links_per_group(links(spark, folder).select(host_of(F.col("url")).alias("host")), "host")


@query(f"""
WITH {LINKS}, ranked AS (SELECT {HOST} AS host, page_id, pos, link,
    row_number() OVER (PARTITION BY {HOST} ORDER BY page_id, pos) AS rank FROM links)
SELECT * FROM ranked WHERE rank <= 10""")
def links_top_n_per_host(spark, folder):
    found = links(spark, folder).select(host_of(F.col("url")).alias("host"), "page_id", "pos", "link")
    return L.top_links_per_group(found, ["host"], ["page_id", "pos"], 10)


@query("""
SELECT p_partkey, 'https://second.example/search?s=' || p_name || '&brand=' || p_brand AS url FROM part""")
def search_urls(spark, folder):
    return table(spark, folder, "part").select("p_partkey", query_url(
        "https://second.example/search", {"s": F.col("p_name"), "brand": F.col("p_brand")}).alias("url"))


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100")
def first_n_urls(spark, folder):
    return R.first_n(table(spark, folder, "pages").select("page_id", "url"), 100, "page_id")


@query("SELECT DISTINCT url FROM pages")
def urls_to_read(spark, folder):
    urls = table(spark, folder, "pages").select("url")
    return R.urls_to_read(urls.unionByName(urls))


# Customers are the frontier; those with an urgent order that is filled were attempted.
ATTEMPTED = """attempted AS (SELECT DISTINCT 'c/' || o_custkey AS url FROM orders
                             WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"""
FRONTIER = "frontier AS (SELECT c_custkey AS pos, 'c/' || c_custkey AS url FROM customer)"


def frontier(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pos"), F.concat(F.lit("c/"), "c_custkey").alias("url"))


def attempted(spark, folder):
    return table(spark, folder, "orders") \
        .filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")) \
        .select(F.concat(F.lit("c/"), "o_custkey").alias("url")).distinct()


@query(f"""
WITH {FRONTIER}, state AS (SELECT 'c/' || o_custkey AS url, min(o_orderkey) AS pos FROM orders
                           WHERE o_orderstatus = 'F' GROUP BY 1),
merged AS (SELECT url, 0 AS source, pos FROM state
           UNION ALL SELECT url, 1, pos FROM frontier WHERE url NOT IN (SELECT url FROM state))
SELECT url, row_number() OVER (ORDER BY source, pos) - 1 AS pos FROM merged""")
def frontier_merge(spark, folder):
    state = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("c/"), "o_custkey").alias("url"))
    return R.merge_frontier(state, frontier(spark, folder))


@query(f"WITH {FRONTIER}, {ATTEMPTED} SELECT * FROM frontier WHERE url NOT IN (SELECT url FROM attempted)")
def pending_urls(spark, folder):
    return R.pending(frontier(spark, folder), attempted(spark, folder))


@query(f"""
WITH {ATTEMPTED} SELECT url FROM attempted
UNION SELECT 'c/' || o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def attempted_urls(spark, folder):
    tried = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P") \
        .select(F.concat(F.lit("c/"), "o_custkey").alias("url"))
    return R.attempted_again(attempted(spark, folder), tried)


@query(f"WITH {FRONTIER}, {ATTEMPTED} SELECT * FROM frontier WHERE url IN (SELECT url FROM attempted)")
def known_urls(spark, folder):
    return R.known(frontier(spark, folder), attempted(spark, folder))


@query(f"""
WITH {FRONTIER}, {ATTEMPTED}
SELECT 'kept' AS found_by, url FROM attempted UNION ALL SELECT 'discovered', url FROM frontier""")
def frontier_or_discover(spark, folder):
    discovered, kept = frontier(spark, folder).select("url"), attempted(spark, folder)
    none = readers.empty(spark, kept.schema)
    return R.frontier_or_discover(kept, lambda: discovered).select(F.lit("kept").alias("found_by"), "url") \
        .unionByName(R.frontier_or_discover(none, lambda: discovered)
                     .select(F.lit("discovered").alias("found_by"), "url"))


@query(f"""
WITH {FRONTIER}, {ATTEMPTED} SELECT url, 'Extraction returned None' AS error
FROM frontier WHERE url NOT IN (SELECT url FROM attempted)""")
def missing_captures(spark, folder):
    captured = attempted(spark, folder).withColumn("html", F.lit("<p>"))
    return X.missing_captures(frontier(spark, folder), captured)


@query("""
SELECT page_id, host, (nth * 0.3 + nth // 10 * 1.0)::DOUBLE AS start_offset FROM (
    SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS nth
    FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages))""")
def request_schedule(spark, folder):
    urls = table(spark, folder, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    return P.request_schedule(urls, "host", ["page_id"], batch_size=10).select(
        "page_id", "host", F.round("start_offset", 3).alias("start_offset"))


@query(f"""
WITH {LINKS}, found AS (SELECT count(DISTINCT link) AS n FROM links), spent AS (SELECT sum(value) AS s FROM events)
SELECT n AS unique_urls, round(s, 2) AS total_seconds, round(s / nullif(n, 0), 4) AS seconds_per_url FROM found, spent""")
def discovery_summary(spark, folder):
    log = table(spark, folder, "events").select(F.col("value").alias("elapsed"))
    return P.discovery_summary(links(spark, folder), log).select(
        "unique_urls", F.round("total_seconds", 2).alias("total_seconds"),
        F.round("seconds_per_url", 4).alias("seconds_per_url"))
