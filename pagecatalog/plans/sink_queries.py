"""Sinks and sources, by writing what the queries compute and reading it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagecatalog import schemas
from pagecatalog.functions.ordering import global_index
from pagecatalog.operators import links as L
from pagecatalog.plans.enrich_queries import CATALOG_SQL, order_catalog, scalars
from pagecatalog.plans.link_queries import ATTEMPTED, FRONTIER, LINKS, attempted, frontier, links
from pagecatalog.plans.registry import query, table
from pagecatalog.session import discard, fresh_path, materialize, remove_path, session_conf
from pagecatalog.sources import readers, state, writers
from pagecatalog.sources.committed import CommittedSink, read_committed

PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType())])


def _table_name(tag: str) -> str:
    return f"pagecatalog_{tag}_{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name FROM part")
def scan_table(spark, folder):
    name = _table_name("part")
    table(spark, folder, "part").select("p_partkey", "p_name").createOrReplaceTempView(name)
    return readers.read_table(spark, name, PART).unionByName(readers.read_table(spark, f"{name}_absent", PART))


@query(f"WITH {LINKS} SELECT pos, link AS url FROM links")
def url_array_scan(spark, folder):
    path = fresh_path(spark, "url-arrays")
    found = links(spark, folder).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("l"))
    found.select(F.to_json(F.transform("l", lambda x: x["link"]))).write.text(path)
    return readers.read_url_array(spark, path, array_per_line=True)


@query(f"WITH {LINKS} SELECT row_number() OVER (ORDER BY page_id, pos) - 1 AS pos, link AS url FROM links")
def url_array_file(spark, folder):
    """All links as one array in one file, read in splits."""
    path = fresh_path(spark, "url-array")
    found = materialize(links(spark, folder).select("page_id", "pos", "link"), "links")
    lines = found.select("page_id", "pos", F.concat(F.to_json(F.array("link")).substr(F.lit(2), F.length(F.to_json(F.array("link"))) - 2), F.lit(",")).alias("line"))
    ends = spark.createDataFrame([(-1, -1, "["), (None, None, "null]")], "page_id long, pos long, line string")
    lines.unionByName(ends).orderBy(F.asc_nulls_last("page_id"), "pos").coalesce(1).select("line").write.text(path)
    with session_conf(spark, spark__sql__files__maxPartitionBytes=256 * 1024):
        read = readers.read_url_array(spark, path)
    return read.filter("url is not null")


@query(CATALOG_SQL)
def catalog_json_roundtrip(spark, folder):
    path = fresh_path(spark, "json")
    writers.write_catalog_json(order_catalog(spark, folder), path)
    return scalars(readers.read_catalog_json(spark, path))


@query(CATALOG_SQL.replace("nullif(o_orderstatus, 'O')", "coalesce(nullif(o_orderstatus, 'O'), '')"))
def catalog_csv_roundtrip(spark, folder):
    path = fresh_path(spark, "csv")
    writers.write_catalog_csv(order_catalog(spark, folder), path)
    return scalars(readers.read_catalog_csv(spark, path))


@query(CATALOG_SQL)
def catalog_table_roundtrip(spark, folder):
    name = _table_name("catalog")
    writers.write_catalog_table(order_catalog(spark, folder), name, fresh_path(spark, "table"))
    return scalars(readers.read_catalog_table(spark, name))


@query(f"{CATALOG_SQL} WHERE l_returnflag = 'R'")
def overwrite_sink(spark, folder):
    root = fresh_path(spark, "replaced")
    writers.replace_all(order_catalog(spark, folder), root)
    kept = readers.current_version(spark, root, schemas.CATALOG)
    writers.replace_all(kept.filter(F.col("persian_name") == "R"), root)
    return scalars(readers.current_version(spark, root, schemas.CATALOG))


CONTENTS_SQL = f"""contents AS (SELECT count(*) AS rows, sum(length(generic_url) + length(url))::BIGINT AS urls,
    sum(length(coalesce(generic_persian_name, '')) + length(english_name) + length(manufacturer))::BIGINT AS names,
    sum(length(image_url))::BIGINT AS images FROM ({CATALOG_SQL}))"""


def _contents(catalog: DataFrame, **literals: str) -> DataFrame:
    """Lengths of what a catalogue holds, per column kind."""
    n = lambda *cols: F.sum(sum((F.length(F.coalesce(c, F.lit(""))) for c in cols), F.lit(0)))
    return scalars(catalog).agg(
        *[F.lit(v).alias(k) for k, v in literals.items()], F.count(F.lit(1)).alias("rows"),
        n("generic_url", "url").alias("urls"), n("generic_persian_name", "english_name", "manufacturer").alias("names"),
        n("image_url").alias("images"))


@query(f"""
WITH {CONTENTS_SQL} SELECT asked, written, rows, urls, names, images FROM contents,
    (VALUES ('JSON', 'json'), ('Csv', 'csv'), ('parquet', 'parquet'), ('xml?', 'json')) AS v(asked, written)""")
def sink_dispatch(spark, folder):
    catalog = materialize(order_catalog(spark, folder), "dispatched")
    counted = []
    for asked in ("JSON", "Csv", "parquet", "xml?"):
        path = fresh_path(spark, "dispatch")
        written = writers.write_catalog(catalog, asked, path)
        counted.append(materialize(_contents(writers.load_catalog(spark, written, path), asked=asked, written=written), "contents"))
        remove_path(spark, path)  # what was read back: the formats need not lie on disk together
    discard(catalog)
    return L.union_links(*counted)


@query(f"""
WITH {CONTENTS_SQL} SELECT format, rows, urls, names, images FROM contents, (VALUES ('json'), ('csv'), ('parquet')) AS v(format)""")
def sink_fanout(spark, folder):
    root = fresh_path(spark, "fanout")
    catalog = materialize(order_catalog(spark, folder), "fanned-out")
    writers.fan_out(catalog, root)
    writers.fan_out(catalog.filter(F.col("url").isNull()), f"{root}/json")  # empty: writes nothing
    return L.union_links(*[_contents(writers.load_catalog(spark, fmt, f"{root}/{fmt}"), format=fmt) for fmt in ("json", "csv", "parquet")])


@query("SELECT p_partkey, p_name, true AS created, false AS created_again FROM part")
def ensure_table(spark, folder):
    name, path = _table_name("ensured"), fresh_path(spark, "ensured")
    created = writers.ensure_table(spark, name, PART, path)
    table(spark, folder, "part").select("p_partkey", "p_name").write.insertInto(name)
    again = writers.ensure_table(spark, name, PART, path)
    return spark.table(name).withColumns({"created": F.lit(created), "created_again": F.lit(again)})


@query(f"""WITH {FRONTIER}, {ATTEMPTED} SELECT pos, frontier.url, attempted.url IS NOT NULL AS tried
FROM frontier LEFT JOIN attempted USING (url)""")
def state_roundtrip(spark, folder):
    root = fresh_path(spark, "state")
    nothing, tried_none = state.read_state(spark, root)
    state.write_state(nothing, tried_none, root)
    state.write_state(frontier(spark, folder), attempted(spark, folder), root)
    urls, tried = state.read_state(spark, root)
    flags = tried.select("url", F.lit(True).alias("seen"))
    return urls.join(flags, "url", "left").select("pos", "url", F.col("seen").isNotNull().alias("tried"))


@query(f"""
WITH {LINKS}, firsts AS (SELECT link, min({{'page_id': page_id, 'pos': pos}}) AS first FROM links GROUP BY link)
SELECT row_number() OVER (ORDER BY first) - 1 AS pos, link AS url FROM firsts""")
def links_roundtrip(spark, folder):
    path = fresh_path(spark, "links")
    found = L.distinct_ordered(links(spark, folder), ["page_id", "pos"]).withColumnRenamed("pos", "nth")
    writers.write_links(global_index(found.withColumnRenamed("link", "url"), ["page_id", "nth"], "pos"), path)
    return readers.read_links(spark, path)


@query("""
SELECT url, md5(url) AS key, strftime(TIMESTAMP '2024-01-01' + to_hours(page_id), '%Y-%m-%d') AS fetch_date, length(html) AS chars
FROM pages""")
def captures_roundtrip(spark, folder):
    path = fresh_path(spark, "captures")
    fetched_at = F.timestamp_micros((F.lit(1704067200) + F.col("page_id") * 3600) * 1_000_000)
    writers.write_captures(table(spark, folder, "pages").select("url", "html", fetched_at.alias("fetched_at")), path)
    return spark.read.parquet(path).select(
        "url", "key", F.date_format("fetch_date", "yyyy-MM-dd").alias("fetch_date"), F.length("html").cast("long").alias("chars"))


@query(CATALOG_SQL)
def custom_sink(spark, folder):
    """A format of the user's own, saved, loaded and merged into: older names are replaced."""
    def write_orc(df: DataFrame, path: str, mode: str) -> None:
        df.write.mode(mode).orc(path)

    def read_orc(session: SparkSession, path: str) -> DataFrame:
        return session.read.schema(schemas.CATALOG).orc(path)

    writers.register_sink("orc", write_orc, read_orc)
    path = fresh_path(spark, "orc")
    catalog = materialize(order_catalog(spark, folder), "catalog")
    old = catalog.filter(F.col("persian_name") == "R").withColumn("english_name", F.lit("old"))
    writers.write_catalog(old, "ORC", path)
    return scalars(writers.merge_catalog(catalog, "orc", path))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL")
def committed_sink(spark, folder):
    """Two named writes through the sink with commit; the second is run again and changes nothing."""
    spark.dataSource.register(CommittedSink)
    path = fresh_path(spark, "committed")
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    for name, part in (("debts", rows.filter("c_acctbal < 0")), ("others", rows.filter("c_acctbal >= 0")), ("others", rows)):
        part.write.format("committed").mode("append").option("commit", name).save(path)
    return read_committed(spark, path, rows.schema)
