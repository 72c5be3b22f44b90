"""Joins, nesting, enrichment and catalogue rows over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagecatalog.functions import array_to_json, join_array, split_text
from pagecatalog.functions.ordering import first_n_within
from pagecatalog.operators import catalog as C, enrich as E
from pagecatalog.plans.registry import query, table
from pagecatalog.session import fresh_path
from pagecatalog.sources import writers

# (l_orderkey, l_linenumber) repeats, so lines are ordered by all their columns
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_shipdate", "l_discount", "l_tax"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)
# children per nested row: small, so that parents with several rows occur
PART_SIZE = 3
NUMBERED_LINES = f"""numbered AS (SELECT *, (row_number() OVER (
    PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) - 1) // {PART_SIZE} AS part FROM lineitem)"""


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_custkey, o_totalprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def child_page_join(spark, folder):
    links = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    captures = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F") \
        .select("o_orderkey", "o_custkey", "o_totalprice")
    return E.child_page_join(links, captures, "l_orderkey", "o_orderkey").drop("o_orderkey")


def nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return E.nest_children(orders, lines, "o_orderkey", LINE_ORDER, ["l_partkey", "l_linenumber"], PART_SIZE, "lines")


@query(f"""
WITH {NUMBERED_LINES}, nested AS (SELECT l_orderkey, part, count(*) AS n_children,
    string_agg(l_partkey || ':' || l_linenumber, '; ' ORDER BY {LINE_ORDER_SQL}) AS children
    FROM numbered GROUP BY 1, 2)
SELECT o_orderkey, o_orderstatus, coalesce(part, 0)::INTEGER AS part, coalesce(n_children, 0)::INTEGER AS n_children,
       coalesce(children, '') AS children
FROM orders LEFT JOIN nested ON o_orderkey = l_orderkey""")
def nest_children(spark, folder):
    text = F.transform("lines", lambda c: F.concat_ws(":", c["l_partkey"], c["l_linenumber"]))
    return nested_orders(spark, folder).select(
        "o_orderkey", "o_orderstatus", "part", F.size("lines").alias("n_children"), join_array(text).alias("children"))


@query(f"""
WITH numbered AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // {PART_SIZE} AS part FROM orders)
SELECT c_custkey, c_name, coalesce(part, 0)::INTEGER AS part, coalesce(n_children, 0)::INTEGER AS n_children,
       coalesce(children, '') AS children
FROM customer LEFT JOIN (SELECT o_custkey, part, count(*) AS n_children,
    string_agg(o_orderkey, '; ' ORDER BY o_orderkey) AS children FROM numbered GROUP BY 1, 2) ON c_custkey = o_custkey""")
def rebuild_nested(spark, folder):
    children = table(spark, folder, "orders")
    parents = table(spark, folder, "customer").select("c_custkey", "c_name")
    nested = E.rebuild_nested(parents, children, "c_custkey", "o_custkey", ["o_orderkey"], ["o_orderkey"], PART_SIZE)
    return nested.select("c_custkey", "c_name", "part", F.size("children").alias("n_children"), join_array(
        F.transform("children", lambda c: c["o_orderkey"].cast("string"))).alias("children"))


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as nested records, their lines as children; orders without lines have none."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("english_name"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("persian_name"),
        F.concat(F.lit("https://shop.example/o/"), "o_orderkey").alias("url"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), *LINE_ORDER, "l_returnflag", "l_linestatus")

    def child(line: Column, key: Column) -> Column:
        images = F.when(line["l_discount"] == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("a/"), line["l_suppkey"]), F.concat(F.lit("b/"), line["l_suppkey"])))
        return F.struct(
            line["l_returnflag"].alias("persian_name"),
            F.concat(F.lit('the "'), line["l_partkey"], F.lit('", boxed')).alias("english_name"),
            F.when(line["l_linestatus"] == "F", "").otherwise("کارخانه").alias("manufacturer"),
            F.concat_ws("/", F.lit("https://shop.example/l"), key, line["l_linenumber"], line["l_partkey"]).alias("url"),
            images.alias("image_url"))

    # texts are made of the nested lines: the lines are dealt out by their columns alone
    nested = E.nest_children(orders, lines, "id", LINE_ORDER,
                             ["l_returnflag", "l_partkey", "l_linestatus", "l_linenumber", "l_discount", "l_suppkey"], PART_SIZE)
    return nested.withColumn("children", F.transform("children", lambda line: child(line, F.col("id"))))


def order_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return C.flatten_children(order_records(spark, folder))


def scalars(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with the array as text, for comparison with SQL."""
    return catalog.withColumn("image_url", join_array(F.col("image_url")))


CATALOG_SQL = """
SELECT o_orderkey::VARCHAR AS generic_id, o_orderpriority AS generic_english_name,
       nullif(o_orderstatus, 'O') AS generic_persian_name, 'https://shop.example/o/' || o_orderkey AS generic_url,
       l_returnflag AS persian_name, 'the "' || l_partkey || '", boxed' AS english_name,
       CASE WHEN l_linestatus = 'F' THEN '' ELSE 'کارخانه' END AS manufacturer,
       'https://shop.example/l/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS url,
       CASE WHEN l_discount = 0 THEN '' ELSE 'a/' || l_suppkey || '; b/' || l_suppkey END AS image_url
FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


@query(CATALOG_SQL)
def flatten_children(spark, folder):
    return scalars(order_catalog(spark, folder))


@query("SELECT count(*) AS rows_written FROM lineitem")
def rows_written(spark, folder):
    path = fresh_path(spark, "counted")
    n = C.write_counted(order_catalog(spark, folder), lambda df: df.write.parquet(path))
    return spark.range(1).select(F.lit(n).cast("long").alias("rows_written"))


PARTS_OF_ORDER = f"""{NUMBERED_LINES}, parts AS (SELECT o_orderkey, coalesce(part, 0)::INTEGER AS part,
    coalesce(string_agg(l_partkey, '; ' ORDER BY {LINE_ORDER_SQL}), '') AS joined
    FROM orders LEFT JOIN numbered ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _part_keys(spark, folder):
    keys = F.transform("lines", lambda c: c["l_partkey"].cast("string"))
    return nested_orders(spark, folder).select("o_orderkey", "part", keys.alias("keys"))


@query(f"""WITH {PARTS_OF_ORDER} SELECT o_orderkey, part, joined,
    CASE WHEN joined = '' THEN 0 ELSE len(string_split(joined, '; ')) END::INTEGER AS n_back,
    joined AS joined_again FROM parts""")
def array_text_roundtrip(spark, folder):
    joined = _part_keys(spark, folder).select("o_orderkey", "part", join_array(F.col("keys")).alias("joined"))
    back = joined.withColumn("back", split_text(F.col("joined")))
    return back.select("o_orderkey", "part", "joined", F.size("back").alias("n_back"),
                       join_array(F.col("back")).alias("joined_again"))


@query(f"""WITH {PARTS_OF_ORDER}, texts AS (
    SELECT o_orderkey, part, '["' || replace(joined, '; ', '","') || '"]' AS t, joined FROM parts)
SELECT o_orderkey, part, CASE WHEN joined <> '' THEN t END AS json_or_null,
       CASE WHEN joined <> '' THEN t ELSE '[]' END AS json_or_empty FROM texts""", name="array_to_json")
def array_as_json(spark, folder):
    keys = F.col("keys")
    return _part_keys(spark, folder).select(
        "o_orderkey", "part", array_to_json(keys).alias("json_or_null"),
        array_to_json(keys, empty_as_null=False).alias("json_or_empty"))


# Search hits of a part's name and brand: its lines, dearest first.
HIT_ORDER_SQL = f"l_extendedprice DESC, l_orderkey, {LINE_ORDER_SQL}"
HITS = f"""hits AS (SELECT p_name || ' ' || p_brand AS query, l_orderkey, l_suppkey, l_extendedprice,
    row_number() OVER (PARTITION BY p_name || ' ' || p_brand ORDER BY {HIT_ORDER_SQL}) AS rank
    FROM part JOIN lineitem ON l_partkey = p_partkey)"""


def _hits(spark, folder):
    query_text = E.search_text(F.col("p_name"), F.col("p_brand")).alias("query")
    parts = table(spark, folder, "part").select("p_partkey", query_text)
    lines = table(spark, folder, "lineitem")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")) \
        .select("query", "l_orderkey", *LINE_ORDER)


def _searched_parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", E.search_text(F.col("p_name"), F.col("p_brand")).alias("query"))


def _hit_order():
    return [F.desc("l_extendedprice"), "l_orderkey", *LINE_ORDER]


@query(f"""WITH {HITS}, best AS (SELECT query,
    string_agg('img/' || l_orderkey || '/' || l_suppkey, '; ' ORDER BY rank) AS images FROM hits WHERE rank <= 5 GROUP BY 1)
SELECT p_partkey, p_name || ' ' || p_brand AS query, coalesce(images, '') AS images
FROM part LEFT JOIN best ON query = p_name || ' ' || p_brand""")
def top5_images(spark, folder):
    candidates = first_n_within(_hits(spark, folder), ["query"], _hit_order(), 5).select(
        "query", "rank", F.concat_ws("/", F.lit("img"), "l_orderkey", "l_suppkey").alias("image"))
    found = E.top_images(_searched_parts(spark, folder), candidates)
    return found.select("p_partkey", "query", join_array(F.col("image_url")).alias("images"))


@query(f"""WITH {HITS} SELECT p_partkey, p_name || ' ' || p_brand AS query, l_orderkey AS hit_order, l_suppkey AS hit_supplier
FROM part LEFT JOIN hits ON query = p_name || ' ' || p_brand AND rank = 1""")
def first_hit_lookup(spark, folder):
    return _first_hits(spark, folder).select(
        "p_partkey", "query", F.col("l_orderkey").alias("hit_order"), F.col("l_suppkey").alias("hit_supplier"))


def _first_hits(spark, folder):
    hits = _hits(spark, folder).withColumn("cheapness", -F.col("l_extendedprice"))
    return E.first_hit_lookup(_searched_parts(spark, folder), hits, ["cheapness", "l_orderkey", *LINE_ORDER])


@query(f"""WITH {HITS}, products AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE s_acctbal > 0)
SELECT p_partkey, l_suppkey AS hit_supplier, s_name, n_name FROM part
LEFT JOIN hits ON query = p_name || ' ' || p_brand AND rank = 1 LEFT JOIN products ON l_suppkey = s_suppkey""")
def second_hop_lookup(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    products = table(spark, folder, "supplier").filter(F.col("s_acctbal") > 0) \
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    found = E.second_hop_lookup(_first_hits(spark, folder), products, "l_suppkey", "s_suppkey")
    return found.select("p_partkey", F.col("l_suppkey").alias("hit_supplier"), "s_name", "n_name")


@query("""
WITH hits AS (SELECT n_nationkey, min(c_custkey) AS first_customer FROM customer JOIN nation ON c_nationkey = n_nationkey
              WHERE n_regionkey <= 2 GROUP BY 1),
named AS (SELECT s_suppkey, s_nationkey, '' AS persian_name,
    CASE WHEN s_acctbal < 0 THEN '' WHEN s_acctbal < 4000 THEN 'Unknown' ELSE s_name END AS manufacturer,
    CASE WHEN s_acctbal < 6000 THEN '' ELSE 'img/' || s_suppkey END AS image_url FROM supplier)
SELECT s_suppkey, coalesce(c_name, persian_name) AS persian_name,
    CASE WHEN manufacturer IN ('', 'Unknown') THEN coalesce(c_mktsegment, manufacturer) ELSE manufacturer END AS manufacturer,
    CASE WHEN image_url = '' THEN coalesce('hit/' || first_customer, image_url) ELSE image_url END AS image_url
FROM named LEFT JOIN hits ON s_nationkey = n_nationkey LEFT JOIN customer ON c_custkey = first_customer""")
def conditional_fill(spark, folder):
    customers = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    nations = table(spark, folder, "nation").filter(F.col("n_regionkey") <= 2).select("n_nationkey")
    hits = E.first_hits(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey"),
                        ["c_custkey"], "c_nationkey")
    balance = F.col("s_acctbal")
    records = table(spark, folder, "supplier").select(
        "s_suppkey", "s_nationkey", F.lit("").alias("persian_name"),
        F.when(balance < 0, "").when(balance < 4000, "Unknown").otherwise(F.col("s_name")).alias("manufacturer"),
        F.when(balance < 6000, "").otherwise(F.concat(F.lit("img/"), "s_suppkey")).alias("image_url"))
    joined = records.join(hits, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return joined.withColumns(E.filled(
        F.col("persian_name"), F.col("c_name"), F.col("manufacturer"), F.col("c_mktsegment"),
        F.col("image_url"), F.concat(F.lit("hit/"), "c_custkey"))) \
        .select("s_suppkey", "persian_name", "manufacturer", "image_url")


@query("""
SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 10 THEN upper(p_name) ELSE p_name END AS p_name
FROM part""")
def enrich_first_n(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return E.enrich_first_n(parts, ["p_partkey"], 10, {"p_name": F.upper("p_name")}, ["p_partkey"])


@query("SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS id, p_partkey, p_name FROM part")
def surrogate_key(spark, folder):
    return C.surrogate_key(table(spark, folder, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


@query("""
SELECT p_partkey AS id, p_name AS english_name, '' AS persian_name,
       CASE WHEN p_size > 10 THEN p_brand ELSE 'Unknown' END AS manufacturer,
       CASE WHEN p_size > 20 THEN p_type ELSE '' END AS description, '' AS image_url, '[]' AS combinations FROM part""")
def source_record(spark, folder):
    found = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("english_name"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("manufacturer"),
        F.when(F.col("p_size") > 20, F.col("p_type")).alias("description"),
        F.lit(None).cast("string").alias("image_url"))
    return writers.as_table_rows(C.source_record(found), empty_as_null=False)


# An update of the customer table: balances after the urgent orders, twice for some, and
# the suppliers as new rows.
UPDATE = """
changed AS (SELECT c_custkey, c_name, round(c_acctbal - o_totalprice, 2) AS c_acctbal, o_orderkey AS seq
            FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
added AS (SELECT -1 - s_suppkey AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal, 0::BIGINT AS seq FROM supplier),
update_rows AS (SELECT * FROM changed UNION ALL SELECT * FROM added)
"""


def _base_and_update(spark, folder):
    base = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    orders = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    changed = base.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_name", F.round(F.col("c_acctbal") - F.col("o_totalprice"), 2).alias("c_acctbal"),
        F.col("o_orderkey").alias("seq"))
    added = table(spark, folder, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_acctbal").alias("c_acctbal"), F.lit(0).cast("long").alias("seq"))
    return base, changed.unionByName(added)


@query(f"""WITH {UPDATE}
SELECT c_custkey, c_name, c_acctbal FROM update_rows
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM update_rows)""")
def upsert_latest(spark, folder):
    base, update = _base_and_update(spark, folder)
    return C.upsert(base, update, ["c_custkey"], "seq")


@query(f"""WITH {UPDATE} SELECT c_custkey, c_name, c_acctbal FROM customer
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM update_rows""")
def append_rows(spark, folder):
    base, update = _base_and_update(spark, folder)
    return C.append_rows(base, update.drop("seq"))


@query("""
SELECT doc_id, CASE WHEN source <> 'src0' AND n_chars < 5000 THEN
    'catalog/images/' || doc_id || CASE WHEN lang = 'en' THEN '.png' ELSE '.jpg' END END AS image_path FROM documents""")
def image_manifest(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.select("doc_id", writers.image_path(
        "catalog", F.col("doc_id").cast("string"),
        image_url=F.when(F.col("source") != "src0", F.concat(F.lit("/img/"), "doc_id")),
        status=F.when(F.col("n_chars") < 5000, 200).otherwise(404),
        content_type=F.when(F.col("lang") == "en", "image/png").when(F.col("lang") == "fr", "image/jpeg"),
    ).alias("image_path"))
