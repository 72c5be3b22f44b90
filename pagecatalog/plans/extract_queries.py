"""Fields of the stored pages, each checked against a regular expression in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecatalog.functions import join_array
from pagecatalog.operators import extract as X
from pagecatalog.operators.elements import elements
from pagecatalog.plans.registry import query, table


def docs(spark, folder):
    return elements(table(spark, folder, "pages"), ("page_id", "url"))


def _decoded(sql: str) -> str:
    """The entities that occur, their closing semicolon missing where a text was cut."""
    for entity, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        sql = f"regexp_replace({sql}, '&{entity};?', '{char}', 'g')"
    return sql


def _plain(sql: str) -> str:
    """Text of a piece of markup: tags off, entities decoded, ends trimmed."""
    return rf"regexp_replace({_decoded(f"regexp_replace({sql}, '<[^>]*>', '', 'g')")}, '^\s+|\s+$', '', 'g')"


H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"
AD = """regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's')"""
NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')"
AFTER_H1 = "regexp_extract(html, '</h1>.*?<p>(.*?)(<p>|</p>|</article>)', 1, 's')"


@query("""
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
GROUP BY ALL""")
def page_elements(spark, folder):
    rows = docs(spark, folder).select("page_id", F.explode("elements.tag").alias("tag"))
    return rows.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, {_plain(H1)} AS title FROM pages")
def page_titles(spark, folder):
    return docs(spark, folder).select("page_id", X.field_text("h1").alias("title"))


@query(f"""
SELECT page_id, coalesce({_plain("nullif(regexp_extract(html, '<a href=\"[^\"]*th[^\"]*\">(.*?)</a>', 1, 's'), '')")},
                         {_plain(AD)}) AS field FROM pages""")
def prioritised_field(spark, folder):
    return docs(spark, folder).select("page_id", F.coalesce(
        X.field_text(".producer", 'a[href*="th"]', ".ad", "h1"), F.lit("")).alias("field"))


@query(f"""SELECT page_id, {_decoded("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)")} AS attribute FROM pages""")
def prioritised_attribute(spark, folder):
    return docs(spark, folder).select(
        "page_id", X.field_attribute("href", "article img", "h1", "nav a").alias("attribute"))


@query(f"""
SELECT page_id, coalesce(array_to_string(list_transform(regexp_extract_all({NAV}, '<li>(.*?)</li>', 1, 's'),
       lambda item: {_plain("item")}), '; '), '') AS items FROM pages""")
def list_field(spark, folder):
    return docs(spark, folder).select("page_id", join_array(X.field_list(".ingredients", "nav")).alias("items"))


@query(f"""SELECT page_id, {_plain(AD)} AS whole_text FROM pages""")
def list_field_without_items(spark, folder):
    return docs(spark, folder).select("page_id", join_array(X.field_list(".ad")).alias("whole_text"))


@query(f"SELECT page_id, {_plain(AFTER_H1)} AS value FROM pages")
def label_value(spark, folder):
    return docs(spark, folder).select("page_id", X.field_after_label("h1", None, "p").alias("value"))


@query(f"SELECT page_id, {_plain(AD)} AS description, '' AS image_url FROM pages")
def page_description(spark, folder):
    return docs(spark, folder).select(
        "page_id", F.coalesce(X.field_text("div.ad"), F.lit("")).alias("description"),
        F.coalesce(X.field_attribute("src", "div.ad img"), F.lit("")).alias("image_url"))
