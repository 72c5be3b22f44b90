"""Parents with their children, and gaps filled from a second source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagecatalog import defaults as D
from pagecatalog.functions.ordering import first_n_within, rank_within
from pagecatalog.operators.frontier import first_n
from pagecatalog.session import materialize

#: Children of one parent that one task may sort; those of larger parents are spread over slices.
TASK_CHILDREN = 1_000_000


def child_page_join(links: DataFrame, captures: DataFrame, link: str, url: str = "url") -> DataFrame:
    """Child links with their captures; links without a capture drop out.

    Captures hold a URL once, so a link target that a third of all links share skews
    one side only, which AQE splits.
    """
    return links.join(captures, F.col(link) == F.col(url), "inner")


def nest_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str],
                  fields: Sequence[str], part_size: int | None, name: str = "children") -> DataFrame:
    """Parents with arrays of their children in order; ``[]`` for none, orphans drop out.

    A parent has one row per ``part_size`` children, numbered by ``part`` from 0, so no
    array outgrows a task, however many children a parent has. None, one row per parent,
    is for children that something else bounds already, as a page bounds its links.
    """
    if part_size is None:
        nested = _collected(children, [key], F.struct(*order), fields, name).withColumn("part", F.lit(0))
    else:
        columns = dict.fromkeys([key, *order, *fields])
        nested = _in_parts(children.select(*columns).filter(F.col(key).isNotNull()), key, order, fields, part_size, name)
    empty = F.array().cast(nested.schema[name].dataType)
    # nested rows are large: never broadcast them
    return parents.join(nested.hint("merge"), key, "left").select(
        *parents.columns,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(name, empty).alias(name))


def _in_parts(children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], part_size: int, name: str) -> DataFrame:
    """Children dealt out by key once; numbering, nesting and the join to the parents follow where
    they then lie. A key with more than ``TASK_CHILDREN`` is numbered in slices instead, and
    there are few of these: at most one in as many rows."""
    def parts(ranked: DataFrame) -> DataFrame:
        numbered = ranked.withColumn("part", F.floor((F.col("_nth") - 1) / part_size).cast("int"))
        return _collected(numbered, [key, "part"], F.col("_nth"), fields, name)

    large = materialize(children.groupBy(key).count().filter(F.col("count") > TASK_CHILDREN).select(key), "large-parents")
    few = children if large.isEmpty() else children.join(large, key, "left_anti")
    nested = parts(few.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))))
    if large.isEmpty():
        return nested
    return nested.unionByName(parts(rank_within(children.join(large, key, "left_semi"), [key], order, "_nth")))


def _collected(numbered: DataFrame, keys: Sequence[str], at: Column, fields: Sequence[str], name: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.struct(*fields).alias("item"))))
    return numbered.groupBy(*keys).agg(F.transform(rows, lambda r: r["item"]).alias(name))


def rebuild_nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str],
                   fields: Sequence[str], part_size: int | None, name: str = "children") -> DataFrame:
    """Nested records from a parent table and a child table kept apart."""
    if child_key != parent_key:
        children = children.withColumn(parent_key, F.col(child_key))
    return nest_children(parents, children, parent_key, order, fields, part_size, name)


def search_text(english_name: Column, manufacturer: Column) -> Column:
    return F.concat(english_name, F.lit(" "), manufacturer)


def top_images(children: DataFrame, candidates: DataFrame, n: int = D.IMAGES_PER_CHILD,
               query: str = "query", name: str = "image_url") -> DataFrame:
    """Children with the first ``n`` images found for their search text, ``[]`` for none."""
    best = first_n_within(candidates, [query], ["rank", "image"], n, "_n")
    images = best.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("_n", "image"))).alias("found"))
    images = images.select(query, F.transform("found", lambda i: i["image"]).alias(name))
    return children.join(images, query, "left").withColumn(
        name, F.coalesce(name, F.array().cast("array<string>")))


def first_hits(hits: DataFrame, order: Sequence[str], query: str = "query") -> DataFrame:
    """The first hit of each search, by a map-side minimum."""
    columns = [c for c in hits.columns if c != query]
    best = hits.groupBy(query).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("hit"))
    return best.select(query, *[F.col(f"hit.{c}").alias(c) for c in columns])


def first_hit_lookup(records: DataFrame, hits: DataFrame, order: Sequence[str], query: str = "query") -> DataFrame:
    """Records with their first hit's columns, NULL where the search found nothing."""
    return records.join(first_hits(hits, order, query), query, "left")


def second_hop_lookup(records: DataFrame, products: DataFrame, link: str, url: str) -> DataFrame:
    """Records with the fields of the page their hit points to."""
    return records.join(products, F.col(link) == F.col(url), "left")


def _blank(value: Column, *also: str) -> Column:
    return value.isNull() | value.isin("", *also)


def filled(name: Column, hit_name: Column, manufacturer: Column, hit_manufacturer: Column,
           image: Column, hit_image: Column) -> dict[str, Column]:
    """Columns after a hit: its name always wins, its manufacturer replaces an empty or
    unknown one, its image an empty one."""
    return {
        "persian_name": F.coalesce(hit_name, name),
        "manufacturer": F.when(_blank(manufacturer, D.UNKNOWN), F.coalesce(hit_manufacturer, manufacturer))
        .otherwise(manufacturer),
        "image_url": F.when(_blank(image), F.coalesce(hit_image, image)).otherwise(image),
    }


def enrich_first_n(records: DataFrame, order: Sequence[str], n: int | None, changes: dict[str, Column],
                   key: Sequence[str]) -> DataFrame:
    """Apply ``changes`` to the first ``n`` records only; the rest pass through.

    Only keys and order are ranked, never whole rows; whether the chosen keys are
    broadcast is left to Spark, which knows their size.
    """
    if n is None:
        return records.withColumns(changes)
    ranked = records.select(*dict.fromkeys([*key, *order]))
    chosen = first_n(ranked, n, *order).select(*key).withColumn("_chosen", F.lit(True))
    flagged = records.join(chosen, list(key), "left")
    hit = F.coalesce("_chosen", F.lit(False))
    return flagged.withColumns({
        c: F.when(hit, v).otherwise(F.col(c)) if c in records.columns else F.when(hit, v)
        for c, v in changes.items()}).drop("_chosen")
