"""Link discovery: selected links, resolution, pagination, dedup, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagecatalog.defaults import (
    CHILD_LINK_SELECTORS, GROUP_SELECTORS, MAX_PAGES, RECORD_SELECTORS)
from pagecatalog.functions import resolve_url
from pagecatalog.functions.ordering import first_n_within, running_totals
from pagecatalog.operators.select import first_matching

HREF_PATTERN = r'<a href="([^"]*)"'
_PAGE_SUFFIX = r"^(.*)\?page=([1-9][0-9]*)$"


def _hrefs(selectors: Sequence[str]) -> Column:
    """Non-empty links of the winning selector; the selector is chosen before links
    without an address are dropped."""
    found = first_matching(selectors)
    return F.filter(F.transform(found, lambda e: e["attrs"]["href"]), lambda h: h.isNotNull() & (h != ""))


def _explode_links(docs: DataFrame, keep: Sequence[str], urls: Column) -> DataFrame:
    return docs.select(*keep, F.posexplode(urls).alias("pos", "link"))


def group_links(docs: DataFrame, base: Column | str, selectors: Sequence[str] = GROUP_SELECTORS,
                keep: Sequence[str] = ("url",)) -> DataFrame:
    """Links of each index page, resolved, first-seen order, repeats dropped.

    ``array_distinct`` keeps first occurrences, so this needs no shuffle.
    """
    urls = F.array_distinct(F.transform(_hrefs(selectors), lambda h: resolve_url(base, h)))
    return _explode_links(docs, keep, urls)


def page_links(docs: DataFrame, base: Column | str, selectors: Sequence[str] = RECORD_SELECTORS,
               keep: Sequence[str] = ("url",)) -> DataFrame:
    """Links of each listing page, resolved, repeats kept."""
    base = F.lit(base) if isinstance(base, str) else base
    links = docs.select(*keep, base.alias("_base"), F.posexplode(_hrefs(selectors)).alias("pos", "link"))
    # outside of a lambda, addresses are resolved by compiled code
    return links.select(*keep, "pos", resolve_url(F.col("_base"), F.col("link")).alias("link"))


def child_links(docs: DataFrame, base: Column | str,
                selectors: Sequence[str] = CHILD_LINK_SELECTORS,
                keep: Sequence[str] = ("url",)) -> DataFrame:
    """Links of each record page to its children, each once per page."""
    return group_links(docs, base, selectors, keep)


def pattern_hrefs(captures: DataFrame, keep: Sequence[str] = ("url",), html: str = "html",
                  pattern: str = HREF_PATTERN) -> DataFrame:
    """Raw links by one fixed pattern, for pages of a known shape; never leaves the JVM."""
    found = F.regexp_extract_all(html, F.lit(pattern), 1)
    return captures.select(*keep, F.posexplode(found).alias("pos", "href"))


def paginated_captures(groups: DataFrame, captures: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """Captured pages ``group``, ``group?page=2`` .. ``group?page=max_pages`` of each group.

    ``max_pages=None`` takes all. Only groups whose first page was captured count; missing later pages are skipped.
    The page number is read off the captured address, so the cost does not depend on
    ``max_pages`` and no address is generated for pages that do not exist.
    """
    groups = groups.select("group_url").distinct()
    stored = captures.select("url")
    live = groups.join(stored, F.col("group_url") == F.col("url"), "left_semi")
    page_no = F.regexp_extract("url", _PAGE_SUFFIX, 2).try_cast("bigint")
    later = stored.filter(F.contains("url", F.lit("?page="))).select(F.regexp_extract("url", _PAGE_SUFFIX, 1).alias("group_url"),
                          page_no.alias("page_no"), "url") \
        .filter(F.col("page_no") >= 2).distinct()
    if max_pages is not None:
        later = later.filter(F.col("page_no") <= max_pages)
    rest = later.join(live, "group_url")
    head = live.select("group_url", F.lit(1).cast("bigint").alias("page_no"), F.col("group_url").alias("url"))
    return head.unionByName(rest)


def distinct_ordered(links: DataFrame, order: Sequence[str], key: str = "link") -> DataFrame:
    """Each link once, with the smallest position it was seen at (partial in the map side)."""
    firsts = links.groupBy(key).agg(F.min(F.struct(*order)).alias("at"))
    return firsts.select(key, *[F.col(f"at.{c}").alias(c) for c in order])


def distinct_links(links: DataFrame, key: str = "link") -> DataFrame:
    return links.select(key).distinct()


def union_links(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All links of several lists, repeats kept."""
    for other in others:
        first = first.unionByName(other)
    return first


def links_per_group(links: DataFrame, group: str) -> DataFrame:
    """Links found per group and the running total in group order."""
    counts = links.groupBy(group).agg(F.count(F.lit(1)).alias("links_found"))
    return running_totals(counts, [group], {"links_so_far": F.col("links_found")})


def top_links_per_group(links: DataFrame, group: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` links of each group."""
    return first_n_within(links, group, order, limit)
