"""Set operations on the list of URLs still to be processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagecatalog.functions.ordering import global_index


def merge_frontier(state: DataFrame, listed: DataFrame) -> DataFrame:
    """State URLs in their order, then listed URLs that the state lacks, in theirs.

    Both are ``(pos, url)``; so is the result, with positions renumbered.
    """
    both = state.select(F.lit(0).alias("source"), "pos", "url").unionByName(
        listed.select(F.lit(1).alias("source"), "pos", "url"))
    firsts = both.groupBy("url").agg(F.min(F.struct("source", "pos")).alias("at"))
    ordered = global_index(firsts.select("url", "at.source", F.col("at.pos").alias("was")),
                           ["source", "was", "url"], "pos")
    return ordered.select("pos", "url")


def new_links(state: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed URLs that the state lacks, in their order, with positions that go on after the
    state's last. The state keeps its positions, and only what is new is sorted."""
    last = state.agg(F.max("pos").alias("pos")).first()["pos"]
    firsts = listed.groupBy("url").agg(F.min("pos").alias("was")).join(state.select("url"), "url", "left_anti")
    return global_index(firsts, ["was", "url"], "pos", start=0 if last is None else last + 1).select("pos", "url")


def pending(frontier: DataFrame, attempted: DataFrame, key: str = "url") -> DataFrame:
    """Frontier rows that were never attempted."""
    return frontier.join(attempted.select(key).distinct(), key, "left_anti")


def attempted_again(attempted: DataFrame, just_tried: DataFrame, key: str = "url") -> DataFrame:
    """The attempted set after a run: it grows whether or not extraction worked."""
    return attempted.select(key).unionByName(just_tried.select(key)).distinct()


def known(frontier: DataFrame, attempted: DataFrame, key: str = "url") -> DataFrame:
    """Frontier rows that were attempted before."""
    return frontier.join(attempted.select(key).distinct(), key, "left_semi")


def frontier_or_discover(frontier: DataFrame, discover) -> DataFrame:
    """The frontier, or what ``discover()`` finds if the frontier is empty.

    The emptiness check reads at most one row; discovery is not even planned when it
    is not needed.
    """
    return discover() if frontier.isEmpty() else frontier


def first_n(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in order; no limit when ``n`` is None or 0.

    By position in range-partitioned slices, whatever ``n`` is: no task sees all n rows.
    """
    if n is not None and n < 0:
        raise ValueError("a limit cannot be negative")
    if not n:
        return df
    return global_index(df, order, "_idx").filter(F.col("_idx") < n).drop("_idx")


def urls_to_read(links: DataFrame, key: str = "url") -> DataFrame:
    """Each URL once, so that the capture join reads each page once."""
    return links.select(key).distinct()
