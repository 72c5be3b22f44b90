"""Audit of how filters interact: what each removes, in every order they can be applied in.

What an order of filters does to a document follows from which filters it fails alone. So
documents become *cells*: a part of the table, a mask of the failed filters, and counts; at
most ``2 ** filters`` a part, aggregated with map-side partials. The orders are enumerated
by a recursive query over the masks: each level extends every prefix with each unused
letter, carries the filters applied as bits, and emits that step's standing of every mask:
whether it is kept, removed here, or redundant. Joined with the cells these sum up to the
metrics. A prefix is computed once for all orders that begin with it.

The recursion holds one row per mask and prefix, 325 for five filters, however large the
table is and however many parts it has. Repeated texts are found by an aggregation over
hashes and a join with one row per text on one side; no text is shuffled.

Cases: a null text is empty, a null part the empty string; empty texts repeat each other; a
null id is not smaller than any, nor is any smaller than it, so a row with a null id repeats
nothing; rows that repeat an id are rows of their own, none smaller than the other; labels
that repeat an id count once, and once for each value they give it; other columns are left
behind; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagecatalog.llm.common import SPACE
from pagecatalog.session import materialize

LETTERS = "ABCDE"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def conditions(text: Column) -> dict[str, Column]:
    """The filters that a text alone fails, by letter."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    number, distinct, chars = (c.cast("long") for c in (F.size(words), F.size(F.array_distinct(words)), F.length(text)))
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": number < 200, "B": 100 * distinct < 50 * number, "C": 100 * capitals > 3 * chars, "D": text.rlike("[#$%&*|]")}


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def failures(docs: DataFrame, part: str) -> DataFrame:
    """``(doc_id, part, mask)`` for every row of ``docs``, a bit per failed filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [F.when(c, _bit(k)).otherwise(0) for k, c in conditions(text).items()]
    rows = materialize(docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sum(found[1:], found[0]).alias("mask"),
        F.xxhash64(text, F.lit(1)).alias("one"), F.xxhash64(F.lit(2), text).alias("two")), "failures")
    again = rows.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    is_copy = F.when(F.col("doc_id") > F.col("first"), _bit("E")).otherwise(0)
    return rows.join(again, ["one", "two"], "left").select("doc_id", "part", (F.col("mask") + is_copy).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


# fixed: a struct of letter and bit for each filter
_FILTERS = ", ".join(f"struct('{k}' AS letter, {_bit(k)} AS bit)" for k in LETTERS)
_STEPS = f"""
WITH RECURSIVE steps(mask, prefix, letter, bit, before, applied, step) AS (
    SELECT DISTINCT mask, '', '', 0, 0, 0, 0 FROM {{cells}}
    UNION ALL
    SELECT mask, prefix || added.letter, added.letter, added.bit, applied, applied | added.bit, step + 1
    FROM (SELECT mask, prefix, applied, step, explode(filter(array({_FILTERS}), x -> applied & x.bit = 0)) AS added FROM steps))
SELECT mask, prefix, letter, step, mask & applied = 0 AS is_kept, mask & before = 0 AND mask & bit > 0 AS is_removed,
    mask & before > 0 AND mask & bit > 0 AS is_redundant, mask = bit AS is_unique
FROM steps WHERE step > 0"""


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)``: one row per part, order of the filters and step, counts over the part.

    ``labels`` has ``doc_id, quality, toxic``.
    """
    spark = docs.sparkSession
    counted = materialize(cells(failures(docs, part), labels), "mask-cells")
    steps = materialize(spark.sql(_STEPS, cells=counted), "filter-steps")
    sums = {"kept": ("is_kept", "n"), "removed": ("is_removed", "n"), "redundant": ("is_redundant", "n"), "unique_fails": ("is_unique", "n"),
            "good_lost": ("is_removed", "good"), "toxic_lost": ("is_removed", "toxic")}
    metrics = materialize(counted.join(steps, "mask").groupBy("part", "prefix", "letter", "step").agg(
        *[F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)).alias(name) for name, (flag, n) in sums.items()]), "filter-metrics")
    # a prefix stands for all orders that begin with it: as many as the unused letters have
    orders = F.element_at(F.array(*[F.lit(n) for n in (24, 6, 2, 1, 1)]), F.col("step"))
    shapley = metrics.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    complete = steps.filter(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    begun = complete.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    begun = begun.withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("step")))
    return metrics.join(begun, ["prefix", "step"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *METRICS, "shapley")
