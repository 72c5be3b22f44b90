"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, at most ``repeats`` times over. A
document's virtual finish time is the words of its source up to its end, divided by the
source's weight. The mix serves documents in the order of that time until the budget of
words is spent; the document that each source is at by then is taken in part. So sources
advance in proportion to their weights, and one that has been served ``repeats`` times over
leaves its share to the others.

When the budget is spent is the same for all sources, and follows from one row per source:
sources are sorted by the time at which they would run dry, and the budget is spent before
the first that would run dry later. What a document contributes follows from its running
total within its source, which is computed in range-partitioned slices, so a source that
holds a third of all rows is many slices and no task of its own.

DataFrame functions only. Cases: a null text has no words; a null source is a source of its
own that comes last; a source without words has target 0; repeated rows are served one after
the other; an empty table gives no rows. Orders are fixed by hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagecatalog.functions.ordering import global_index, ordered_slices
from pagecatalog.llm.common import WORD
from pagecatalog.session import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from one row ``(source, source_size)`` per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # strings sort by code point
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight)
    dry = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = dry.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("source_size").over(dry.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({
        "_cap": F.col("source_size") * repeats,
        "_left": F.sum("source_size").over(all_rows) - F.coalesce(before, F.lit(0)) * repeats,
        "_sharing": F.sum("weight").over(dry.rowsBetween(0, Window.unboundedFollowing))})
    # the time at which the budget is spent, if all sources before have run dry and this one has not
    rows = rows.withColumn("_time", F.col("_left") / F.col("_sharing"))
    lasts = F.col("_time") * F.col("weight") <= F.col("_cap")
    rows = rows.withColumn("_spent", F.first(F.when(lasts, F.col("_time")), ignorenulls=True).over(all_rows))
    target = F.least(F.coalesce(F.col("_spent") * F.col("weight"), F.col("_cap")), F.col("_cap").cast("double"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, *keys: str) -> DataFrame:
    """``(doc_id, *keys, size, source_size, target, taken, finish, turn)`` for every row of ``docs``.

    ``taken`` counts the words that the mix takes of the row, repeats included; ``finish`` is
    the virtual time at which its first copy is served in full, ``turn`` its place in the
    order of these times over all sources (null where nothing is taken).
    """
    rows = materialize(docs.select("doc_id", *keys, "source", words(F.col("text")).alias("size"), F.md5(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_shuffled")), "queues")
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    queue = ordered_slices(rows, ["source", "_shuffled", "doc_id", "size", *keys], "queues-sorted")
    pieces = queue.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).drop("_words")
    # one row for each source and slice: a few more than there are slices and sources
    pieces = pieces.alias("p").join(shares.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("_source"), F.col("_slice").alias("_piece"), "_ahead", "source_size", "weight", "target")
    within = Window.partitionBy("_slice", "source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    served = queue.withColumn("_sum", F.sum("size").over(within)).join(
        pieces, (F.col("_slice") == F.col("_piece")) & F.col("source").eqNullSafe(F.col("_source")))
    start = F.col("_ahead") + F.col("_sum") - F.col("size")
    cut = F.floor("target").cast("long")
    taken = sum((F.least(cut, start + c * F.col("source_size") + F.col("size"))
                 - F.least(cut, start + c * F.col("source_size")) for c in range(repeats)), F.lit(0).cast("long"))
    served = served.select("doc_id", *keys, "size", "source_size", "target", taken.alias("taken"),
                           ((start + F.col("size")) / F.col("weight")).alias("finish"), "_shuffled")
    timed = global_index(served, [F.col("taken") == 0, "finish", "_shuffled", "doc_id"], "turn")
    return timed.withColumn("turn", F.when(F.col("taken") > 0, F.col("turn"))).drop("_shuffled")
