"""Positions in a global order, without passing the rows through one task.

A window with no ``partitionBy`` sorts everything in one task, and a window over a hot
key sorts that key in one task. Here rows are range-partitioned by (keys, order), sorted
inside each slice and written out with the slice number and the row number in it. What
is left to combine is one small row per slice, or per key and slice.

The order must be unique, or positions of tied rows are arbitrary. The input is read
twice (range bounds are sampled first): materialize costly inputs before the call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagecatalog.session import materialize

_SLICE, _ROW = "_slice", "_row"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row in partition below


def _as_columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def ordered_slices(df: DataFrame, order: Sequence[str | Column], tag: str = "slices") -> DataFrame:
    """``df`` written as ordered slices, with ``_slice`` and ``_row`` (from 0) added."""
    order = _as_columns(order)
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    located = (ranged
               .withColumn(_SLICE, F.shiftright("_at", _LOCAL_BITS))
               .withColumn(_ROW, F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
               .drop("_at"))
    return materialize(located, tag)


def _slice_offsets(slices: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per slice, the totals over all slices before it. One row per slice, at most the
    number of shuffle partitions, so one task and a broadcast are enough."""
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.groupBy(_SLICE).agg(*[c.alias(n) for n, c in totals.items()])
    return sums.select(_SLICE, *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in totals])


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx",
                 start: int = 0) -> DataFrame:
    """Dense 0-based (or ``start``-based) index of every row in the given order."""
    slices = ordered_slices(df, order, "index")
    offsets = _slice_offsets(slices, {"rows": F.count(F.lit(1))})
    return (slices.join(F.broadcast(offsets), _SLICE)
            .withColumn(name, F.col("_before_rows") + F.col(_ROW) + F.lit(start).cast("long"))
            .drop(_SLICE, _ROW, "_before_rows"))


def running_totals(df: DataFrame, order: Sequence[str | Column], values: dict[str, Column]) -> DataFrame:
    """Running sums, ``{new column: value}``, over all rows in the given order."""
    slices = ordered_slices(df, order, "running")
    totals = {n: F.sum(v) for n, v in values.items()}
    inside = Window.partitionBy(_SLICE).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    summed = slices.select("*", *[F.sum(v).over(inside).alias(f"_in_{n}") for n, v in values.items()])
    joined = summed.join(F.broadcast(_slice_offsets(slices, totals)), _SLICE)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in values])


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                name: str = "rank") -> DataFrame:
    """1-based rank of every row inside its key, for keys of any size.

    A key that spans several slices adds up the slices before; the join is on key and
    slice, so no task holds more of a hot key than one slice of it.
    """
    slices = ordered_slices(df, [*keys, *order], "rank")
    keys = list(keys)
    pieces = slices.groupBy(*keys, _SLICE).agg(
        F.count(F.lit(1)).alias("_n"), F.min(_ROW).alias("_first"))
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_SLICE).alias("_k_slice"),
                           "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    on = F.col(_SLICE) == F.col("_k_slice")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    ranked = slices.join(pieces, on)
    return ranked.select(
        *[F.col(c) for c in df.columns],
        (F.col(_ROW) - F.col("_first") + F.col("_earlier") + 1).alias(name))


def first_n_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                   name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key. Spark limits every key to ``n`` rows per map task
    before the shuffle (WindowGroupLimit), so a hot key arrives small."""
    ranked = df.withColumn(name, F.row_number().over(
        Window.partitionBy(*keys).orderBy(*_as_columns(order))))
    return ranked.filter(F.col(name) <= n)
