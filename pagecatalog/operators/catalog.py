"""Catalogue rows: flattening, upsert, keys, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from pagecatalog.functions.ordering import first_n_within, global_index


def flatten_children(records: DataFrame, children: str = "children") -> DataFrame:
    """One catalogue row per child; records without children drop out."""
    return records.select(
        F.col("id").alias("generic_id"),
        F.col("english_name").alias("generic_english_name"),
        F.col("persian_name").alias("generic_persian_name"),
        F.col("url").alias("generic_url"),
        F.explode(children).alias("child"),
    ).select("generic_id", "generic_english_name", "generic_persian_name", "generic_url",
             "child.persian_name", "child.english_name", "child.manufacturer", "child.url",
             "child.image_url")


def latest(rows: DataFrame, key: Sequence[str], newest_first: Sequence) -> DataFrame:
    """The newest row of each key."""
    return first_n_within(rows, key, newest_first, 1, "_n").drop("_n")


def upsert(base: DataFrame, update: DataFrame, key: Sequence[str], seq: str | None = None) -> DataFrame:
    """New rows replace old ones on ``key``, other old rows stay.

    ``base`` holds a key once. Where ``update`` may repeat a key, its largest ``seq``
    wins. A small update is broadcast to the anti join, and then the base is not shuffled.
    """
    new = latest(update, key, [F.desc(seq)]) if seq else update
    kept = base.join(new.select(*key), list(key), "left_anti")
    return kept.unionByName(new.select(*base.columns))


def append_rows(base: DataFrame, update: DataFrame) -> DataFrame:
    """All rows of both, no merge."""
    return base.unionByName(update)


def surrogate_key(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """A dense key 1..n in the given order."""
    return global_index(df, order, name, start=1)


def write_counted(df: DataFrame, write) -> int:
    """Run ``write(df)`` and return how many rows it wrote, counted on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def source_record(df: DataFrame) -> DataFrame:
    """Records of the second source with its defaults in place of what is missing."""
    return df.select(
        *[c for c in df.columns if c in ("id", "url")],
        "english_name",
        F.lit("").alias("persian_name"),
        F.coalesce("manufacturer", F.lit("Unknown")).alias("manufacturer"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.array().cast("array<string>").alias("combinations"),
    )
