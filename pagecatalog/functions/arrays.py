"""Array columns as text and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagecatalog.defaults import ARRAY_SEPARATOR


def join_array(values: Column) -> Column:
    """``'; '``-joined text; NULL and empty arrays give ``''``. NULL items are skipped."""
    return F.coalesce(F.array_join(values, ARRAY_SEPARATOR), F.lit(""))


def split_text(text: Column) -> Column:
    """The inverse of :func:`join_array`; lossy when a value itself holds ``'; '``."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.split(text, ARRAY_SEPARATOR)) \
        .otherwise(F.array().cast("array<string>"))


def array_to_json(values: Column, empty_as_null: bool = True) -> Column:
    """JSON text. Empty and NULL arrays give NULL, or ``[]`` when ``empty_as_null`` is off."""
    if empty_as_null:
        return F.when(F.size(values) > 0, F.to_json(values))
    return F.coalesce(F.to_json(values), F.lit("[]"))
