"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_STRINGS = T.ArrayType(T.StringType())


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


CAPTURE = T.StructType([*_strings("url", "html"), T.StructField("fetched_at", T.TimestampType())])

CHILD = T.StructType([
    *_strings("persian_name", "english_name", "manufacturer", "url"),
    T.StructField("image_url", _STRINGS),
])

RECORD = T.StructType([
    *_strings("id", "english_name", "persian_name", "manufacturer", "image_path"),
    T.StructField("combinations", _STRINGS),
    *_strings("url"),
    T.StructField("children", T.ArrayType(CHILD)),
])

# The column names of the flat record. One row per child, the parent's four
# columns first.
CATALOG = T.StructType([
    *_strings("generic_id", "generic_english_name", "generic_persian_name", "generic_url",
              "persian_name", "english_name", "manufacturer", "url"),
    T.StructField("image_url", _STRINGS),
])

# The same row where a format has no arrays: '; '-joined text or JSON text.
CATALOG_TEXT = T.StructType([*CATALOG.fields[:-1], T.StructField("image_url", _S)])

SOURCE_RECORD = T.StructType([
    T.StructField("id", T.LongType()),
    *_strings("english_name", "persian_name", "manufacturer", "description", "image_url"),
    T.StructField("combinations", _STRINGS),
])

LINK = T.StructType([T.StructField("pos", T.LongType()), *_strings("url")])

ATTEMPTED = T.StructType(_strings("url"))

ERROR = T.StructType(_strings("url", "error"))

PROGRESS = T.StructType([
    T.StructField("batch_no", T.LongType()),
    T.StructField("current_index", T.LongType()),
    T.StructField("total_links", T.LongType()),
    T.StructField("stats", T.StructType([
        T.StructField("total_processed", T.LongType()),
        T.StructField("successful", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("retried", T.LongType()),
        T.StructField("batch_times", T.ArrayType(T.DoubleType())),
        T.StructField("start_time", T.DoubleType()),
    ])),
    T.StructField("last_update", T.DoubleType()),
])

FETCH_LOG = T.StructType([
    *_strings("url"),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("elapsed", T.DoubleType()),
    *_strings("error"),
    T.StructField("ts", T.TimestampType()),
])

IMAGE_CANDIDATE = T.StructType([*_strings("query"), T.StructField("rank", T.IntegerType()), *_strings("image")])
