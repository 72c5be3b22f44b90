"""What the operators share: reading documents, keys of rows, and results that are written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words; the same bytes that ``bytes.split()`` splits at.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """``rid`` and ``th`` of a row, never null; a null id is an id of its own."""
    known = (F.coalesce(doc_id, F.lit(-1)), doc_id.isNull())
    return F.xxhash64(*known, text, F.lit(1)), F.xxhash64(text, *known, F.lit(2))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and a key of the row, ``rid`` and ``th``.

    Rows that repeat an id and its text share the key, and so share every result. Other
    columns of the table are left behind, so none can clash with an operator's own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rid, th = row_key(F.col("doc_id"), text)
    return docs.select("doc_id", text.alias("text"), *more, rid.alias("rid"), th.alias("th"))


def unsigned_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % n
