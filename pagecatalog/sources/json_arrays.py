"""JSON arrays of any size, one element a row, read by as many tasks as the file has splits.

Spark cuts a text file by byte ranges at any separator. Here the separator is the quote, so a
file becomes *pieces* in order, alternately outside and inside strings, whatever the elements
are and however they are laid out. What a piece means depends on what stands before it, so
three running counts go through the pieces of a file: quotes that are not escaped (odd: inside
a string), brackets that are open, and commas between elements, which are those outside strings
with one bracket open. Each is summed inside its split, and over splits from one row per split.
An element's text is its pieces put together again.

The whole file is shuffled by split, so no task holds more than a split; a string or element of
any length may lie across splits. Only an array without a single quote (of numbers) is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagecatalog.session import materialize

_FILE, _SPLIT, _AT, _I = "file", "split", "at", "i"  # a piece's file, split and place, a part's number in it


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", '"').text(path)
    return text.select(F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_SPLIT),
                       F.monotonically_increasing_id().alias(_AT), F.lit(0).alias(_I), F.col("value").alias("part"))


def _with_count_before(parts: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over what stands before in the file. ``parts`` is read twice."""
    splits = parts.groupBy(_FILE, _SPLIT).agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(_FILE).orderBy(_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(_FILE, _SPLIT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(_FILE, _SPLIT).orderBy(_AT, _I).rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return counted.join(splits, [_FILE, _SPLIT]).withColumn(name, F.col("_inside") + F.col("_earlier")).drop("_inside", "_earlier")


def _opened(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    without = [F.length(F.regexp_replace(text, f"[{c}]", "")) for c in (r"\[{", r"\]}")]
    return without[1] - without[0]


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, element)``: the elements of the array in each file, as JSON text, from 0 on."""
    escaped = F.length(F.regexp_extract("part", r"(\\*)$", 1)) % 2
    pieces = materialize(_pieces(spark, path), "json-pieces")
    strings = _with_count_before(pieces, 1 - escaped, "quotes")
    # what is outside strings goes on in parts between commas
    outside = F.col("quotes") % 2 == 0
    cut = F.when(outside, F.split("part", ",")).otherwise(F.array("part"))
    parts = strings.select(_FILE, _SPLIT, _AT, outside.alias("outside"), cut.alias("cut"))
    parts = parts.select(_FILE, _SPLIT, _AT, "outside", F.size("cut").alias("n"), F.posexplode("cut").alias(_I, "part"))
    parts = materialize(parts, "json-parts")
    opened = F.when(F.col("outside"), _opened(F.col("part"))).otherwise(0)
    comma = F.col("outside") & (F.col(_I) < F.col("n") - 1)
    placed = _with_count_before(parts, opened, "depth").withColumn(
        "follows", F.when(comma & (F.col("depth") + opened == 1), "next").when(comma, ",").when(F.col(_I) == F.col("n") - 1, '"').otherwise(""))
    placed = materialize(placed.select(_FILE, _SPLIT, _AT, _I, "part", "follows"), "json-places")
    numbered = _with_count_before(placed, (F.col("follows") == "next").cast("int"), "pos")
    text = F.concat("part", F.when(F.col("follows") == "next", "").otherwise(F.col("follows")))
    found = numbered.groupBy(_FILE, "pos").agg(F.array_sort(F.collect_list(F.struct(_SPLIT, _AT, _I, text.alias("text")))).alias("parts"))
    found = materialize(found.select(_FILE, "pos", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("element")), "json-elements")
    # the array's own brackets, and the quote that the end of the file was taken for
    last = found.groupBy(_FILE).agg(F.max("pos").alias("last"))
    element = F.col("element")
    element = F.when(F.col("pos") == F.col("last"), F.regexp_replace(element, r'\]\s*"$', "")).otherwise(element)
    element = F.when(F.col("pos") == 0, F.regexp_replace(element, r"^\s*\[", "")).otherwise(element)
    bare = found.join(last, _FILE).select(_FILE, "pos", "last", F.trim(F.regexp_replace(element, r"^\s+|\s+$", "")).alias("element"))
    return bare.filter((F.col("last") > 0) | (F.col("element") != "")).select(_FILE, "pos", "element")


def strings(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, value)`` of arrays of strings."""
    value = F.get(F.from_json(F.concat(F.lit("["), "element", F.lit("]")), "array<string>"), 0)
    return elements(spark, path).select(_FILE, "pos", value.alias("value"))
