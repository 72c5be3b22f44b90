"""Sources. A missing path or table reads as an empty one with the right schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagecatalog import schemas
from pagecatalog.defaults import CAPTURE_HOURS
from pagecatalog.functions import split_text
from pagecatalog.sources import json_arrays


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _or_empty(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return empty(spark, schema)
        raise


def read_table_files(spark: SparkSession, path: str, schema: T.StructType, parts: bool = False) -> DataFrame:
    """Parquet files under ``path``; with ``parts``, in folders below it too."""
    return _or_empty(lambda: spark.read.schema(schema).option("recursiveFileLookup", parts).parquet(path), spark, schema)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Page captures, with only the asked columns read."""
    return read_table_files(spark, path, schemas.CAPTURE)


def read_capture_files(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Captures kept as one HTML file per page; the file time is the fetch time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.html$", "")
    return files.select(
        F.concat(F.lit(base), name).alias("url"),
        F.decode("content", "UTF-8").alias("html"),
        F.col("modificationTime").alias("fetched_at"))


def fresh(captures: DataFrame, as_of: Column | str, hours: int = CAPTURE_HOURS, at: str = "fetched_at") -> DataFrame:
    """Captures younger than ``hours`` at ``as_of``; the clock is never read here."""
    as_of = F.lit(as_of).cast(captures.schema[at].dataType) if isinstance(as_of, str) else as_of
    return captures.filter(F.col(at) > as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def newest(captures: DataFrame, at: str = "fetched_at", also: DataFrame | None = None) -> DataFrame:
    """``(url, fetched_at)`` of each URL's newest capture; of the URLs of ``also`` only.

    Narrow columns only. A semi-join of the captures on both gives the pages, and leaves
    their HTML where it is while the list is short.
    """
    times = captures.select("url", at)
    if also is not None:
        times = times.join(also.select("url"), "url", "left_semi")
    return times.groupBy("url").agg(F.max(at).alias(at))


def read_url_array(spark: SparkSession, path: str, array_per_line: bool = False) -> DataFrame:
    """JSON arrays of bare strings as ``(pos, url)``, one per file or one per line.

    A file that is one array is read by as many tasks as it has splits, see
    :mod:`pagecatalog.sources.json_arrays`; an array on a line is a value in one task.
    """
    def lines() -> DataFrame:
        urls = spark.read.text(path).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "url"))
        return urls.withColumn("pos", F.col("pos").cast("long"))

    def files() -> DataFrame:
        return json_arrays.strings(spark, path).select(F.col("pos").cast("long").alias("pos"), F.col("value").alias("url"))

    return _or_empty(lines if array_per_line else files, spark, schemas.LINK)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return read_table_files(spark, path, schemas.LINK)


def read_catalog_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Catalogue as JSON Lines, or as one array of objects per file, of any size."""
    if not array_file:
        return _or_empty(lambda: spark.read.schema(schemas.CATALOG).json(path), spark, schemas.CATALOG)

    def read() -> DataFrame:
        rows = json_arrays.elements(spark, path).select(F.from_json("element", schemas.CATALOG).alias("row"))
        return rows.select("row.*")

    return _or_empty(read, spark, schemas.CATALOG)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue as CSV. The format does not tell NULL from empty text: both read as ''."""
    def read() -> DataFrame:
        rows = spark.read.schema(schemas.CATALOG_TEXT).options(
            header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        return rows.fillna("").withColumn("image_url", split_text(F.col("image_url")))

    return _or_empty(read, spark, schemas.CATALOG)


def read_catalog_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue as Parquet files, where arrays are JSON text and NULL stands for none."""
    rows = read_table_files(spark, path, schemas.CATALOG_TEXT)
    images = F.coalesce(F.from_json("image_url", "array<string>"), F.array().cast("array<string>"))
    return rows.withColumn("image_url", images)


def read_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A table, or an empty one with ``schema`` if there is none by that name."""
    return spark.table(name) if spark.catalog.tableExists(name) else empty(spark, schema)


def read_catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalogue kept as a table, where arrays are JSON text and NULL stands for none."""
    rows = read_table(spark, name, schemas.CATALOG_TEXT)
    images = F.coalesce(F.from_json("image_url", "array<string>"), F.array().cast("array<string>"))
    return rows.withColumn("image_url", images)


#: Pointers to the versions of a table, the newest has the largest ``seq``.
VERSIONS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("path", T.StringType())])


def current_version(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The table version published last under ``root``, see ``writers.publish``."""
    versions = read_table_files(spark, f"{root}/versions", VERSIONS)
    path = versions.agg(F.max_by("path", "seq").alias("path")).first()["path"]
    return spark.read.schema(schema).parquet(path) if path else empty(spark, schema)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return read_table_files(spark, path, schemas.PROGRESS, parts=True)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return read_table_files(spark, path, schemas.ERROR, parts=True)
