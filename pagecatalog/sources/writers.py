"""Sinks. All writes are distributed; none passes rows through the driver."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from pagecatalog import schemas
from pagecatalog.functions import array_to_json, capture_key, join_array
from pagecatalog.session import OPEN_FILES, TABLE_COMPRESSION, move_path, remove_path, session_conf
from pagecatalog.sources import readers

log = logging.getLogger(__name__)

#: Names repeat in every row of JSON and addresses in every row of both text formats: plain files are
#: many times the size. Readers know the codec by the files' suffix.
TEXT_COMPRESSION = "gzip"


def write_catalog_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, UTF-8, arrays kept; NULLs are written so that every row has all fields."""
    df.write.mode(mode).options(ignoreNullFields=False, compression=TEXT_COMPRESSION).json(path)


def write_catalog_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays as ``'; '``-joined text, NULL and empty as nothing."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    df.withColumns({c: join_array(F.col(c)) for c in arrays}).write.mode(mode).options(
        header=True, quote='"', escape='"', emptyValue="", nullValue="", encoding="UTF-8", compression=TEXT_COMPRESSION,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def as_table_rows(df: DataFrame, empty_as_null: bool = True) -> DataFrame:
    """Arrays as JSON text."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: array_to_json(F.col(c), empty_as_null) for c in arrays})


def write_catalog_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    as_table_rows(df).write.mode(mode).parquet(path)


def write_catalog_table(df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite") -> None:
    """A catalogue table; with ``path`` its files are kept there."""
    writer = as_table_rows(df).write.mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


Sink = Callable[[DataFrame, str, str], None]

SINKS: dict[str, Sink] = {
    "json": write_catalog_json,
    "csv": write_catalog_csv,
    "parquet": write_catalog_parquet,
    "duckdb": write_catalog_parquet,  # any engine can query the files
}


Load = Callable[[SparkSession, str], DataFrame]

LOADS: dict[str, Load] = {
    "json": readers.read_catalog_json,
    "csv": readers.read_catalog_csv,
    "parquet": readers.read_catalog_parquet,
    "duckdb": readers.read_catalog_parquet,
}


def register_sink(name: str, sink: Sink, load: Load | None = None) -> None:
    """Make ``sink(df, path, mode)`` selectable by name; with ``load(spark, path)``, what it
    wrote can be read back and merged into."""
    SINKS[name.lower()] = sink
    if load is not None:
        LOADS[name.lower()] = load


def load_catalog(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """A catalogue in a format by name; nothing there reads as no rows."""
    move_path(spark, _aside(path), path)  # a merge that died between its two renames
    return LOADS[fmt.lower()](spark, path)


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.before"


def merge_catalog(df: DataFrame, fmt: str, path: str, key: tuple[str, ...] = ("generic_url",)) -> DataFrame:
    """Write a catalogue over what the path holds: rows of the same ``key`` are replaced as a
    whole, others stay. Returns what the path holds then.

    The merged rows are written beside the path and take its place by renaming, so a run that
    dies leaves the old rows or the new ones.
    """
    spark = df.sparkSession
    kept = load_catalog(spark, fmt, path).join(df.select(*key).distinct(), list(key), "left_anti")
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    SINKS[fmt.lower()](kept.select(*df.columns).unionByName(df), fresh, "overwrite")
    remove_path(spark, _aside(path))
    move_path(spark, path, _aside(path))
    move_path(spark, fresh, path)
    remove_path(spark, _aside(path))
    return load_catalog(spark, fmt, path)


def write_catalog(df: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> str:
    """Write in a format by name, in any case. An unknown name means JSON, and so does a
    format whose engine the session lacks. Returns the format written."""
    name = fmt.lower() if fmt.lower() in SINKS else "json"
    try:
        SINKS[name](df, path, mode)
    except (AnalysisException, ImportError) as error:
        if name == "json":
            raise
        log.warning("format %s failed, writing JSON instead: %s", name, error)
        name = "json"
        write_catalog_json(df, path, mode)
    return name


def fan_out(df: DataFrame, root: str, formats: tuple[str, ...] = ("json", "csv", "parquet")) -> bool:
    """The same result in several formats; nothing if it is empty. Write a costly ``df`` out
    first: it is computed once per format."""
    if df.isEmpty():
        return False
    for fmt in formats:
        write_catalog(df, fmt, f"{root}/{fmt}")
    return True


def replace_all(df: DataFrame, root: str) -> None:
    """Replace a table's rows, also when ``df`` reads that table."""
    publish(df, root)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> bool:
    """Create the table if it is absent; True if it was."""
    if spark.catalog.tableExists(name):
        return False
    options = {"path": path} if path else {}
    spark.catalog.createTable(name, source="parquet", schema=schema, **options)
    return True


def publish(df: DataFrame, root: str, version: str | None = None) -> str:
    """Write a new version of a table, then point readers to it.

    The old version stays readable until the new one is whole, and a job may read the
    table that it replaces. A named version is overwritten when its step is replayed.
    """
    path = f"{root}/data/{version or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    pointer = df.sparkSession.range(1).select(
        F.lit(time.time_ns()).alias("seq"), F.lit(path).alias("path"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def retire_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions that :func:`publish` wrote; returns how many went."""
    pointers = readers.read_table_files(spark, f"{root}/versions", readers.VERSIONS)
    newest = pointers.groupBy("path").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"))
    old = [r["path"] for r in newest.collect()[keep:]]
    return sum(remove_path(spark, path) for path in old)


def retire_captures(spark: SparkSession, path: str) -> list[str]:
    """Delete the fetch dates of :func:`write_captures` of which every capture was superseded by a
    later one of its URL; returns these dates. Reads addresses and times, no HTML."""
    times = spark.read.parquet(path).select("url", "fetched_at", "fetch_date")
    needed = times.groupBy("url").agg(F.max_by("fetch_date", "fetched_at").alias("fetch_date")).select("fetch_date").distinct()
    gone = times.select("fetch_date").distinct().join(needed, "fetch_date", "left_anti")
    dates = [str(r["fetch_date"]) for r in gone.orderBy("fetch_date").collect()]
    for date in dates:
        remove_path(spark, f"{path}/fetch_date={date}")
    return dates


def write_links(links: DataFrame, path: str) -> None:
    """A list of links with their positions."""
    links.select(F.col("pos").cast("long").alias("pos"), "url").write.mode("overwrite").parquet(path)


def write_progress(progress: DataFrame, path: str, part: str | None = None) -> None:
    """Append progress records; a named part replaces what it held, so a rerun adds nothing."""
    rows = progress.select(*schemas.PROGRESS.fieldNames())
    rows.write.mode("overwrite" if part else "append").parquet(f"{path}/{part}" if part else path)


def write_errors(errors: DataFrame, path: str, part: str | None = None) -> bool:
    """Append to the error ledger, or replace a part of it; True if there were errors, which
    are counted as they are written."""
    seen = Observation()
    errors.select("url", "error").observe(seen, F.count(F.lit(1)).alias("rows")) \
        .write.mode("overwrite" if part else "append").parquet(f"{path}/{part}" if part else path)
    return seen.get["rows"] > 0


def with_capture_key(captures: DataFrame) -> DataFrame:
    return captures.withColumn("key", capture_key(F.col("url")))


# Pages are costly per row: files of this many rows keep a scan's tasks even.
CAPTURES_PER_FILE = 10_000


def write_captures(captures: DataFrame, path: str) -> None:
    """Append captures under their key, in one folder per fetch date."""
    keyed = with_capture_key(captures).withColumn("fetch_date", F.to_date("fetched_at"))
    keyed.write.mode("append").option("maxRecordsPerFile", CAPTURES_PER_FILE) \
        .partitionBy("fetch_date").parquet(path)


#: Pages of one bucket, which one task reads, at most; and the least number of buckets.
PAGES_PER_BUCKET, LEAST_BUCKETS = 150_000, 16


def capture_buckets(pages: int) -> int:
    """Buckets for so many captures: their number grows with the table, a task's share does not."""
    return max(LEAST_BUCKETS, -(-pages // PAGES_PER_BUCKET))


def write_capture_table(captures: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Captures as a table in buckets by URL, for jobs that join them to URL lists.

    A list of any length then comes to the captures; the HTML itself is never shuffled.
    """
    writer = captures.repartition(buckets, "url").write.mode("overwrite").format("parquet") \
        .options(maxRecordsPerFile=CAPTURES_PER_FILE, compression=TABLE_COMPRESSION).bucketBy(buckets, "url")
    with session_conf(captures.sparkSession, **OPEN_FILES):
        (writer.option("path", path) if path else writer).saveAsTable(name)


def image_path(folder: str, record: Column, image_url: Column, status: Column, content_type: Column) -> Column:
    """Where an image is stored; NULL without an address or with a status other than 200."""
    ext = F.when(F.contains(F.coalesce(content_type, F.lit("")), F.lit("png")), "png").otherwise("jpg")
    usable = (F.coalesce(image_url, F.lit("")) != "") & (status == 200)
    return F.when(usable, F.concat(F.lit(f"{folder}/images/"), record, F.lit("."), ext))
