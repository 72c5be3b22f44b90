"""Session set-up and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A task that writes to so many buckets or partitions at most has all of their files open, and does not sort its rows by
#: them. Rows are dealt out before, so one is the rule.
OPEN_FILES = {"spark__sql__maxConcurrentOutputFileWriters": "16"}

#: Of captures and keyed tables. Intermediate tables keep the session's codec: Spark plans broadcasts by
#: the size of files, and a stronger codec would make it broadcast more rows.
TABLE_COMPRESSION = "zstd"


def build_session(app: str = "pagecatalog", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for; the caller's values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # pages are large rows: keep the Arrow batches that reach Python small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster must name one that every executor reaches. Only a local-mode session,
    where driver and executors are one process, gets a temporary folder of its own.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="pagecatalog-")
    spark.conf.set(CHECKPOINT_DIR, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/pagecatalog/{tag}-{uuid.uuid4().hex}"


#: Where materialized tables lie, and the lists of the open :func:`scratch` blocks.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, tag: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Cuts the lineage in a way that survives the loss of executors, and lets later
    steps read only the columns they need. What the write shuffled is deleted when it ends.
    See :func:`discard` and :func:`scratch`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with session_conf(spark, **{SHUFFLE_CLEANUP: "true"}):
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    written = spark.read.schema(df.schema).parquet(path)
    _PATHS[written] = path
    return written


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table that :func:`materialize` returned."""
    return df in _PATHS


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in any file system that Spark reaches; False if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def move_path(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file or folder; False if there is none, or ``to`` exists."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    there = spark._jvm.org.apache.hadoop.fs.Path(to)
    return files.exists(place) and not files.exists(there) and files.rename(place, there)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables. What was made of them has to be written out already."""
    for table in tables:
        remove_path(table.sparkSession, _PATHS.pop(table))


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete what is materialized inside the block when it ends, by an error too: for work
    whose results are written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove_path(spark, path)


@contextlib.contextmanager
def session_conf(spark: SparkSession, **conf):
    """Set SQL settings for the length of a block (``__`` stands for a dot)."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
