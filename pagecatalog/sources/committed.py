"""A sink of one's own with commit: files that are seen all together or not at all.

Tasks write Parquet files of their own under a name no one lists. Their messages say which
files these are; the driver's commit names them in one small file, and only files that such a
commit names are read. A task that dies, or a job that is aborted, so leaves nothing that can
be seen. A streaming batch commits under its number, and when it is replayed its first commit
stands.

Register with ``spark.dataSource.register(CommittedSink)`` and write with
``df.write.format("committed")`` or ``df.writeStream.format("committed")``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from pagecatalog.sources import readers

COMMITS = "_commits"


@dataclass
class TaskFiles(WriterCommitMessage):
    """What one task wrote; no path if it had no rows."""

    path: str | None
    rows: int


def _file_system(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Where a path lies, as every executor sees it."""
    if "://" not in root and root.startswith("file:"):
        root = "file://" + root.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(root)


def _write_task(root: str, batches: Iterator[pa.RecordBatch], rows_per_file: int) -> TaskFiles:
    """One file per task, written as its batches come; memory holds one batch."""
    files, base = _file_system(root)
    path, writer, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(f"{base}/data", recursive=True)
                writer = pq.ParquetWriter(f"{base}/{path}", batch.schema, filesystem=files)
            writer.write_batch(batch, row_group_size=rows_per_file)
            rows += batch.num_rows
    finally:
        if writer is not None:
            writer.close()
    return TaskFiles(path if rows else None, rows)


def _commit(root: str, name: str, messages: list[TaskFiles | None]) -> bool:
    """Name the files of a job; False if it was committed before."""
    files, base = _file_system(root)
    files.create_dir(f"{base}/{COMMITS}", recursive=True)
    target = f"{base}/{COMMITS}/{name}.json"
    if files.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
        return False
    listed = [{"path": m.path, "rows": m.rows} for m in messages if m is not None and m.path]
    with files.open_output_stream(f"{base}/{COMMITS}/.{name}") as out:  # readers skip hidden files
        out.write("\n".join(json.dumps(x) for x in listed).encode())
    files.move(f"{base}/{COMMITS}/.{name}", target)
    return True


def _remove(root: str, messages: list[TaskFiles | None]) -> None:
    files, base = _file_system(root)
    for m in messages:
        if m is not None and m.path and files.get_file_info(f"{base}/{m.path}").type != pyarrow.fs.FileType.NotFound:
            files.delete_file(f"{base}/{m.path}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.name = options.get("commit", uuid.uuid4().hex)
        self.rows_per_file = int(options.get("rowgroup", 100_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        return _write_task(self.root, iterator, self.rows_per_file)

    def commit(self, messages: list[TaskFiles | None]) -> None:
        files, base = _file_system(self.root)
        before = [] if not self.overwrite else [
            f.path for f in files.get_file_info(pyarrow.fs.FileSelector(f"{base}/{COMMITS}", allow_not_found=True)) if f.path.endswith(".json")]
        if not _commit(self.root, self.name, messages):
            _remove(self.root, messages)
        for path in before:
            files.delete_file(path)

    def abort(self, messages: list[TaskFiles | None]) -> None:
        _remove(self.root, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.root, self.rows_per_file = options["path"], int(options.get("rowgroup", 100_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        return _write_task(self.root, iterator, self.rows_per_file)

    def commit(self, messages: list[TaskFiles | None], batchId: int) -> None:
        if not _commit(self.root, f"batch-{batchId:015d}", messages):
            _remove(self.root, messages)

    def abort(self, messages: list[TaskFiles | None], batchId: int) -> None:
        _remove(self.root, messages)


class CommittedSink(DataSource):
    """Options: ``path``, a folder every executor reaches; ``commit``, a name under which a batch
    write takes effect once, however often it is run."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> T.StructType:
        raise NotImplementedError("read with read_committed")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options))


def read_committed(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed files. The names of the files pass through the driver."""
    listed = T.StructType([T.StructField("path", T.StringType()), T.StructField("rows", T.LongType())])
    try:
        commits = spark.read.schema(listed).json(f"{root}/{COMMITS}")
        paths = [f"{root}/{r['path']}" for r in commits.filter("path is not null").select("path").collect()]
    except readers.AnalysisException:
        paths = []
    return spark.read.schema(schema).parquet(*paths) if paths else readers.empty(spark, schema)
