"""The sink with commit: what is seen after failures, aborts and replays."""

import glob
import os

import pytest
from pyspark.sql import functions as F, types as T

from pagecatalog.session import fresh_path
from pagecatalog.sources import committed
from pagecatalog.sources.committed import CommittedSink, read_committed
from pagecatalog.streaming import streams as S

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


@pytest.fixture
def root(spark):
    spark.dataSource.register(CommittedSink)
    return fresh_path(spark, "committed-test")


def rows(spark, low, high, parts=3):
    return spark.range(low, high, 1, parts).select("id", F.concat(F.lit("نام "), "id").alias("name"), F.array(F.lit("a"), F.lit(None)).alias("tags"))


def seen(spark, root):
    return sorted(r.id for r in read_committed(spark, root, SCHEMA).collect())


def save(df, root, **options):
    df.write.format("committed").mode(options.pop("mode", "append")).options(**options).save(root)


def test_rows_come_back_whole(spark, root):
    assert seen(spark, root) == []
    save(rows(spark, 0, 100), root)
    save(rows(spark, 100, 100), root)  # no rows at all
    save(rows(spark, 100, 110), root)
    got = read_committed(spark, root, SCHEMA)
    assert seen(spark, root) == list(range(110)) and got.filter("id = 7").first()[:] == (7, "نام 7", ["a", None])
    save(rows(spark, 5, 7), root, mode="overwrite")
    assert seen(spark, root) == [5, 6]


def test_a_task_that_dies_leaves_nothing(spark, root):
    save(rows(spark, 0, 10), root)
    broken = rows(spark, 10, 3000).withColumn("name", F.when(F.col("id") == 2900, F.raise_error(F.lit("half-way"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="half-way"):
        save(broken, root)
    assert seen(spark, root) == list(range(10))


def test_a_named_write_takes_effect_once(spark, root):
    save(rows(spark, 0, 10), root, commit="first")
    save(rows(spark, 0, 50), root, commit="first")
    save(rows(spark, 10, 12), root, commit="second")
    assert seen(spark, root) == list(range(12))
    named = {os.path.basename(p) for p in glob.glob(f"{root}/data/*.parquet")}
    assert len(named) == 3 + 2  # the files of the write that came too late are gone


def test_abort_removes_what_tasks_wrote(spark, root):
    message = committed._write_task(root, iter(rows(spark, 0, 5).toArrow().to_batches()), 100)
    assert message.rows == 5 and len(glob.glob(f"{root}/data/*")) == 1 and seen(spark, root) == []
    committed._Writer({"path": root}, overwrite=False).abort([message, None])
    assert glob.glob(f"{root}/data/*") == []


def test_a_replayed_batch_changes_nothing(spark, root):
    for low in (0, 10, 20):
        rows(spark, low, low + 10, 1).write.mode("append").parquet(f"{root}-in")

    def run(checkpoint):
        stream = S.read_stream(spark, f"{root}-in", SCHEMA, files_per_batch=1)
        stream.writeStream.format("committed").option("path", root).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start().awaitTermination()

    run(f"{root}-cp")
    assert seen(spark, root) == list(range(30))
    run(f"{root}-cp")
    run(f"{root}-lost")  # a new checkpoint runs all batches again under their numbers
    assert seen(spark, root) == list(range(30)) and len(glob.glob(f"{root}/data/*.parquet")) == 3
