"""Intermediate tables: kept, discarded, and deleted with a block."""

import os
import time

import pytest

from pagecatalog.session import discard, fresh_path, materialize, move_path, remove_path, scratch


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://").replace("file:", ""))


def test_discard_deletes_one_table(spark):
    one, two = (materialize(spark.range(3), "kept") for _ in range(2))
    places = [folder(one), folder(two)]
    discard(one)
    assert [os.path.exists(p) for p in places] == [False, True] and two.count() == 3


def test_scratch_deletes_what_its_block_made(spark):
    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        outer = folder(materialize(spark.range(3), "outer"))
        with scratch(spark):
            inner = folder(materialize(spark.range(3), "inner"))
        assert os.path.exists(outer) and not os.path.exists(inner)
    assert not os.path.exists(outer) and kept.count() == 3
    with pytest.raises(ZeroDivisionError):
        with scratch(spark):
            lost = folder(materialize(spark.range(3), "lost"))
            raise ZeroDivisionError
    assert not os.path.exists(lost)


def test_paths_move_and_go(spark):
    path = fresh_path(spark, "move")
    spark.range(1).write.parquet(path)
    assert not move_path(spark, f"{path}-absent", f"{path}-to") and move_path(spark, path, f"{path}-to")
    spark.range(2).write.parquet(path)
    assert not move_path(spark, path, f"{path}-to")  # never over what is there
    assert remove_path(spark, path) and not remove_path(spark, path) and spark.read.parquet(f"{path}-to").count() == 1


def test_what_a_materialized_table_shuffled_is_deleted(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    before = shuffled()
    kept = materialize(spark.range(1000).repartition(3, "id"), "shuffled")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert kept.count() == 1000
