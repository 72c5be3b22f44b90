import random

import pytest
from pyspark.sql import Window, functions as F

from pagecatalog.functions.ordering import first_n_within, global_index, rank_within, running_totals
from pagecatalog.session import session_conf


@pytest.fixture(params=[1, 7])
def slices(spark, request):
    """With coalescing off, even small data spreads over several slices."""
    with session_conf(spark, spark__sql__shuffle__partitions=request.param,
                      spark__sql__adaptive__coalescePartitions__enabled="false"):
        yield request.param


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows have one key; some have none."""
    rng = random.Random(1)
    keys = ["hot"] * 500 + [f"k{i % 60}" for i in range(450)] + [None] * 50
    rng.shuffle(keys)
    return spark.createDataFrame([(k, i, rng.randint(1, 9)) for i, k in enumerate(keys)], "k string, i int, v int") \
        .repartition(5).cache()


def test_global_index(skewed, slices):
    got = global_index(skewed, [F.desc("i")], "idx", start=1).collect()
    assert {r.i: r.idx for r in got} == {i: 1000 - i for i in range(1000)}


def test_rank_within_a_hot_key(skewed, slices):
    got = rank_within(skewed, ["k"], ["v", "i"], "rank")
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_totals(skewed, slices):
    got = {r.i: (r.s, r.n) for r in running_totals(skewed, ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    total = 0
    for row in sorted(skewed.collect(), key=lambda r: r.i):
        total += row.v
        assert got[row.i] == (total, row.i + 1)


def test_no_rows(skewed, slices):
    nothing = skewed.filter("i < 0")
    assert global_index(nothing, ["i"]).count() == 0
    assert rank_within(nothing, ["k"], ["i"]).count() == 0
    assert running_totals(nothing, ["i"], {"s": F.col("v")}).count() == 0


def test_first_n_limits_before_the_shuffle(skewed):
    top = first_n_within(skewed, ["k"], ["i"], 3)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
