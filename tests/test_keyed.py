"""The keyed table against a dictionary of rows, and what its saves write."""

import os
import random

import pytest
from pyspark.sql import types as T

from pagecatalog.session import fresh_path
from pagecatalog.sources import keyed, writers
from pagecatalog.sources.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("n", T.LongType()), T.StructField("body", T.StringType())])


@pytest.fixture
def table(spark):
    return KeyedTable(spark, fresh_path(spark, "keyed-test"), SCHEMA, ("url",), buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, path):
    """Bytes and names of the files below a path."""
    if not os.path.exists(path):
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return {r.path: r.length for r in files.select("path", "length").collect()}


def test_saves_equal_a_dictionary(spark, table):
    rng = random.Random(4)
    held: dict = {}
    assert table.read().count() == 0 and table.version() == 0
    for turn in range(12):
        keys = [rng.choice([None, *(f"u{i}" for i in range(30))]) for _ in range(rng.choice([0, 1, 5, 25]))]
        rows = [(k, turn * 100 + i, f"{k}") for i, k in enumerate(keys)]
        gone = [f"u{i}" for i in rng.sample(range(30), rng.choice([0, 0, 6]))]
        for k in [*keys, *gone]:
            held.pop(k, None)
        for row in rows:
            held.setdefault(row[0], []).append(row)
        assert table.save(frame(spark, rows), frame(spark, [(g, 0, "") for g in gone])) == turn + 1
        want = sorted((r for found in held.values() for r in found), key=str)
        assert sorted(map(tuple, table.read().collect()), key=str) == want
    assert max(len([s for s in table.manifest()[1] if s.bucket == b]) for b in range(8)) > 1
    table.fold()
    assert sorted(map(tuple, table.read().collect()), key=str) == want
    assert all(s.keys_path is None for s in table.manifest()[1])


def test_a_save_of_one_per_cent_writes_about_one_per_cent(spark, table):
    body = "".join(random.Random(1).choices("abcdefgh", k=200))
    whole = spark.range(20_000).selectExpr("concat('u', id) url", "id n", f"concat(sha2(cast(id as string), 512), '{body}') body")
    table.save(whole)
    first = stored(spark, f"{table.root}/data")
    for turn in range(3):
        table.save(whole.filter(f"n % 100 = {turn}").selectExpr("url", "n + 1 n", "reverse(body) body"))
    later = {p: n for p, n in {**stored(spark, f"{table.root}/data"), **stored(spark, f"{table.root}/gone")}.items() if p not in first}
    assert sum(later.values()) / 3 < 0.03 * sum(first.values())
    assert set(first) <= set(stored(spark, f"{table.root}/data"))  # nothing of the first save was rewritten
    assert table.read().count() == 20_000
    assert table.read().filter("url <> concat('u', n)").count() == 600


def test_an_outgrown_bucket_is_rewritten_alone(spark, table):
    table.save(frame(spark, [(f"u{i}", i, "x") for i in range(400)]))
    one = [s.bucket for s in table.manifest()[1]][0]
    inside = table.read().withColumn("b", table._bucket_of(8)).filter(f"b = {one}").drop("b").collect()
    table.save(frame(spark, [(r.url, -1, "y") for r in inside]))
    assert [s.seq for s in table.manifest()[1] if s.bucket == one] == [1, 2]  # as large as the first set by now
    table.save(frame(spark, [(r.url, -2, "z") for r in inside]))
    sets = table.manifest()[1]
    assert [s.seq for s in sets if s.bucket == one] == [3] and {s.seq for s in sets if s.bucket != one} == {1}
    assert table.read().filter("n = -2").count() == len(inside) and table.read().count() == 400


def test_at_most_so_many_sets(spark, table):
    table.save(frame(spark, [(f"u{i}", i, "x") for i in range(2000)]))
    for i in range(keyed.MAX_SETS + 2):
        table.save(frame(spark, [("u1", -i, "y")]))
    counts = [sum(s.bucket == b for s in table.manifest()[1]) for b in range(8)]
    assert max(counts) <= keyed.MAX_SETS and table.read().count() == 2000


def test_retirement_keeps_what_readers_need(spark, table):
    opened = {}
    for turn in range(10):
        table.save(frame(spark, [(f"u{i}", turn, "x" * 50) for i in range(40)]))
        if turn == 3:
            table.pin("report")
        opened[turn + 1] = table.read()
    assert table.retire(keep=2) > 0
    for version in (4, 9, 10):
        assert {r.n for r in opened[version].collect()} == {version - 1} == {r.n for r in table.read(version).collect()}
    with pytest.raises(Exception):
        opened[6].collect()
    listed = {p for v in (4, 9, 10) for s in table.manifest(v)[1] for p in (s.rows_path, s.keys_path) if p}
    kept = {p.split(":", 1)[-1].rsplit("/", 1)[0].replace("//", "/") for p in [*stored(spark, f"{table.root}/data"), *stored(spark, f"{table.root}/gone")]}
    assert kept == listed
    table.unpin("report")
    table.retire(keep=1)
    assert table.read().count() == 40 and len(stored(spark, f"{table.root}/manifest")) == 1


def test_a_save_that_dies_is_not_seen(spark, table, monkeypatch):
    table.save(frame(spark, [("a", 1, "x"), ("b", 1, "x")]))
    monkeypatch.setattr(keyed, "asdict", lambda s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.save(frame(spark, [("a", 2, "y"), ("c", 2, "y")]))
    monkeypatch.undo()
    assert sorted(r.url for r in table.read().collect()) == ["a", "b"] and table.version() == 1
    table.save(frame(spark, [("a", 3, "z")]))
    assert {(r.url, r.n) for r in table.read().collect()} == {("a", 3), ("b", 1)}


def test_versions_and_captures_are_retired(spark):
    root = fresh_path(spark, "retire-test")
    for i in range(10):
        writers.publish(frame(spark, [("u", i, "x")]), root)
    assert writers.retire_versions(spark, root, keep=2) == 8 and len({p.rsplit("/", 2)[-2] for p in stored(spark, f"{root}/data")}) == 2
    captures = spark.createDataFrame(
        [("a", "1", "2024-01-01"), ("b", "1", "2024-01-01"), ("a", "2", "2024-01-02"), ("a", "3", "2024-01-03"), ("b", "3", "2024-01-03"), ("c", "2", "2024-01-02")],
        "url string, html string, t string").selectExpr("url", "html", "cast(t as timestamp) fetched_at")
    writers.write_captures(captures, f"{root}/captures")
    assert writers.retire_captures(spark, f"{root}/captures") == ["2024-01-01"]
    assert spark.read.parquet(f"{root}/captures").count() == 4


def test_merge_takes_the_place_by_renaming(spark):
    from pagecatalog import schemas

    path = fresh_path(spark, "merge-test")
    row = lambda url, n: (n, "e", "p", url, "", "", "", "u", ["i"])
    for turn in range(3):
        df = spark.createDataFrame([row("same", str(turn)), row(f"own {turn}", "x")], schemas.CATALOG)
        merged = writers.merge_catalog(df, "json", path)
    assert sorted((r.generic_url, r.generic_id) for r in merged.collect()) == [("own 0", "x"), ("own 1", "x"), ("own 2", "x"), ("same", "2")]
    writers.move_path(spark, path, writers._aside(path))  # died between two renames
    assert writers.load_catalog(spark, "json", path).count() == 4


def test_a_save_ahead_of_a_reading_leaves_nothing_to_join(spark, table):
    table.save(frame(spark, [(f"u{i}", i, "x") for i in range(400)]))
    table.save(frame(spark, [("u1", -1, "y")]), frame(spark, [("u1", 0, ""), ("u2", 0, "")]), covered=True, ahead=True)
    assert {s.seq for s in table.manifest()[1]} == {1, 2}  # a small change is laid over
    rows = [(f"u{i}", -i, "z") for i in range(2, 400)]
    table.save(frame(spark, rows), frame(spark, [(f"u{i}", 0, "") for i in range(400)]), covered=True, ahead=True)
    sets = table.manifest()[1]
    assert {s.seq for s in sets} == {3} and all(s.keys_path is None for s in sets)
    assert "Join" not in table.read()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.url, r.n) for r in table.read().collect()) == sorted((u, n) for u, n, _ in rows)
