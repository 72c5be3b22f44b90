"""JSON arrays cut at any byte against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagecatalog import schemas
from pagecatalog.session import session_conf
from pagecatalog.sources import json_arrays, readers

STRINGS = ["http://a/1", "", 'quote " in', "back\\slash", "ends with \\", '\\"', "comma, bracket ] { } [", "نمونه 😀", "line\nbreak\ttab", "x" * 300, " "]
OBJECTS = [{"a": 1, "b": [1, 2, {"c": "x, y]"}], "d": None}, {}, {"a": 'q"}, {"a'}, {"e": {"f": ["[", "{", '"']}}, {"a": 1.5e3, "b": []}]


def split_read(spark, file, size):
    """The elements of a file read in splits of so many bytes."""
    with session_conf(spark, spark__sql__files__maxPartitionBytes=size, spark__sql__files__openCostInBytes=1,
                      spark__sql__files__minPartitionNum=64):
        return [json.loads(r.element) for r in json_arrays.elements(spark, str(file)).orderBy("file", "pos").collect()]


@pytest.mark.parametrize("size", [7, 64, 10_000])
@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_elements_equal_the_whole_read(spark, tmp_path, size, indent, ascii_only):
    rng = random.Random(size)
    values = [rng.choice(STRINGS + OBJECTS + [None, True, 12, -3.5, [], ["a", ["b, c"]]]) for _ in range(40)]
    file = tmp_path / "array.json"
    file.write_text(json.dumps(values, indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    assert split_read(spark, file, size) == values


def test_borders(spark, tmp_path):
    for i, text in enumerate(["[]", " [ ] \n", '["one"]', "[1,2, 3]", '[""]', "[null]", '[["a"],["b"]]', '["a",null,"b"]', "[{}]"]):
        file = tmp_path / f"{i}.json"
        file.write_text(text)
        assert split_read(spark, file, 2) == json.loads(text)
    assert readers.read_url_array(spark, str(tmp_path / "[25].json")).count() == 2  # one, none


def test_a_list_of_urls_is_read_by_many_tasks(spark, tmp_path):
    urls = [f"http://site.example/{i}/\"quoted\"/{'p' * (i % 50)}" for i in range(20_000)]
    file = tmp_path / "links.json"
    file.write_text(json.dumps(urls, indent=4))
    with session_conf(spark, spark__sql__files__maxPartitionBytes=64 * 1024):
        assert json_arrays._pieces(spark, str(file)).rdd.getNumPartitions() > 8
        got = readers.read_url_array(spark, str(file))
        assert [r.url for r in got.orderBy("pos").collect()] == urls
    assert got.agg(F.max("pos"), F.count_distinct("pos")).first()[:] == (19_999, 20_000)


def test_catalogue_array(spark, tmp_path):
    names = schemas.CATALOG.fieldNames()
    rows = [(str(i), None, "نمونه", f"u{i}", "{", "}", '", "', "[", ["u1", "u]2"]) for i in range(30)]
    file = tmp_path / "catalog.json"
    file.write_text(json.dumps([dict(zip(names, r)) for r in rows], indent=1), encoding="utf-8")
    with session_conf(spark, spark__sql__files__maxPartitionBytes=200, spark__sql__files__openCostInBytes=1):
        got = readers.read_catalog_json(spark, str(file), array_file=True)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
