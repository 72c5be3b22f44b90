"""Language and quality: held-out accuracy, and the cases that have no sensible answer."""

import random
import zlib

import numpy as np
import pandas as pd

from pagecatalog.llm import language_id, quality, queries
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_on_held_out_rows(spark):
    got = queries.QUERIES["op6_language_id"](spark, FOLDER).toPandas()
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(got) == len(truth)
    both = got.merge(truth, on="doc_id")
    assert (both.held_out == [crc(i) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.rejected.mean() < 0.02
    assert got.score.between(0, 1).all()


def test_language_cases(spark):
    rng = random.Random(1)
    make = lambda w: " ".join(rng.choices(w, k=200))
    one, two = ["alpha", "betas", "gammon"], ["délta", "épsil", "zêta"]
    schema = "doc_id bigint, text string, lang string, lang_pred string, score int"
    rows = [(i, make(one if i % 2 else two), "a" if i % 2 else "b", "clash", 1) for i in range(20)]
    rows += [(90, None, "a", "", 1), (91, "", "b", "", 1), (None, make(two), "a", "", 1), (93, make(two), None, "", 1)]
    dictionaries = language_id.learn(spark.createDataFrame(rows, schema))
    assert list(dictionaries) == ["a", "b"]
    asked = [(1, make(one)), (2, make(two)), (2, make(two)), (3, None), (4, ""), (5, "12 !! __"), (6, make(one) * 300), (None, make(two))]
    frame = spark.createDataFrame(asked, "doc_id bigint, text string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(frame, dictionaries, 0.01, "doc_id").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (2, "b"), (3, "und"), (4, "und"), (5, "und"), (6, "a"), (None, "b")], key=str)
    assert {r.lang_pred for r in language_id.predict(frame, {}, 0.01, "doc_id").collect()} == {"und"}
    assert language_id.predict(frame.filter("false"), dictionaries, 0.01, "doc_id").count() == 0
    # a text as near to one language as to the other is rejected
    tools = language_id.compressors({"a": b"abc def " * 50, "b": b"abc def " * 50})
    assert language_id.identify("abc def abc", tools)[2]


def test_repeated_ids_do_not_enlarge_what_is_learned(spark):
    long = "".join("abcdefgh"[i % 8] + " " * (i % 5 == 0) for i in range(3000))
    rows = [(i, long + str(i), "a") for i in range(60)] + [(3, long + str(i % 250), "a") for i in range(500)] + [(7, "wörter", "b")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    dictionaries = language_id.learn(docs)
    assert len(dictionaries["a"]) <= language_id.SAMPLE_ROWS * (language_id.SAMPLE_CHARS + 1) and dictionaries["b"] == "wörter".encode()
    assert len(dictionaries["a"].split(b"\n")) == 60
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1)] * 40 + [(3, 0)], "doc_id bigint, label int")
    found = quality.counted(docs, labels, rows=10).collect()
    assert len(found) == 10 == len({r.doc_id for r in found})
    every = {r.doc_id: r.label for r in quality.counted(docs, labels).collect()}
    assert len(every) == 60 and every[3] == 0


def test_sample_of_a_long_text_is_spread_over_it(spark):
    text = "".join(chr(0x4E00 + i) for i in range(15_000))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(language_id.spread_sample(F.col("text")).alias("s")).collect()
    assert got[1].s == "short" and got[2].s == ""
    places = [ord(c) - 0x4E00 for c in got[0].s.replace(" ", "")]
    assert len(places) == language_id.SAMPLE_CHARS and places[0] == 0 and places[-1] == 14_999
    assert max(b - a for a, b in zip(places, places[1:])) < 1000


def test_long_text_is_read_to_its_end():
    rng = random.Random(4)
    one, two = ([("".join(rng.choices(abc, k=6))) for _ in range(300)] for abc in ("abcdefgh", "rstuvwxy"))
    tools = language_id.compressors({"a": " ".join(one).encode(), "b": " ".join(two).encode()})
    text = " ".join(rng.choices(one, k=2000)) + " " + " ".join(rng.choices(two, k=9000))
    assert language_id.identify(text, tools)[0] == "b"


def test_quality_on_held_out_rows(spark):
    got = queries.QUERIES["op10_quality"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().drop_duplicates("doc_id")
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and (got.held_out == [crc(i) % 5 == 0 for i in got.doc_id]).all()
    assert (both.predicted == both.quality).mean() > 0.95
    assert both[both.quality == 0].predicted.mean() < 0.3
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_cases(spark):
    rng = random.Random(2)
    good, bad = ["calm", "river", "stone"], ["!!!", "$$$", "zzz"]
    make = lambda w: " ".join(rng.choices(w, k=40))
    docs = [(i, make(good if i % 2 else bad), "clash") for i in range(60)] + [(70, None, ""), (71, "", ""), (71, "", ""), (None, make(good), "")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None), (70, 0), (999, 1)], "doc_id bigint, label int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model, "doc_id").collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60)) and got[None] > 0.5 and 0 <= got[70] == got[71] <= 1
    assert quality.learn(docs, labels.filter("false")) is None
    assert {r.score for r in quality.score(docs, None, "doc_id").collect()} == {0.5}
    assert quality.score(docs.filter("false"), model, "doc_id").count() == 0


def plain_features(text):
    found = {"words": [], "grams": 0, "again": 0}
    words = text.encode().split()
    words = [w[i:i + quality.LONGEST] for w in words for i in range(0, len(w), quality.LONGEST)]
    found["again"] = sum(w in words[max(0, i - 2):i] for i, w in enumerate(words))
    found["grams"] = sum(max(0, len(w) + 2 - n + 1) for w in words for n in quality.GRAMS)
    found["words"] = words
    return found


def test_features_are_those_of_whole_texts():
    for text in ("", " ", "a", "one two one", "é" * 200 + " x", "word " * 300_000):
        got = list(quality.features(text))
        plain = plain_features(text)
        pieces = len(got)
        n = sum(map(len, got))
        assert abs(n - (len(plain["words"]) + plain["grams"] + plain["again"])) <= 2 * max(0, pieces - 1)
    one, two = (np.concatenate(list(quality.features(t))) for t in ("river stone", "stone river"))
    assert sorted(one) == sorted(two)


def test_training_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([f, 100 + int(rng.integers(50))]), np.array([0.5, 0.5], np.float32), f) for f in (0, 1) for _ in range(100)]
    pull = quality.train(rows).per_feature()
    assert pull[0] < -1 < 1 < pull[1]
    assert isinstance(pd.Series(pull).sum(), float)
