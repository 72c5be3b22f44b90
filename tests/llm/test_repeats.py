"""Removal of repeated words and of repeated bytes, against plain versions of both."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from oracle import connect, differences

from pagecatalog.llm import queries, substring_dedup, suffix_dedup

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, first string, seed int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)


def plain_words(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain_bytes(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    times = {}
    for _, r in raws:
        for s in range(len(r) - length + 1):
            times[r[s:s + length]] = times.get(r[s:s + length], 0) + 1
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for s in range(len(r) - length + 1):
            if times[r[s:s + length]] > 1:
                gone[1 + s:1 + s + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, words, n=40):
    """Documents that share passages of all lengths around the threshold, and copies."""
    shared = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choices(words, k=rng.randint(0, 30))))
            parts.append(rng.choice(shared))
        rows.append((i * 3 + 1, " ".join(parts)))
    texts = [t for _, t in rows]
    rows += [(500 + i, t) for i, t in enumerate(texts[:10])]
    rows += [(600 + i, t[:len(t) // 2] + " changed " + t[len(t) // 2:]) for i, t in enumerate(texts[:10])]
    return rows + [(700, None), (701, ""), (702, " \n"), (703, "a " * 300), (704, "ab" * 900), (706, "one two three four five six seven eight nine ten eleven"), (705, "ab" * 450), (None, texts[1]), (-1, texts[1]), (-5, texts[1])]


@pytest.mark.parametrize("vocabulary", [3, 300])
def test_words_against_plain(spark, vocabulary):
    rng = random.Random(vocabulary)
    rows = corpus(rng, ["w%dé" % i for i in range(vocabulary)])
    rows += [rows[3], rows[3]]
    got = substring_dedup.remove_repeats(frame(spark, rows), window=20, k=8)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == plain_words(rows, 20)


@pytest.mark.parametrize("vocabulary,crowd", [(3, 4096), (300, 4096), (300, 1)])
def test_bytes_against_plain(spark, vocabulary, crowd):
    rng = random.Random(vocabulary)
    rows = corpus(rng, ["w%dé" % i for i in range(vocabulary)])
    rows += [rows[3], rows[3]]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=90, k=30, crowd=crowd)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == plain_bytes(rows, 90)


def test_nothing(spark):
    for module in (substring_dedup, suffix_dedup):
        assert module.remove_repeats(frame(spark, [])).count() == 0


def test_long_text_with_two_far_copies(spark):
    rng = random.Random(8)
    passage = " ".join("p%d" % rng.randrange(10**6) for _ in range(80))
    filler = " ".join("f%d" % rng.randrange(10**6) for _ in range(60_000))
    rows = [(1, passage), (2, filler + " " + passage), (3, passage + " tail " + passage)]
    words = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert [words[i].n_removed for i in (1, 2, 3)] == [0, 80, 160] and words[2].kept == filler
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert found[1].n_removed == len(passage) and found[1].n_spans == 1 and found[3].n_spans == 2
    assert bytes(found[2].kept) in (filler.encode() + b" ", filler.encode())


def test_repeated_starts_of_many_random_stretches():
    rng = random.Random(2)
    for alphabet, length in ((b"ab", 6), (b"abcdef", 4), (bytes(range(256)), 3)):
        stretches = [bytes(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(30)]
        times = {}
        for s in stretches:
            for i in range(len(s) - length + 1):
                times[s[i:i + length]] = times.get(s[i:i + length], 0) + 1
        got = suffix_dedup.repeated_starts(stretches, length)
        for s, found in zip(stretches, got):
            assert found.tolist() == [i for i in range(len(s) - length + 1) if times[s[i:i + length]] > 1]


@pytest.mark.parametrize("name", ["op2_suffix_array", "op4_substring"])
def test_queries_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == []
