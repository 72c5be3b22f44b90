"""Hard negatives against plain Python over all pairs."""

import math

import numpy as np
import pytest
from oracle import connect, differences

from pagecatalog.llm import hard_negatives as H, queries
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<{}>, label int, uid string, leaf int"
SMALL = dict(leaf=8, group=16, block=4, sample=40)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, k, "clash", 1) for i, v, k in rows], SCHEMA.format(kind))


def plain(rows, every, positives=5, negatives=5, least=80, most=100):
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        use.append((H._NO_ID if i is None else i, [math.floor(256 * float(np.float32(c))) for c in v], label))
    out = []
    for a, (anchor, q, label) in enumerate(use):
        if anchor == H._NO_ID or anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, n) for n, (i, v, _) in enumerate(use) if n != a)
        like = [(i, -s) for s, i, n in scored if use[n][2] == label][:positives]
        for p_id, p in like:
            found = [(i, -s) for s, i, n in scored if use[n][2] != label and least * p <= -100 * s <= most * p][:negatives]
            name = lambda i: None if i == H._NO_ID else i
            out += [(anchor, name(p_id), r, name(i), p, s) for r, (i, s) in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(df):
    return sorted(map(tuple, df.collect()), key=str)


def clusters(seed, n, spread=0.3, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    x = centres[rng.integers(0, 7, n)] + spread * rng.normal(size=(n, width))
    return [(int(i), [float(c) for c in np.float32(v)], int(k)) for i, v, k in zip(rng.permutation(n), x, rng.integers(0, 3, n))]


@pytest.mark.parametrize("seed,spread", [(1, 0.3), (2, 0.05), (3, 2.0)])
def test_against_all_pairs(spark, seed, spread):
    rows = clusters(seed, 400, spread)
    assert mined(H.hard_negatives(frame(spark, rows), every=20, **SMALL)) == plain(rows, 20)


def test_cases(spark):
    rows = clusters(4, 120) + [
        (1000, None, 1), (1001, [1.0] * 6, None), (1002, [1.0, None] + [0.0] * 4, 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] * 6, 1),
        (1020, [], 1), (1040, [0.5, 0.5], 1), (1060, [0.0] * 6, 2), (None, [1.0] * 6, 1), (None, [1.0] * 6, 2), (1080, [0.01] * 6, 0)]
    rows += [rows[3]] * 3 + [(1100, [0.5] * 6, 2), (1100, [0.5] * 6, 2), (1101, [0.5] * 6, 0), (1102, [0.5] * 6, 1)]  # repeats and ties
    rows += [(2000 + i, [0.25] * 6, i % 3) for i in range(60)]  # one vector that many rows share
    got = mined(H.hard_negatives(frame(spark, rows), every=20, **SMALL))
    assert got == plain(rows, 20) and len(got) > 100
    assert H.hard_negatives(frame(spark, []), every=20).count() == 0
    assert H.hard_negatives(frame(spark, [(1, [1.0], 1)]), every=20).count() == 0
    alone = H.hard_negatives(frame(spark, [(20, [1.0], 1), (21, [1.0], 2)]), every=20)
    assert alone.count() == 0 and alone.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_scores_beyond_doubles_are_exact(spark):
    big = 3.0 * 2.0 ** 20
    rows = [(i, [big + i / 256, big - i / 256, 1.0 / 256], i % 2) for i in range(40)]
    got = H.hard_negatives(frame(spark, rows, "double"), every=10, **SMALL)
    use = [(i, [math.floor(256 * c) for c in v], k) for i, v, k in rows]
    exact = {(a, b): sum(x * y for x, y in zip(u, v)) for a, u, _ in use for b, v, _ in use}
    found = got.collect()
    assert len(found) > 50 and max(exact.values()) > 2 ** 53
    for r in found:
        assert r.positive_score == exact[r.anchor_id, r.positive_id] and r.negative_score == exact[r.anchor_id, r.negative_id]


def test_tree_eliminates_and_never_loses(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 900
    x = np.floor(centres[rng.integers(0, 12, 3000)] + 20 * rng.normal(size=(3000, 8)))
    tree = H.grown(x[:600], 3000, leaf=100)
    table = spark.createDataFrame([(i, i, 0, False, v.astype("<f4").tobytes()) for i, v in enumerate(x)], H._VECTOR)
    tree = H._measured(table, tree)
    leaf = tree.leaf_of(x)
    met = tree.met(x[:50], *(np.array(b)[:, None] for b in zip(*[(0.97 * (v @ v), 1.03 * (v @ v)) for v in x[:50]])))
    for q, reached in zip(x[:50], met):
        s = x @ q
        assert reached[leaf[(s >= 0.97 * (q @ q)) & (s <= 1.03 * (q @ q))]].all()
    assert tree.leaves > 20 and met.mean() < 0.3


def test_query(spark):
    df = queries.QUERIES["op12_hard_negatives"](spark, FOLDER)
    assert differences(df, connect(FOLDER), queries.ORACLES["op12_hard_negatives"]) == []
    small = H.hard_negatives(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), label=F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), leaf=32, group=64, block=2, sample=200)
    assert mined(small) == mined(df)
