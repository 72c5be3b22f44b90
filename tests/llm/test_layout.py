"""Syncmers, sharding and mixing."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from oracle import connect, differences

from pagecatalog.llm import mixing, queries, sharding, syncmers
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, source string, size string, shard int, _place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, 2) for i, t, s in rows], SCHEMA)


ROWS = [(i, " ".join(f"w{(i * j) % 41}" for j in range(i * 3)), f"s{i % 5}") for i in range(30)] + [
    (50, None, "s1"), (51, "", None), (52, "  ", "s2"), (53, "x" * 300_000, "s3"), (54, "é𝒳 " * 40, None), (7, "again", "s2"), (7, "again", "s2")]


def test_edited_texts(spark):
    got = syncmers.compare(frame(spark, ROWS), slices=6).collect()
    ids = sorted({i for i, _, _ in ROWS}, reverse=True)
    texts = {i: t or "" for i, t, _ in reversed(ROWS)}
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id == 7:
            continue  # an id that repeats: the next row may be one of its own
        text, nxt = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        if ids[(ids.index(r.doc_id) + 1) % len(ids)] == 7:
            continue
        half = len(text) // 2
        assert r.edited == text[:len(text) - half] + nxt[:half]
    assert syncmers.compare(frame(spark, []), slices=3).count() == 0
    alone = syncmers.compare(frame(spark, [(1, "one two", "s")]), slices=3).collect()
    assert alone[0].edited == "one one"


def hashed(*values):
    """Spark's xxhash64 of a row of numbers, or of one text."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little"), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_anchors(text):
    letters = [hashed(x) for x in re.findall(syncmers.LETTER, text or "")]
    k, s = syncmers.K, syncmers.S
    packed = lambda h, place: ((h & (2**64 - 1)) >> 34) * 2**33 + place
    if len(letters) < k:
        return [packed(hashed(*letters), 0)] if letters else []
    smers = [hashed(*letters[i:i + s]) for i in range(len(letters) - s + 1)]
    out = []
    for i in range(len(letters) - k + 1):
        window = smers[i:i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(packed(hashed(smers[i], smers[i + s], smers[i + k - s]), i))
    return out


def plain_sketch(text):
    first = {}
    for x in sorted(plain_anchors(text)):
        first.setdefault(x >> 33, x)
    found = sorted(first.values())
    return found[:max(syncmers.LEAST, -(-len(found) // syncmers.SHARE))]


def plain_likeness(a, b):
    top = [x[-1] >> 33 if len(x) >= syncmers.LEAST else 2**40 for x in (a, b)]
    a, b = ({x >> 33: x % 2**32 for x in y if x >> 33 <= min(top)} for y in (a, b))
    if not a and not b:
        return 1.0
    offsets = [p - q for p, q in sorted((a[h], b[h]) for h in a.keys() & b.keys())]
    if len(offsets) == 1:
        return 2 / (len(a) + len(b))
    return 2 * sum(o in offsets[max(0, i - 1):i] + offsets[i + 1:i + 2] for i, o in enumerate(offsets)) / (len(a) + len(b))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfgstrn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


CHINESE = "".join(chr(0x4E00 + (i * i * 31 + i * 7) % 2999) for i in range(4000))
SHARED = prose(77, 100)
SYNC_TEXTS = [None, "", "  ", "xkcd", "a b c", prose(1, 30), prose(1, 30), prose(1, 500) + " new " + prose(2, 500), prose(1, 500) + " " + prose(3, 500), CHINESE, "的" + CHINESE,
              "x" * 5000, "x" * 5000 + "y", "ab" * 3000, "éa\x00b\t😀 [q]^_`{z}~ 12,345 QWRTY", prose(8, 20_000) + " " + SHARED, SHARED + " " + prose(9, 20_000), prose(1, 8) * 40]


def test_syncmers_equal_a_plain_version(spark):
    docs = spark.createDataFrame(list(enumerate(SYNC_TEXTS)), "doc_id int, text string")
    rows = docs.select("doc_id", syncmers.anchors(F.coalesce("text", F.lit(""))).alias("a"), syncmers.sketch(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in rows:
        assert list(r.a) == plain_anchors(SYNC_TEXTS[r.doc_id]) and list(r.s) == plain_sketch(SYNC_TEXTS[r.doc_id])
    sketches = docs.select("doc_id", syncmers.sketch(F.coalesce("text", F.lit(""))).alias("s"))
    pairs = sketches.alias("a").join(sketches.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id"))
    known = {r.doc_id: list(r.s) for r in rows}
    like = {}
    for one, two, value in pairs.select("a.doc_id", "b.doc_id", syncmers.likeness(F.col("a.s"), F.col("b.s"))).collect():
        assert abs(value - plain_likeness(known[one], known[two])) < 1e-12
        like[one, two] = value
    assert all(like[i, i] == 1.0 for i in range(len(SYNC_TEXTS))) and like[5, 6] == 1.0
    assert 0.3 < like[7, 8] < 0.7
    assert like[9, 10] > 0.9  # moved by one character, without a blank
    assert 0 < like[15, 16] < 0.05  # 100 words of 20,000, elsewhere in each


def test_sketches_hold_every_anchor(spark):
    """Long texts too: nothing of what two texts differ in is left out of the count."""
    one, two = prose(21, 3000), prose(21, 1500) + " " + prose(22, 1500)
    a, b = ({x >> 33 for x in plain_anchors(t)} for t in (one, two))
    rows = frame(spark, [(1, one, "s"), (2, two, "s")]).select(syncmers.sketch(F.col("text")).alias("s"))
    got = sorted(({x >> 33 for x in r.s} for r in rows.collect()), key=lambda x: x != a)
    assert got == [a, b] and min(len(a), len(b)) > 600


def test_syncmers_are_context_free_and_closed(spark):
    passage = prose(11, 200)
    rows = [(1, "a b c " + passage, "s"), (2, "completely other start of it " + passage + " and end", "s")]
    found = {r.doc_id: r.a for r in frame(spark, rows).select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    letters = [len(re.findall(syncmers.LETTER, t)) for t in ("a b c ", "completely other start of it ", passage)]
    one, two = ({(x % 2**32 - shift, x >> 33) for x in found[i]} for i, shift in ((1, letters[0]), (2, letters[1])))
    inside = {x for x in one if 0 <= x[0] <= letters[2] - syncmers.K}
    assert inside == {x for x in two if 0 <= x[0] <= letters[2] - syncmers.K} and len(inside) > 40
    assert 0.2 < len(inside) / letters[2] < 0.5


def test_hot_ids_are_split(spark):
    rows = [(None, f"null {i}", "s") for i in range(2000)] + [(7, f"seven {i}", "s") for i in range(1500)] + [(i, f"own {i}", "s") for i in range(100)]
    docs = frame(spark, rows)
    got = syncmers.next_documents(docs, slices=20)
    largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 900
    said = lambda t: (hashed(t) & (2**64 - 1)) >> 1
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), said(r[1]), r[1]))
    want = {(r, s[1]) for r, s in zip(order, order[1:] + order[:1])}
    assert {((r.doc_id, r.text), r.next_text) for r in got.collect()} == want


def test_fingerprint_query(spark):
    got = queries.QUERIES["op7_syncmers"](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().sort_values("doc_id", ascending=False)
    texts = docs.text.fillna("").tolist()
    edited = {}
    for i, (doc_id, text) in enumerate(zip(docs.doc_id, texts)):
        half = len(text) // 2
        edited[doc_id] = hashlib.sha256((text[:len(text) - half] + texts[(i + 1) % len(texts)][:half]).encode()).hexdigest()
    assert len(got) == len(docs) and dict(zip(got.doc_id, got.edited_sha256)) == edited
    both = got.merge(docs.assign(text=texts)[["doc_id", "text"]], on="doc_id")
    assert (both.groupby("text").fingerprint.nunique() == 1).all()
    assert got.near_edited.mean() > 0.4 and got.near_next.mean() < 0.05
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_likeness_of_empty_texts(spark):
    rows = frame(spark, [(1, "", "s"), (2, None, "s"), (3, "word", "s")])
    sketches = rows.select("doc_id", syncmers.sketch(F.coalesce("text", F.lit(""))).alias("s"))
    pairs = sketches.alias("a").join(sketches.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id"))
    got = {(r[0], r[1]): r[2] for r in pairs.select("a.doc_id", "b.doc_id", syncmers.likeness(F.col("a.s"), F.col("b.s"))).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 0.0, (2, 2): 1.0, (2, 3): 0.0, (3, 3): 1.0}


@pytest.mark.parametrize("rows", [ROWS, ROWS[:3], [(i, "same text", "s") for i in range(101)], []])
def test_shards(spark, rows):
    got = sharding.assign(frame(spark, rows), shards=8).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def plain_ring(cells, shards, virtual):
    """Shard of each row, served one by one: its own shard first, the next one with room after."""
    owned = sharding.owned_cells(shards, virtual)
    room = sharding.capacities(len(cells), shards)
    arcs: dict = {}
    for row, cell in enumerate(cells):
        arc = next((i for i, (c, _) in enumerate(owned) if c >= cell), len(owned))
        arcs.setdefault(arc, []).append(row)
    out, left, turn = {}, dict(arcs), 0
    tried = {arc: [] for arc in arcs}
    while left:
        for arc in sorted(left):
            walk = [owned[(arc + i) % len(owned)][1] if arc < len(owned) else owned[i % len(owned)][1] for i in range(len(owned) + 1)]
            shard = next(s for s in walk if s not in tried[arc])
            tried[arc].append(shard)
            taken, left[arc] = left[arc][:room[shard]], left[arc][room[shard]:]
            room[shard] -= len(taken)
            out.update(dict.fromkeys(taken, shard))
        left = {a: rows for a, rows in left.items() if rows}
    return [out[i] for i in range(len(cells))]


@pytest.mark.parametrize("shards,virtual,hot", [(3, 4, 0), (8, 16, 0), (8, 16, 900), (33, 64, 300)])
def test_loads_equal_a_plain_ring(shards, virtual, hot):
    rng = random.Random(shards + hot)
    top = 1 << sharding.ring_bits(shards, virtual)
    cells = sorted([rng.randrange(top) for _ in range(1500)] + [top // 3] * hot)
    owned = sharding.owned_cells(shards, virtual)
    assert len(owned) == shards * virtual and all(0 <= c < top for c, _ in owned)
    owners = [s for _, s in owned] + [owned[0][1]]
    counts = [0] * len(owners)
    for cell in cells:
        counts[next((i for i, (c, _) in enumerate(owned) if c >= cell), len(owned))] += 1
    got = []
    for arc, start, end, shard, _ in sorted(sharding.bounded_loads(counts, owners, shards)):
        got += [shard] * (end - start)
    assert got == plain_ring(cells, shards, virtual)


def test_many_shards(spark):
    got = sharding.assign(frame(spark, ROWS), shards=33).collect()
    assert sorted(len([r for r in got if r.shard == s]) for s in range(33)) == sorted(sharding.capacities(len(ROWS), 33))


def test_sharding_query(spark):
    got = queries.QUERIES["op8_sharding"](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = (docs.text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
    counts = got.shard.value_counts()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1


def test_few_rows_move_when_a_shard_is_added():
    import random
    rng = random.Random(3)
    places = [rng.randrange(sharding.CELLS) for _ in range(20_000)]

    def shard_of(shards):
        owned = sharding.owned_cells(shards, 64)
        arcs = [next((a for a, (c, _) in enumerate(owned) if c >= p), len(owned)) for p in sorted(places)]
        counts = [arcs.count(a) for a in range(len(owned) + 1)]
        out = []
        for arc, start, end, shard, _ in sorted(sharding.bounded_loads(counts, [s for _, s in owned] + [owned[0][1]], shards)):
            out += [shard] * (end - start)
        return out

    before, after = shard_of(8), shard_of(9)
    assert len(before) == 20_000
    assert sum(a != b for a, b in zip(before, after)) / 20_000 < 0.35  # a plain division would move 0.89
    assert max(before.count(s) for s in range(8)) - min(before.count(s) for s in range(8)) <= 1


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: repeats * sizes[s] for s in over}


def check_mix(got, rows):
    words = [(i, len((t or "").encode().split()), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in words:
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    assert sorted([(r.doc_id, r.size) for r in got], key=str) == sorted([(i, n) for i, n, _ in words], key=str)
    source = {i: s for i, _, s in words}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix(spark):
    got = mixing.mix(frame(spark, ROWS)).collect()
    check_mix(got, ROWS)
    turns = sorted((r.turn, r.finish) for r in got if r.taken)
    assert [t for t, _ in turns] == list(range(len(turns))) and turns == sorted(turns, key=lambda x: x[1])
    again = mixing.mix(frame(spark, ROWS[::-1])).collect()
    assert sorted([(r.doc_id, r.taken, r.turn) for r in got], key=str) == sorted([(r.doc_id, r.taken, r.turn) for r in again], key=str)
    assert mixing.mix(frame(spark, [])).count() == 0
    none = mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0), (0.0, 0)]


def test_mix_query_against_sql(spark):
    found = differences(queries.QUERIES["op9_mixing"](spark, FOLDER), connect(FOLDER), queries.ORACLES["op9_mixing"])
    assert found == []


def test_mix_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check_mix(queries.QUERIES["op9_mixing"](spark, FOLDER).collect(), docs)
