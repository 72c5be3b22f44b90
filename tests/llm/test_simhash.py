import random

import numpy as np
import pandas as pd
import xxhash

from pagecatalog.llm.components import connected_components
from pagecatalog.llm.simhash_dedup import fingerprint, near_duplicates, near_links


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_plain_one():
    for text in (None, "", "  \n", "One", "one TWO", "a b c", "Ä b c d e\x0bf g " * 40):
        assert fingerprint(text) == plain_fingerprint(text)


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)]
    texts += [t + " " + rng.choice(words) for t in texts] + [None, "", " ", texts[5], texts[5]]
    rows = pd.DataFrame({"doc_id": range(100, 100 + len(texts)), "text": texts, "fp": "clash", "component": 1})
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(spark.createDataFrame(rows)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = components(fps, 2)
    for i, fp in enumerate(fps):
        assert got[100 + i] == (int(np.uint64(fp).astype(np.int64)), 100 + want[i])


def test_links_of_dense_groups_with_and_without_hot_values(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(25)} | {0, 2**64 - 1}
    fps = sorted(fps)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    want = components(fps, 2)
    for hot in (50_000, 4):
        found = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in
                 connected_components(near_links(df, 2, hot=hot, levels=5)).collect()}
        mine = [found.get(f, f) for f in fps]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_chain_is_one_component(spark):
    edges = pd.DataFrame({"a": range(300), "b": range(1, 301)})
    got = connected_components(spark.createDataFrame(edges)).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_repeats_nulls_and_nothing(spark):
    schema = "doc_id bigint, text string"
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (7, "")]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (9, 7), (7, 7)], key=str)
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_very_long_text():
    text = "x y z w " * 100_000
    assert fingerprint(text) == plain_fingerprint(text)
