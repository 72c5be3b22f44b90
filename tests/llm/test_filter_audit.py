"""The audit of filters against plain Python over all orders."""

import re
from itertools import permutations

from oracle import connect, differences

from pagecatalog.llm import filter_audit, queries

FOLDER = "/root/testdata/sf0.01"
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts: dict = {}
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in docs):
            fails.add("E")
        parts.setdefault(lang or "", []).append((doc_id, fails))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = sum(f in r[1] for r in rows)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in rows),
                                                   sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def run(spark, docs, labels):
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, lang string, mask string, part int")
    marks = spark.createDataFrame([(*m, "clash") for m in labels], "doc_id bigint, quality int, toxic int, good string")
    return filter_audit.audit(table, marks)


LONG = " ".join(f"w{i}" for i in range(260))
DOCS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG.upper(), "fr"), (4, "a a a a # b", "en"), (5, None, None), (6, "", ""), (7, "", "de"), (None, LONG, "en"),
        (None, "", "fr"), (8, ("same " * 300) + "|", "fr"), (9, "ABC def", "en"), (9, "ABC def", "en"), (9, LONG, "de"), (-4, LONG + " é𝒳", "en"),
        (10, " ".join(["x"] * 300), "fr"), (11, "é" * 50_000 + " tail", "en"), (12, "\x0b\x1c word", "de")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1), (4, 0, 0), (8, 1, None), (None, 1, 1), (9, 1, 0), (5, None, 1), (99, 1, 1)]


def test_against_all_orders(spark):
    got = run(spark, DOCS, LABELS)
    assert got.columns == NAMES
    rows = got.collect()
    want = plain(DOCS, LABELS)
    assert len(rows) == len(want) == 600 * 4
    assert {tuple(r)[:3]: list(r)[3:] for r in rows} == want


def test_empty_tables(spark):
    assert run(spark, [], LABELS).count() == 0
    assert run(spark, DOCS[:2], []).count() == 600


def test_query(spark):
    df = queries.QUERIES["op13_filter_audit"](spark, FOLDER)
    assert differences(df, connect(FOLDER), queries.ORACLES["op13_filter_audit"]) == []
