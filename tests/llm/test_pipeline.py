"""The pipeline against plain versions of its stages, and on input without a sensible answer."""

from collections import Counter

import corpus_pipeline as pipeline
from test_layout import plain_targets
from test_simhash import components, plain_fingerprint

from pagecatalog.llm import decontaminate, language_id
from pagecatalog.session import fresh_path, materialize

FOLDER = "/root/testdata/sf0.001"


def saved(spark, docs, benchmark):
    root = fresh_path(spark, "pipeline-test")
    docs.write.parquet(f"{root}/documents.parquet")
    benchmark.write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_against_plain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmarks", "mixing", "sharding"]

    def after(name, frame):
        out = materialize(stages[name](spark, frame, FOLDER), name)
        if name != "sharding":
            assert out.columns == columns
        return out

    told = after("language", docs)
    held_out = lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1
    dictionaries = language_id.learn(docs.filter(docs.doc_id.isin([r.doc_id for r in rows if not held_out(r.doc_id)])))
    tools = language_id.compressors(dictionaries)
    want = [r for r in rows if not language_id.identify(r.text, tools)[2]]
    assert sorted(told.collect()) == sorted(want) and len(want) > 0.97 * len(rows)

    single = after("near_duplicates", told)
    want.sort(key=lambda r: r.doc_id)
    roots = components([plain_fingerprint(r.text) for r in want], 2)
    want = [r for i, r in enumerate(want) if roots[i] == i]
    assert sorted(single.collect()) == want

    clean = after("benchmarks", single)
    items = [b" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = [r for r in want if not any(i in b" ".join(decontaminate.words_of(r.text)) for i in items)]
    assert sorted(clean.collect()) == kept and len(kept) < len(want)

    mix = after("mixing", clean).collect()
    copies = Counter(r.doc_id for r in mix)
    words = {r.doc_id: len(r.text.split()) for r in kept}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in kept:
        sizes[r.source] += words[r.doc_id]
        taken[r.source] += copies[r.doc_id] * words[r.doc_id]
        largest[r.source] = max(largest[r.source], words[r.doc_id])
    targets = plain_targets(sizes)
    assert max(copies.values()) <= 3 and set(mix) <= set(kept)
    assert all(-1 <= taken[s] - targets[s] <= largest[s] for s in sizes)

    placed = pipeline.shards(spark, spark.createDataFrame(mix, docs.schema), FOLDER).collect()
    assert Counter(r.doc_id for r in placed) == copies
    per_shard = Counter(r.shard for r in placed)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert sorted((r.shard, r.slot) for r in placed) == [(s, i) for s in sorted(per_shard) for i in range(per_shard[s])]


def test_odd_input(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rejected boolean, _rid string, size string"
    text = lambda i: " ".join(f"word{(i * j) % 53}x" for j in range(60))
    rows = [(i, text(i), "en" if i % 2 else "de", "s", 1, True, "r", "s") for i in range(1, 20)]
    rows += [(None, text(31), None, None, None, None, None, None), (40, None, "en", "s", 1, True, "r", "s"),
             (41, "", "en", None, 1, True, "r", "s"), (3, text(3), "en", "s", 1, True, "r", "s"),
             (3, text(3), "en", "s", 1, True, "r", "s"), (42, "!!! 12", "en", "s", 1, True, "r", "s")]
    bench = spark.createDataFrame([(1, text(5)), (None, None)], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, schema)
    stages = dict(pipeline.STAGES)
    root = saved(spark, docs, bench)
    for name in ("near_duplicates", "benchmarks", "mixing"):
        out = stages[name](spark, docs, root)
        assert out.columns == docs.columns and out.count() > 0, name
    single = [r.doc_id for r in stages["near_duplicates"](spark, docs, root).collect()]
    assert single.count(3) == 1 and None in single and sum(i in (40, 41) for i in single) == 1
    left = [r.doc_id for r in stages["benchmarks"](spark, docs, root).collect()]
    assert 5 not in left and left.count(3) == 3 and None in left
    mixed = Counter(r.doc_id for r in stages["mixing"](spark, docs, root).collect())
    assert set(mixed) <= {r[0] for r in rows} and max(mixed.values()) <= 9
    known = stages["language"](spark, docs, root)
    assert known.columns == docs.columns and not {40, 41, 42} & {r.doc_id for r in known.collect()}


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    root = saved(spark, docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("false"))
    assert pipeline.run(spark, root).count() == 0
