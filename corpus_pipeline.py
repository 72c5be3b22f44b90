"""Documents to a sharded training mix: stages that each apply one operator to all that the
stage before kept.

Every stage but the last returns the columns of its input. Nulls, empty texts, repeated rows
and empty tables are treated as each operator's docstring says; what a stage adds of its own
is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagecatalog.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from pagecatalog.llm.common import keyed, remainder, row_key
from pagecatalog.plans.registry import table
from pagecatalog.session import materialize

KEY = ("rid", "th")


def _with_key(docs: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` with its row key under names that it does not use, these names, and its own."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    columns = docs.columns
    names = [mark + k for k in KEY]
    key = row_key(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns(dict(zip(names, key))), names, columns


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without a letter go too. Learns
    from the rows whose language is known, as the operator's query does."""
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    dictionaries = language_id.learn(docs.filter(~held_out))
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    told = language_id.predict(docs, dictionaries, language_id.MARGIN, *docs.columns, prefix=mark)
    return told.filter(~F.col(f"{mark}rejected")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the first by id, a null id last. Of rows that
    repeat id and text, one stays."""
    groups = simhash_dedup.near_duplicates(docs, shingle=3, distance=2)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("first"))
    rows, key, columns = _with_key(docs)
    kept = first.select(*[F.col(f"first.{k}").alias(n) for k, n in zip(KEY, key)])
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = decontaminate.leaks(keyed(docs), table(spark, sf_dir, "benchmark"))
    rows, key, columns = _with_key(docs)
    gone = leaks.select(*[F.col(k).alias(n) for k, n in zip(KEY, key)]).distinct()
    return rows.join(gone, key, "left_anti").select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; what it takes nothing of
    goes. The document on which a source's budget ends stays whole, as do texts without words
    in a source that is served at least once over."""
    columns = docs.columns
    rows = keyed(docs.select("doc_id", "text", "source"), "source")
    taken = mixing.mix(rows, mixing.WEIGHTS, mixing.REPEATS, *KEY)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(
        F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)).cast("int")
    among = Window.partitionBy(*KEY).orderBy("finish")
    taken = taken.withColumn("copies", copies).withColumn("nth", F.row_number().over(among)).select(*KEY, "nth", "copies")
    marked, key, _ = _with_key(docs)
    nth = key[0] + "_nth"
    marked = marked.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    taken = taken.filter("copies > 0").select(*[F.col(k).alias(n) for k, n in zip((*KEY, "nth"), (*key, nth))], F.col("copies").alias(nth + "_copies"))
    repeated = marked.join(taken, [*key, nth])
    return repeated.select(*columns, F.explode(F.sequence(F.lit(1), F.col(nth + "_copies"))).alias(nth)).select(*columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight balanced shards, and each document's place in its shard."""
    return sharding.assign(docs, shards=8)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("benchmarks", without_benchmarks),
    ("mixing", mixed),
    ("sharding", shards),
]
#: No SQL: compression, trie join and ring cannot be put in it; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
