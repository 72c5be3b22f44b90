"""What a run over pending links keeps: the frontier, and the URLs that were attempted.

Both only grow, and a save costs what is new. The frontier is a keyed table, so positions once
given stay. Attempted URLs are a table in buckets by URL: when pending links are looked up in it,
the links are dealt to its buckets, and what was attempted before is read but never shuffled,
however much it has grown.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagecatalog import schemas
from pagecatalog.sources.keyed import KeyedTable

BUCKETS = 32


def frontier_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/frontier", schemas.LINK, ("url",))


def attempted_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> str:
    """The name under which the session knows a work folder's attempted URLs."""
    name = "attempted_" + hashlib.md5(root.encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (url STRING) USING parquet CLUSTERED BY (url) INTO {buckets} BUCKETS "
              f"LOCATION '{root}/attempted'")
    return name


def read_state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(frontier, attempted)``, empty where there is no state yet."""
    return frontier_table(spark, root).read(), spark.table(attempted_table(spark, root)).distinct()


def write_state(new_links: DataFrame, attempted: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Add links, ``(pos, url)``, and attempted URLs. A link that is known gets the new position."""
    spark = new_links.sparkSession
    frontier_table(spark, root).save(new_links.select(F.col("pos").cast("long").alias("pos"), "url"))
    name = attempted_table(spark, root, buckets)
    rows = attempted.select("url").distinct().repartition(buckets, "url")
    rows.write.mode("append").format("parquet").bucketBy(buckets, "url").option("path", f"{root}/attempted").saveAsTable(name)
    spark.catalog.refreshTable(name)
