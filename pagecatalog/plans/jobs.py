"""The jobs: discover, process, resume, full run, two-source enrichment.

Each reads a table of captures and keeps its links, progress, errors and catalogue in
one work folder. Counts pass through the driver, rows do not.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagecatalog import defaults as D, schemas
from pagecatalog.functions import query_url, resolve_url
from pagecatalog.functions.ordering import global_index
from pagecatalog.operators import catalog as C, enrich as E, extract as X, frontier as R, links as L, progress as P
from pagecatalog.operators.elements import elements
from pagecatalog.operators.select import names_of
from pagecatalog.session import discard, is_written, materialize, scratch, session_conf
from pagecatalog.sources import readers, writers
from pagecatalog.sources.keyed import KeyedTable
from pagecatalog.sources.state import read_state, write_state


#: Shuffled bytes of a partition that one task may hash; Spark wants its own partitions to be no larger.
SHORT_SIDE = "64m"


@dataclass(frozen=True)
class Site:
    """Where links resolve to, and which links of an index or listing page count."""

    base: str
    group_selectors: tuple[str, ...] = D.GROUP_SELECTORS
    record_selectors: tuple[str, ...] = D.RECORD_SELECTORS
    image_folder: str = "catalog"


@dataclass(frozen=True)
class Sources:
    """What a run reads: captures ``(url, html)``, images found per search text, how image
    addresses answered, ``(url, status, content_type)``, and the log of requests.

    Captures with ``fetched_at`` may hold a URL several times; the newest counts. With
    ``as_of``, only captures younger than ``hours`` at that time are used.
    """

    captures: DataFrame
    image_candidates: DataFrame | None = None
    image_responses: DataFrame | None = None
    fetch_log: DataFrame | None = None
    as_of: str | None = None
    hours: int = D.CAPTURE_HOURS

    def pages(self) -> DataFrame:
        return self.captures if self.as_of is None else readers.fresh(self.captures, self.as_of, self.hours)

    def log(self) -> DataFrame:
        if self.fetch_log is not None:
            return self.fetch_log
        return readers.empty(self.captures.sparkSession, schemas.FETCH_LOG)

    def images(self) -> DataFrame:
        if self.image_candidates is not None:
            return self.image_candidates
        return readers.empty(self.captures.sparkSession, schemas.IMAGE_CANDIDATE)


@contextlib.contextmanager
def _streamed(spark: SparkSession):
    """Of a join whose one side is short in every partition, that side is hashed and the other passes
    through. A sort of captures would spill about as many bytes as their HTML has."""
    with session_conf(spark, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=SHORT_SIDE,
                      spark__sql__adaptive__advisoryPartitionSizeInBytes=SHORT_SIDE):
        yield


def _captured(urls: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures of the given URLs, each URL's newest.

    The list is written out first. Its size is then known when the join is planned, and a
    short list is broadcast; otherwise the HTML would be shuffled before the list turned
    out to be short. A list that is too long for that is dealt to the buckets of captures that
    are a table in buckets (``writers.write_capture_table``), and their HTML stays where it is:
    the join is on the URL alone, which is what the buckets go by. Inside :func:`_streamed` it is
    not sorted either.
    """
    # a list that is written out already may repeat URLs: nothing here multiplies them
    listed = urls.select("url") if is_written(urls) else R.urls_to_read(urls)
    if "fetched_at" not in captures.columns:
        wanted = listed if is_written(urls) else materialize(listed, "wanted")
        return captures.select("url", "html").join(wanted, "url", "left_semi")
    wanted = materialize(readers.newest(captures, also=listed).withColumnRenamed("fetched_at", "_newest"), "wanted")
    met = captures.select("url", "html", "fetched_at").join(wanted, "url")
    # none is newer than the newest; as an equality this would become a second join key
    return met.filter(F.col("fetched_at") >= F.col("_newest")).select("url", "html")


def _written_once(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written out, one of each URL. To look for URLs that repeat takes a shuffle of URLs; the rows
    themselves are dealt out and sorted only if there are any."""
    written = materialize(rows, tag)
    if written.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return written
    once = materialize(written.dropDuplicates(["url"]), tag)
    discard(written)
    return once


def find_groups(start_urls: DataFrame, sources: Sources, site: Site, max_groups: int | None = None) -> DataFrame:
    """``(pos, group_url)`` of the groups that the index pages link to."""
    docs = elements(_captured(start_urls, sources.pages()), only=names_of(*site.group_selectors))
    found = L.group_links(docs, site.base, site.group_selectors)
    firsts = L.distinct_ordered(found, ["url", "pos"])
    capped = R.first_n(firsts, max_groups, "url", "pos")
    return global_index(capped.select(F.col("link").alias("group_url"), "url", F.col("pos").alias("was")),
                        ["url", "was"], "pos").select("pos", "group_url")


def find_links(groups: DataFrame, sources: Sources, site: Site, max_pages: int = D.MAX_PAGES) -> DataFrame:
    """``(pos, url)`` of the distinct record links on the listing pages of the groups."""
    listing = L.paginated_captures(groups, sources.pages().select("url"), max_pages).join(groups, "group_url")
    listing = materialize(listing, "listing")
    pages = _captured(listing, sources.pages()).join(
        listing.select("url", F.col("pos").alias("group_pos"), "page_no"), "url")
    docs = elements(pages, ("group_pos", "page_no"), only=names_of(*site.record_selectors))
    links = L.page_links(docs, site.base, site.record_selectors, ("group_pos", "page_no"))
    order = ["group_pos", "page_no", "pos"]
    firsts = L.distinct_ordered(links, order).withColumnRenamed("pos", "link_pos")
    return global_index(firsts, ["group_pos", "page_no", "link_pos"], "pos") \
        .select("pos", F.col("link").alias("url"))


def discover(spark: SparkSession, start_urls: DataFrame, sources: Sources, site: Site, root: str,
             max_groups: int | None = None, max_pages: int = D.MAX_PAGES) -> DataFrame:
    """Phase 1: find the record links and keep them, with the list of groups."""
    with scratch(spark), _streamed(spark):
        groups = materialize(find_groups(start_urls, sources, site, max_groups), "groups")
        writers.write_links(groups.withColumnRenamed("group_url", "url"), f"{root}/groups")
        writers.write_links(find_links(groups, sources, site, max_pages), f"{root}/links")
        links = readers.read_links(spark, f"{root}/links")
        asked = start_urls.select("url").union(groups.select(F.substring_index("group_url", "?", 1)))
        spent = sources.log().withColumn("page", F.substring_index("url", "?", 1)).join(
            asked.select(F.col("url").alias("page")).distinct(), "page", "left_semi")
        P.discovery_summary(links, spent, "url").write.mode("overwrite").parquet(f"{root}/discovery")
    return links


def extract_records(urls: DataFrame, sources: Sources, site: Site) -> DataFrame:
    """Fields of every captured record page. Written out, as both the parents and their
    child links are read from it, and pages should be parsed once."""
    docs = elements(_captured(urls, sources.pages()), only=X.RECORD_NAMES)
    records = X.record_fields(docs, site.base).withColumn("image_src", resolve_url(site.base, F.col("image_src")))
    return _written_once(records, "records")


def with_image_paths(records: DataFrame, sources: Sources, site: Site) -> DataFrame:
    """Records with where their image is stored; NULL if its address did not answer well."""
    if sources.image_responses is None:
        return records.withColumn("image_path", F.lit(None).cast("string"))
    answers = sources.image_responses.select(F.col("url").alias("image_src"), "status", "content_type")
    path = writers.image_path(site.image_folder, F.col("id"), F.col("image_src"), F.col("status"), F.col("content_type"))
    return records.join(answers, "image_src", "left").withColumn("image_path", path)


def extract_children(records: DataFrame, sources: Sources) -> DataFrame:
    """One row per child link with a captured page: the parent's columns, the child's
    fields, its images. A child page that many parents link to is parsed once."""
    links = records.select(
        F.col("id").alias("generic_id"), F.col("english_name").alias("generic_english_name"),
        F.col("persian_name").alias("generic_persian_name"), F.col("url").alias("generic_url"),
        F.posexplode("child_urls").alias("pos", "child_url"))
    pages = _captured(links.select(F.col("child_url").alias("url")), sources.pages())
    children = X.child_fields(elements(pages, only=X.CHILD_NAMES)).dropDuplicates(["url"]).withColumn(
        "query", E.search_text(F.col("english_name"), F.col("manufacturer")))
    # images are looked up per child page, not per link
    children = E.top_images(children, sources.images()).drop("query")
    return E.child_page_join(links, children, "child_url").drop("child_url")


def catalog_rows(children: DataFrame) -> DataFrame:
    """Catalogue rows straight from the child rows; nesting and flattening again would
    give the same rows for one more shuffle."""
    return children.select(*schemas.CATALOG.fieldNames())


def nested_records(records: DataFrame, children: DataFrame) -> DataFrame:
    """Nested records; those without children keep an empty array."""
    parents = records.select(
        "id", "english_name", "persian_name", "manufacturer", "image_path", "combinations", "url")
    keyed = children.select(F.col("generic_url").alias("parent_url"), "pos", "persian_name", "english_name",
                            "manufacturer", "url", "image_url")
    nested = E.nest_children(
        parents.withColumn("parent_url", F.col("url")), keyed, "parent_url", ["pos"],
        schemas.CHILD.fieldNames(), part_size=None)
    return nested.select(*schemas.RECORD.fieldNames())


def catalog_table(spark: SparkSession, root: str) -> KeyedTable:
    """The catalogue of a work folder, keyed by record."""
    return KeyedTable(spark, f"{root}/catalog", schemas.CATALOG, ("generic_url",))


def save_catalog(rows: DataFrame, records: DataFrame, root: str) -> DataFrame:
    """Put the rows of the processed ``records`` in place of what the catalogue held of
    them: a record that has lost its children loses its rows. Costs what the records touch."""
    catalog = catalog_table(rows.sparkSession, root)
    catalog.save(rows, records.select(F.col("url").alias("generic_url")), covered=True, ahead=True)
    return catalog.read()


def _accounted(batches: DataFrame, errors: DataFrame, sources: Sources) -> DataFrame:
    """One row per link: whether it gave a record, which those without ``errors`` did, and what the request
    log knows of it. The log is summed up before it is dealt out."""
    failed = errors.select("url", F.lit(False).alias("ok"))
    asked = sources.log().groupBy("url").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("elapsed").alias("elapsed"), F.min("ts").alias("ts"))
    rows = batches.join(failed, "url", "left").join(asked, "url", "left")
    ok = F.col("url").isNotNull() & F.coalesce("ok", F.lit(True))
    return rows.select("url", "batch_no", ok.alias("ok"), F.lit(1).alias("attempt"),
                       (F.coalesce("attempts", F.lit(1)) - 1).alias("retries"), "elapsed", "ts")


#: One row per link that was processed.
LOG = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("batch_no", T.LongType()), T.StructField("ok", T.BooleanType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("retries", T.LongType()),
    T.StructField("elapsed", T.DoubleType()), T.StructField("ts", T.TimestampType())])


def process(spark: SparkSession, sources: Sources, site: Site, root: str, batch_size: int = D.BATCH_SIZE,
            start_index: int = 0, fmt: str = "json", wave: int | None = None, stop_after: int | None = None,
            keep: int = 2) -> DataFrame:
    """Phase 2: the kept links from ``start_index`` on, into the catalogue.

    Batches are units of progress, not of work. ``wave`` batches are one job and are
    committed together: rows, then errors, then progress, so that a run that dies is
    resumed at the wave it was in. None is one wave for all. What a wave leaves is named by
    its first link and replaced when it is done again; a run from the first link on
    replaces all. ``stop_after`` ends the run after so many waves. At its end, versions of the
    catalogue older than the newest ``keep`` are deleted, but for pinned ones.
    """
    with scratch(spark), _streamed(spark):
        links = materialize(P.assign_batches(readers.read_links(spark, f"{root}/links"), ["pos"], batch_size, start_index), "batches")
        total = readers.read_links(spark, f"{root}/links").count()
        last = links.agg(F.max("batch_no").alias("last")).first()["last"]
        n_batches = 0 if last is None else last + 1
        if start_index == 0:
            for kept, schema in (("errors", schemas.ERROR), ("progress", schemas.PROGRESS), ("log", LOG)):
                readers.empty(spark, schema).write.mode("overwrite").parquet(f"{root}/{kept}")
        per_wave = wave or max(1, n_batches)
        for first in range(0, n_batches, per_wave)[:stop_after]:
            batches = links if per_wave >= n_batches else links.filter(F.col("batch_no").between(first, first + per_wave - 1))
            with scratch(spark):
                _process_wave(spark, batches, sources, site, root, batch_size, start_index, start_index + first * batch_size, total)
        log = readers.read_table_files(spark, f"{root}/log", LOG, parts=True)
        P.run_summary(log, max_attempts=1).write.mode("overwrite").parquet(f"{root}/summary")
        catalog = catalog_table(spark, root)
        saved = catalog.read()
        writers.write_catalog(saved, fmt, f"{root}/export")
        catalog.retire(keep)
    return saved


def _process_wave(spark: SparkSession, batches: DataFrame, sources: Sources, site: Site, root: str, batch_size: int,
                  start_index: int, first: int, total: int) -> None:
    part = f"from-{first:015d}"
    records = extract_records(batches, sources, site)
    children = extract_children(records, sources)
    if catalog_table(spark, root).version():  # the rows of a first save are read once
        children = materialize(children, "children")
    save_catalog(catalog_rows(children), records, root)
    writers.write_errors(X.without_record(batches, records), f"{root}/errors", part)
    errors = readers.read_errors(spark, f"{root}/errors/{part}")
    _accounted(batches, errors, sources).write.mode("overwrite").parquet(f"{root}/log/{part}")
    log = spark.read.schema(LOG).parquet(f"{root}/log/{part}")
    before = readers.read_progress(spark, f"{root}/progress").filter(
        F.col("current_index") <= first).agg(F.max_by("stats", "current_index").alias("s")).first()["s"]
    counters = {c: before[c] or 0 for c in ("total_processed", "successful", "failed", "retried")} if before else None
    progress = P.progress_records(log, total, batch_size, max_attempts=1, start_index=start_index,
                                  retries=F.col("retries"), before=counters)
    writers.write_progress(progress, f"{root}/progress", part)


def resume(spark: SparkSession, sources: Sources, site: Site, root: str, batch_size: int = D.BATCH_SIZE,
           fmt: str = "json", wave: int | None = None) -> DataFrame:
    """Go on from the largest stored index, from the beginning if there is none."""
    stored = P.resume_index(readers.read_progress(spark, f"{root}/progress"))
    return process(spark, sources, site, root, batch_size, stored.first()["current_index"], fmt, wave)


def full(spark: SparkSession, start_urls: DataFrame, sources: Sources, site: Site, root: str,
         listed: DataFrame | None = None, max_groups: int | None = None, max_pages: int = D.MAX_PAGES,
         max_records: int | None = None, fmt: str = "json") -> DataFrame:
    """Single-phase run over what is pending; returns this run's nested records.

    The caps count only when links are discovered here, not for a kept frontier.
    """
    state, attempted = read_state(spark, root)
    listed = readers.empty(spark, schemas.LINK) if listed is None else listed
    added = materialize(R.new_links(state, listed), "frontier-new")

    def discovered() -> DataFrame:
        groups = materialize(find_groups(start_urls, sources, site, max_groups), "groups")
        return R.first_n(find_links(groups, sources, site, max_pages), max_records, "pos")

    with _streamed(spark):
        if state.unionByName(added).isEmpty():
            added = materialize(discovered(), "frontier-new")
        frontier = state.unionByName(added)
        todo = materialize(R.pending(frontier, attempted), "pending")
        records = extract_records(todo, sources, site)
        children = materialize(extract_children(records, sources), "children")
    writers.write_catalog(save_catalog(catalog_rows(children), records, root), fmt, f"{root}/export")
    write_state(added, todo, root)
    return nested_records(with_image_paths(records, sources, site), children)


def source_items(start_urls: DataFrame, sources: Sources, base: str, max_letters: int | None,
                 per_letter: int) -> DataFrame:
    """``(letter_pos, nth, url)``: up to ``per_letter`` items of each letter page."""
    captures = sources.pages()
    index = elements(_captured(start_urls, captures))
    letters = L.distinct_ordered(L.group_links(index, base, D.LETTER_SELECTORS), ["url", "pos"])
    letters = R.first_n(letters, max_letters, "url", "pos")
    letters = global_index(letters.select("link", "url", F.col("pos").alias("was")), ["url", "was"], "letter_pos")
    letters = materialize(letters.select(F.col("link").alias("url"), "letter_pos"), "letters")
    pages = _captured(letters, captures).join(letters, "url")
    items = L.page_links(elements(pages, ("letter_pos",)), base, D.ITEM_SELECTORS, ("letter_pos",))
    items = items.dropDuplicates(["letter_pos", "pos", "link"])  # of a page captured twice at one time
    chosen = L.top_links_per_group(items, ["letter_pos"], ["pos"], per_letter)
    return chosen.select("letter_pos", F.col("rank").alias("nth"), F.col("link").alias("url"))


def enrich(spark: SparkSession, start_urls: DataFrame, sources: Sources, base: str, second_base: str,
           root: str, per_letter: int = D.BATCH_SIZE, max_letters: int | None = 5,
           enrich_first: int | None = 10) -> DataFrame:
    """Records of one source, their gaps filled from another, written in three formats. Of
    repeated captures each page's newest is read, and with ``as_of`` only fresh ones."""
    captures = sources.pages()
    items = materialize(source_items(start_urls, sources, base, max_letters, per_letter), "items")
    fields = X.source_fields(elements(_captured(items, captures)), base).dropDuplicates(["url"])
    keyed = fields.join(items, "url").select("letter_pos", "nth", "english_name", "manufacturer",
                                             "description", "image_url")
    records = C.surrogate_key(materialize(keyed, "items"), ["letter_pos", "nth"], "id")
    records = C.source_record(records)

    search = query_url(f"{second_base}/search", {"s": F.col("english_name")})
    records = materialize(records.withColumn("search_url", search), "records")
    searched = records.select(F.col("search_url").alias("url"))
    hits = materialize(X.hit_fields(elements(_captured(searched, captures)), second_base).dropDuplicates(["url"]), "hits")
    products = X.product_fields(
        elements(_captured(hits.select(F.col("product_url").alias("url")), captures)), second_base).dropDuplicates(["url"])
    hits = E.second_hop_lookup(hits.withColumnRenamed("url", "search_url"), products, "product_url", "url") \
        .drop("url", "product_url")

    joined = records.join(hits, "search_url", "left")
    changes = E.filled(F.col("persian_name"), F.col("hit_name"), F.col("manufacturer"),
                       F.col("hit_manufacturer"), F.col("image_url"), F.col("hit_image"))
    result = E.enrich_first_n(joined, ["id"], enrich_first, changes, ["id"])
    result = materialize(result.select(*schemas.SOURCE_RECORD.fieldNames()), "enriched")
    writers.fan_out(result, f"{root}/export")
    return result
