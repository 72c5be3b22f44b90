"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagecatalog.llm import (
    decontaminate, filter_audit, hard_negatives, language_id, mixing, quality, secret_scan, sharding, simhash_dedup,
    substring_dedup, suffix_dedup, syncmers, token_counts)
from pagecatalog.llm.common import documents, keyed, remainder, unsigned_hex
from pagecatalog.plans.registry import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find(documents(spark, folder))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("base", "linked")).alias("spans"))


ORACLES["op2_suffix_array"] = """
WITH rows AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
strings AS (SELECT doc_id, pos, md5(bytes[pos + 1:pos + 400]) AS said
    FROM (SELECT doc_id, bytes, unnest(range(octet_length(bytes) - 399)) AS pos FROM rows)),
often AS (SELECT said FROM strings GROUP BY said HAVING count(*) > 1),
repeats AS (SELECT doc_id, pos, pos - lag(pos, 1, -1000) OVER (PARTITION BY doc_id ORDER BY pos) > 400 AS opens
    FROM strings SEMI JOIN often USING (said)),
spans AS (SELECT doc_id, min(pos) AS start, max(pos) + 400 AS stop FROM (SELECT doc_id, pos,
    count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM repeats) GROUP BY doc_id, nth),
pieces AS (SELECT doc_id, start, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since, stop FROM spans),
kept AS (SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last_stop,
    string_agg(hex(bytes[since + 1:start]), '' ORDER BY start) AS head
    FROM pieces JOIN rows USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(bytes)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(head, '') || hex(bytes[coalesce(last_stop, 0) + 1:]))) AS kept_sha256
FROM rows LEFT JOIN kept USING (doc_id)"""


@query
def op2_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, folder), length=400, texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, folder), shingle=3, distance=2)
    return found.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


ORACLES["op4_substring"] = """
WITH rows AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
windows AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS said
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM rows)),
firsts AS (SELECT said, min(doc_id) AS first_id FROM windows GROUP BY said HAVING count(*) > 1),
repeats AS (SELECT doc_id, pos, doc_id > first_id AS repeated FROM windows JOIN firsts USING (said)),
gone AS (SELECT DISTINCT doc_id, pos + step AS pos FROM (SELECT doc_id, pos FROM repeats WHERE repeated), range(50) AS steps(step)),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM rows),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept
    FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM rows LEFT JOIN kept USING (doc_id)"""


@query
def op4_substring(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, folder), window=50, texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(keyed(documents(spark, folder)), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    dictionaries = language_id.learn(docs.filter("not held_out"))
    return language_id.predict(docs, dictionaries, language_id.MARGIN, "doc_id", "held_out")


@query
def op7_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    found = syncmers.compare(documents(spark, folder))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.as_text(F.col("sketch")).alias("fingerprint"), syncmers.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder), shards=8)


ORACLES["op9_mixing"] = """
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM rows GROUP BY source),
weighted AS (SELECT source, source_size, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
timed AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (dry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (dry ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS time
    FROM weighted WINDOW dry AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
spent AS (SELECT (SELECT time FROM timed WHERE time * weight <= 3 * source_size
    ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1) AS time),
targets AS (SELECT source, source_size, weight, least(coalesce(spent.time * weight, 3 * source_size), 3 * source_size)::DOUBLE AS target
    FROM weighted, spent),
queued AS (SELECT doc_id, shuffled, size, source_size, target, weight, floor(target)::BIGINT AS cut,
    (sum(size) OVER (PARTITION BY targets.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
    FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source),
served AS (SELECT *, (start + size)::DOUBLE / weight AS finish,
    least(cut, start + size) - least(cut, start) + least(cut, start + source_size + size) - least(cut, start + source_size)
    + least(cut, start + 2 * source_size + size) - least(cut, start + 2 * source_size) AS taken FROM queued)
SELECT doc_id, size, source_size, target, taken,
    CASE WHEN taken > 0 THEN row_number() OVER (ORDER BY taken = 0, finish, shuffled, doc_id) - 1 END AS turn FROM served"""


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "turn")


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    labels = table(spark, folder, "labels").filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.learn(docs, labels), "doc_id", "held_out")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(documents(spark, folder), public_tokenizers.path(token_counts.MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


ORACLES["op12_hard_negatives"] = """
WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), every=100, label=moved)


ORACLES["op13_filter_audit"] = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
copies AS (SELECT md5(text) AS said, min(doc_id) AS first FROM texts GROUP BY said),
measured AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
masks AS (SELECT doc_id, part, (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
    + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first, false)::INTEGER AS mask
    FROM measured JOIN copies ON md5(text) = said),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
prefixes(prefix, letter, bit, before, step) AS (SELECT '', '', 0, 0, 0 UNION ALL
    SELECT prefix || l.letter, l.letter, l.bit, before | p.bit, step + 1 FROM prefixes p JOIN letters l ON (before | p.bit) & l.bit = 0),
metrics AS (SELECT part, prefix, letter, step, sum(n) FILTER (mask & (before | bit) = 0) AS kept,
    sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
    FROM prefixes CROSS JOIN cells WHERE step > 0 GROUP BY part, prefix, letter, step),
steps AS (SELECT part, o.prefix AS filter_order, m.* EXCLUDE (part, prefix) FROM metrics m
    JOIN (SELECT prefix FROM prefixes WHERE step = 5) o ON m.prefix = left(o.prefix, m.step::BIGINT))
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM steps"""


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(documents(spark, folder), table(spark, folder, "labels"))
