"""Language identification by compression.

Of each language, a bounded sample of labelled texts becomes a raw-content dictionary for
zstandard. A text is compressed once with each dictionary; the language whose dictionary
makes it smallest is predicted. A text whose two best sizes are nearly equal is rejected.

Letters alone tell languages apart, so texts and samples are lower-cased and everything that
is no letter becomes a space. A long text is compressed in pieces of ``PIECE`` characters
whose sizes add up: it would otherwise soon be compressed by its own beginning. Pieces
cover the whole text.

The bound on learning: ``SAMPLE_ROWS`` ids per language, the first in a fixed shuffled order,
one text of each, the one with the least hash. Of a long text, ``SAMPLE_PIECES`` pieces spread
evenly over the whole of it make up its ``SAMPLE_CHARS`` characters. All other steps read every
text whole.

Cases: a null or empty text, or one with no letter, is ``und`` with score 0 and rejected.
Repeated rows get equal answers; ties go to the language that sorts first. With no labelled
row there is nothing to predict and every row is ``und``. A null id or language is not
learned from. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE_ROWS = 60
SAMPLE_CHARS = 4000
SAMPLE_PIECES = 20
PIECE = 2048
#: Of zstandard. Levels below match too coarsely for short texts, levels above cost far more for less.
LEVEL = 9
#: Share of the size by which the best language has to be smaller than the next.
MARGIN = 0.01
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def spread_sample(text: Column) -> Column:
    """A text of at most ``SAMPLE_CHARS`` characters, or as many from places all over it."""
    size = SAMPLE_CHARS // SAMPLE_PIECES
    room = F.length(text).cast("double") - size
    pieces = [F.substring(text, (F.floor(room * i / (SAMPLE_PIECES - 1)) + 1).cast("int"), F.lit(size)) for i in range(SAMPLE_PIECES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *pieces))


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary per language of ``labelled (doc_id, text, lang)``.

    The driver holds ``SAMPLE_ROWS * SAMPLE_CHARS`` characters per language, however often an
    id repeats. Which rows to take is decided on ids and hashes alone; Spark keeps the first of
    each language in every task before it compares them across tasks.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    said = F.xxhash64("text")
    chosen = (labelled.filter("lang is not null and doc_id is not null").groupBy("lang", "doc_id").agg(F.min(said).alias("_said"))
              .withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= SAMPLE_ROWS))
    sample = labelled.select("doc_id", "lang", said.alias("_said"), spread_sample(F.col("text")).alias("sample")).join(
        F.broadcast(chosen), ["doc_id", "lang", "_said"])  # SAMPLE_ROWS per language
    sample = sample.groupBy("lang", "_place").agg(F.min("sample").alias("sample"))  # rows that repeat as a whole
    found: dict[str, list[tuple[int, str]]] = {}
    for row in sample.select("lang", "_place", "sample").collect():
        found.setdefault(row["lang"], []).append((row["_place"], letters(row["sample"])))
    return {lang: "\n".join(t for _, t in sorted(texts)).encode() for lang, texts in sorted(found.items())}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, data in sorted(dictionaries.items()):
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        made.append((lang, zstandard.ZstdCompressor(dict_data=words, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False)))
    return made


def sizes(text: str, tools: list[tuple[str, zstandard.ZstdCompressor]]) -> list[int]:
    pieces = [text[i:i + PIECE].encode("utf-8", "surrogatepass") for i in range(0, len(text), PIECE)]
    return [sum(len(tool.compress(p)) for p in pieces) for _, tool in tools]


def identify(text: str | None, tools: list[tuple[str, zstandard.ZstdCompressor]], margin: float = MARGIN) -> tuple[str, float, bool]:
    """``(language, score, rejected)``; the score is 0.5 for equal sizes and nears 1 with the margin."""
    text = letters(text)
    if not text or not tools:
        return UNKNOWN, 0.0, True
    ranked = sorted((n, lang) for n, (lang, _) in zip(sizes(text, tools), tools))
    if len(ranked) == 1:
        return ranked[0][1], 1.0, False
    (best, lang), (second, _) = ranked[:2]
    gap = (second - best) / second
    return lang, round(0.5 + 0.5 * min(1.0, gap / (10 * margin)), 6) if margin else 1.0, gap < margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, *keep: str, prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred, score, rejected``, for every row.

    ``prefix`` stands before the new names, for tables that have columns of these names.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(dictionaries)
        for batch in batches:
            found = [identify(t, tools, margin) for t in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, names=names)

    rows = docs.select(*keep, F.col("text").alias(f"{prefix}_read"))
    names = [*keep, *(prefix + n for n in ("lang_pred", "score", "rejected"))]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(of, f"{kept}, {prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean")
