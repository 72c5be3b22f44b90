"""Token counts: huge documents are encoded in overlapping chunks that are spliced where both agree.

A text of at most ``chunk`` characters is encoded where it lies. A longer one is cut into
chunks of which each runs ``overlap`` characters into the next, so that one document is the
work of many tasks. Every chunk gives, for both overlaps, its *boundaries*: the character a
boundary lies before, the token that ends there, the one that starts there, and how many
tokens stand before. The count is what lies between splices, summed.

Two neighbours are spliced at the first boundary of their overlap that both have, with the
same token on either side. That the result is the encoding of the whole follows from how byte pair
encoding merges: a sequence of pieces is the encoding of its text if every two adjacent
pieces stand side by side in an encoding of some text, because the first merge across a
boundary would have happened there too. Left of the splice all neighbours come from one
chunk, right of it from the other, and the two tokens at it from both. Bytes that stand for
a character without a piece are no evidence and never spliced at.

Where an overlap holds no such boundary (one letter repeated, for instance), the document is
cut anew with overlaps ``WIDER`` times as wide, and chunks at least four times that, until
it splices or is one chunk. An encoder that gives no boundaries ends there as well.

Equal long texts are encoded once. Only long texts are shuffled, once a round, and of their
chunks the boundaries in the overlaps; splicing is a join of chunk ``n`` with ``n + 1``.

Cases: a null or empty text has no tokens; repeated rows get equal counts; null ids are kept;
the length of a text is no limit, only the time of a text that never splices; other columns
are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagecatalog.session import materialize

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16
OVERLAP = 256
WIDER = 8
KEY = ("one", "two", "chars")  # of a text

#: A text to the ids of its tokens, and the number of characters that end with each (none if unknown).
Encoder = Callable[[str], tuple[np.ndarray, np.ndarray | None]]


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """The encoder in a file, and which of its ids are whole pieces, not bytes."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return (lambda text: (np.array(whole.encode(text, add_special_tokens=False).ids, np.int64), None)), np.zeros(0, bool)
    from sentencepiece import SentencePieceProcessor

    tool = SentencePieceProcessor(model_file=path)
    size = tool.get_piece_size()
    is_byte = np.array([tool.is_byte(i) for i in range(size)])
    pieces = [tool.id_to_piece(i) for i in range(size)]
    # a byte that goes on with a character adds none
    chars = np.array([not 0x80 <= int(p[1:-1], 16) < 0xC0 if b else len(p) for p, b in zip(pieces, is_byte)], np.int64)

    def encode(text: str) -> tuple[np.ndarray, np.ndarray | None]:
        ids = np.array(tool.encode(text, num_threads=1), np.int64)
        ends = np.cumsum(chars[ids]) - 1  # without the space that the encoder puts first
        return ids, ends if len(ids) and ends[-1] == len(text) else None

    return encode, ~is_byte


def boundaries(ids: np.ndarray, ends: np.ndarray | None, whole: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """``(at, left, right, nth)``: places from ``low`` to ``high`` with the tokens at both sides
    and the number of tokens before."""
    if ends is None:
        return (np.zeros(0, np.int64),) * 4
    nth = np.flatnonzero((ends[:-1] >= low) & (ends[:-1] <= high) & whole[ids[:-1]] & whole[ids[1:]])
    return ends[nth], ids[nth], ids[nth + 1], nth + 1


def cuts(chars: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the chunks of a text."""
    starts = range(0, max(1, chars - overlap), chunk)
    return [(s, min(chars, s + chunk + overlap)) for s in starts]


def _short(rows: DataFrame, path: str) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path)
        for batch in batches:
            counts = [len(encode(t)[0]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.select("doc_id", "n_bytes", "text").mapInArrow(of, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, (start, end) in enumerate(cuts(row["chars"], chunk, overlap)):
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in KEY} | {"n": n, "body": row["text"][start:end]}], schema=out)

    out = pa.schema([(k, pa.int64()) for k in (*KEY, "n")] + [("body", pa.string())])
    return rows.select(*KEY, "text").mapInArrow(of, "one bigint, two bigint, chars bigint, n bigint, body string")


_PLACES = "array<struct<at:bigint,left:int,right:int>>"


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk: the boundaries of the overlaps at its start and end; of the last, its number of tokens."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, whole = encoder(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                start = row["n"] * chunk
                ids, ends = encode(row["body"])
                last = start + len(row["body"]) == row["chars"]
                found = {k: row[k] for k in (*KEY, "n")} | {"tokens": len(ids) if last else 0}
                for name, low, wanted in (("head", 0, row["n"] > 0), ("tail", chunk, not last)):
                    at, left, right, nth = boundaries(ids, ends if wanted else None, whole, low, low + overlap)
                    found[name] = [{"at": a, "left": x, "right": y} for a, x, y in zip((at + start).tolist(), left.tolist(), right.tolist())]
                    found[name + "_nth"] = nth.tolist()
                out.append(found)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    place = pa.list_(pa.struct([("at", pa.int64()), ("left", pa.int32()), ("right", pa.int32())]))
    schema = pa.schema([(k, pa.int64()) for k in (*KEY, "n", "tokens")] + [
        (n + s, t) for n in ("head", "tail") for s, t in (("", place), ("_nth", pa.list_(pa.int32())))])
    return chunks.mapInArrow(of, "one bigint, two bigint, chars bigint, n bigint, tokens bigint, " + ", ".join(
        f"{n} {_PLACES}, {n}_nth array<int>" for n in ("head", "tail")))


def spliced(encoded: DataFrame) -> DataFrame:
    """``(*KEY, n_tokens)``: null where an overlap holds no boundary to splice at."""
    left = encoded.select(*KEY, F.col("n").alias("seam"), "tail", "tail_nth")
    right = encoded.filter("n > 0").select(*KEY, (F.col("n") - 1).alias("seam"), "head", "head_nth")
    nth = lambda side: F.get(f"{side}_nth", F.array_position(F.col(side), F.col("at")).cast("int") - 1)
    seams = left.join(right, [*KEY, "seam"]).withColumn("at", F.get(F.array_intersect("tail", "head"), 0))
    seams = seams.groupBy(*KEY).agg(F.sum(nth("tail") - nth("head")).alias("shift"), F.count_if(F.col("at").isNull()).alias("apart"))
    sums = encoded.groupBy(*KEY).agg(F.sum("tokens").alias("tokens"))
    total = F.when(F.coalesce("apart", F.lit(0)) == 0, F.col("tokens") + F.coalesce("shift", F.lit(0)))
    return sums.join(seams, list(KEY), "left").select(*KEY, total.alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs (doc_id, text)``, as the library
    that reads the file ``path`` counts whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.xxhash64(text, F.lit(1)).alias("one"), F.xxhash64(F.lit(2), text).alias("two"), F.length(text).cast("long").alias("chars"))
    short, long = rows.filter(F.col("chars") <= chunk), rows.filter(F.col("chars") > chunk)
    wanted, found = long, []
    while True:
        step = max(chunk, 4 * overlap)
        # copies of a long text share its chunks; the shuffle also spreads one document over tasks
        chunks = _chunks(wanted, step, overlap).dropDuplicates([*KEY, "n"])
        counts = materialize(spliced(materialize(_encoded(chunks, path, step, overlap), "token-chunks")), "token-counts")
        found.append(counts.filter("n_tokens is not null"))
        apart = counts.filter("n_tokens is null").select(*KEY)
        if apart.isEmpty():
            break
        wanted, overlap = long.join(apart, list(KEY), "left_semi"), overlap * WIDER
    counted = long.select("doc_id", "n_bytes", *KEY).join(reduce(DataFrame.union, found), list(KEY))
    return _short(short, path).union(counted.select("doc_id", "n_bytes", "n_tokens"))
