"""Removal of repeated passages of words: seed on winnowed anchors, extend both ways.

Winnowing picks, of every ``window`` consecutive words, the k-gram of words with the least
hash, the first of equals. Two equal windows pick the same one, so occurrences of a k-gram
(a *seed*) that are joined on its hash meet whenever a passage of ``window`` words is
shared. A seed's *reach* is the run of windows that pick it: the words it can be extended
over, to the left and to the right.

1. Seeds of all documents are counted by hash, and those that occur again joined on it; one
   that no two documents hold is dropped.
2. Seeds are extended both ways to the end of their reach. Those that agree all the way
   (one class) repeat each other's windows, all of them.
3. Of classes that share a seed but part before the ends, one document each, the first, is
   extended word by word: for every split of the window into words left and right of the
   seed, those that agree on both sides meet.
4. Windows found twice are joined to maximal runs, and their words are removed wherever a
   document with a smaller id has them.

Only hashes of seeds (about one for 20 words) and the texts of documents with classes that
part are shuffled, and texts once more at the end. Every step that brings equal things
together is an aggregation with map-side partials or a join with one row per key on one
side, so a passage that a third of the documents hold is not gathered in one task. A row
is known by its id and the hash of its text, and what is written out between the steps is
discarded as soon as the next step is.

Cases: a null text has no words; an id that is null is not smaller than any, and nothing is
removed from its row; rows that repeat an id are one document; a text shorter than a window
stays as it is; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagecatalog.llm.common import keyed
from pagecatalog.session import discard, materialize

_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_PLACE_BITS = 30  # of a sort key: a text has fewer words than 2**30


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of each number."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(items: np.ndarray, k: int, base: np.uint64 = _M1) -> np.ndarray:
    """Hash of each run of ``k`` items, by doubling; shorter input gives none."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    done, length, power = None, 0, items
    size, factor = 1, base
    with np.errstate(over="ignore"):
        while True:
            if k & size:  # append the run of ``size`` that starts where the part done ends
                done, length = (power, size) if done is None else (
                    done[:len(items) - length - size + 1] * factor + power[length:length + len(items) - length - size + 1],
                    length + size)
            if size * 2 > k:
                break
            power = power[:-size] * factor + power[size:]
            factor = factor * factor
            size *= 2
    return done


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys, by doubling."""
    least, size = keys, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that pick the same k-gram: its place, first and last window."""
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    keys = (mixed(hashes) >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(hashes), dtype=_U)
    place = (sliding_least(keys, width) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.append(first[1:], len(place)) - 1


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))


def seeds_of(text: str, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each seed: first and last window that pick it, its hash, and the hash of all words
    within reach together with where the seed lies in them."""
    words = word_hashes(text)
    grams = gram_hashes(words, k)
    place, first, last = anchors(grams, window - k + 1)
    if not len(place):
        return first, last, grams[:0], grams[:0]
    with np.errstate(over="ignore"):
        spans = np.zeros(len(place), _U)
        by_length = last - first
        for extra in np.unique(by_length):  # one length of reach at a time, at most window - k + 1
            at = by_length == extra
            spans[at] = gram_hashes(words, window + int(extra), _M2)[first[at]]
        shape = mixed((place - first).astype(_U) * _U(1 << 20) + by_length.astype(_U))
        return first, last, mixed(grams[place]), mixed(spans ^ shape)


ROW = ("doc_id", "th")
_SPAN_BITS = 31
_SEED_ROWS = "doc_id bigint, th bigint, span bigint, seed bigint, class bigint"


def as_span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First and last window in one number: half the width of a row that is shuffled."""
    return (first.astype(np.int64) << _SPAN_BITS) | (last - first)


def of_span(span: int) -> tuple[int, int]:
    first = span >> _SPAN_BITS
    return first, first + (span & ((1 << _SPAN_BITS) - 1))


def seed_rows(rows: DataFrame, window: int, k: int) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [seeds_of(t, window, k) for t in batch["text"]]
            n = [len(p[0]) for p in parts]
            out = {c: np.repeat(batch[c].to_numpy(), n) for c in ROW}
            out["span"] = np.concatenate([as_span(p[0], p[1]) for p in parts])
            for i, c in enumerate(("seed", "class"), 2):
                out[c] = np.concatenate([p[i] for p in parts]).view(np.int64)
            yield pd.DataFrame(out)

    return rows.filter("doc_id is not null").select(*ROW, "text").mapInPandas(of, _SEED_ROWS)


def extended_windows(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Of each wanted seed, its windows, each with a hash of all its words; equal windows hold
    the seed at the same place, so that is all there is to compare."""
    def frame(parts: list[tuple]) -> pd.DataFrame:
        n = [len(p[2]) for p in parts]
        at, one, two = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        return pd.DataFrame({"doc_id": np.repeat([p[0] for p in parts], n), "th": np.repeat([p[1] for p in parts], n),
                             "span": as_span(at, at), "one": mixed(one).view(np.int64), "two": mixed(two).view(np.int64)})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, th, text, spans in zip(*(batch[c] for c in (*ROW, "text", "spans"))):
                words = word_hashes(text)
                at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in map(of_span, map(int, spans))]))
                parts.append((doc_id, th, at, gram_hashes(words, window)[at], gram_hashes(words, window, _M2)[at]))
                size += len(at)
                if size >= 200_000:
                    yield frame(parts)
                    parts, size = [], 0
        if parts:
            yield frame(parts)

    spans = wanted.groupBy(*ROW).agg(F.collect_set("span").alias("spans"))
    return rows.select(*ROW, "text").join(spans, list(ROW)).mapInPandas(
        of, "doc_id bigint, th bigint, span bigint, one bigint, two bigint")


def repeated_spans(rows: DataFrame, window: int, k: int) -> DataFrame:
    """``(doc_id, th, span)``: runs of windows that a document with a smaller id has too."""
    seeds = materialize(seed_rows(rows, window, k), "seeds")
    # small sides are written out, so that a seed that very many rows share can be split in the joins
    often = materialize(seeds.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n > 1").select("seed"), "seeds-often")
    met = materialize(seeds.join(often, "seed"), "seeds-met")
    discard(seeds, often)
    classes = met.groupBy("seed", "class").agg(F.min("doc_id").alias("class_doc"), F.max("doc_id").alias("_last"))
    classes = materialize(classes, "seed-classes")
    shared = materialize(classes.groupBy("seed").agg(
        F.min("class_doc").alias("_least"), F.max("_last").alias("_most"), (F.count("*") > 1).alias("parts")).filter(
        "_least < _most").select("seed", "parts"), "seeds-shared")
    compared = materialize(classes.join(shared, "seed").drop("_last"), "seed-classes-shared")
    judged = materialize(met.join(compared, ["seed", "class"]).select(
        *ROW, "span", "parts", (F.col("doc_id") > F.col("class_doc")).alias("repeats")).filter("repeats or parts"), "seeds-judged")
    discard(met, classes, shared, compared)
    whole = judged.filter("repeats").select(*ROW, "span")
    windows = materialize(extended_windows(rows, judged.filter("parts and not repeats"), window), "seed-windows")
    key = ["one", "two"]
    earliest = materialize(windows.groupBy(*key).agg(
        F.min("doc_id").alias("window_doc"), F.max("doc_id").alias("_most")).filter("window_doc < _most").drop("_most"), "window-docs")
    again = windows.join(earliest, key).filter("doc_id > window_doc").select(*ROW, "span")
    found = materialize(whole.union(again).groupBy(*ROW).agg(F.collect_set("span").alias("spans")), "repeats")
    discard(judged, windows, earliest)
    return found


def covered(runs: list, window: int, n: int) -> list[tuple[int, int]]:
    """Maximal repeats: the union of windows, as ``[start, end)``, of a text of ``n`` items."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + window)
        else:
            out.append([first, last + window])
    return [(a, min(b, n)) for a, b in out]


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 12, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept``,
    the remaining words joined by one space (null unless ``texts``)."""
    rows = keyed(docs)
    spans = repeated_spans(rows, window, k)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["spans"]):
                words = text.encode("utf-8", "surrogatepass").split()
                kept, at = [], 0
                found = [] if found is None else [of_span(int(x)) for x in found]
                for start, end in covered(found, window, len(words)):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                left = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), sha256(left).hexdigest(),
                            left.decode("utf-8", "surrogatepass") if texts else None))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
            yield frame.astype({"doc_id": "Int64"})

    return rows.select(*ROW, "text").join(spans, list(ROW), "left").mapInPandas(of, _RESULT)
