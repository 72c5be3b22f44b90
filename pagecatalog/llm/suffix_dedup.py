"""Removal of repeated byte strings, found by interval expansion on a Burrows-Wheeler transform.

A corpus has no suffix array in one task, so suffixes are dealt out first: every string of
``length`` bytes goes to the ``k``-byte piece in it that has the least hash (its seed),
together with its neighbours that go to the same one. Equal strings have equal seeds, so
all that can repeat each other meet.

1. Seeds of all documents are counted by hash. One that occurs once is done with.
2. Stretches around a seed that are equal as a whole repeat each other, all of them.
3. Of seeds with unequal stretches, each different stretch goes once to the task of its
   seed. There the suffixes are sorted, transformed, and intervals of equal prefixes are
   expanded backwards, breadth first: the first round settles where common prefixes are
   0 bytes long, the next 1 byte, and so on. It stops at ``length``: what is not settled
   by then has a common prefix of at least that many bytes.
4. Strings that repeat are joined to maximal runs and their bytes removed.

A seed with more than ``crowd`` unequal stretches is not gathered in one task; its strings
are dealt on by their own hash and counted there with map-side partials.

Hashes of seeds (one for about 140 bytes) and texts of documents with unequal stretches are
shuffled, and texts once more for the result.

Cases: a null text is empty; repeated rows repeat each other; a null id makes no difference;
texts shorter than ``length`` stay whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagecatalog.llm.common import keyed
from pagecatalog.llm.substring_dedup import _SPAN_BITS, anchors, as_span, covered, gram_hashes, mixed, of_span
from pagecatalog.session import discard, materialize

_U = np.uint64
_BYTE = mixed(np.arange(1, 257, dtype=_U))
_BLOCK = 1_000_000  # bytes that are sorted together, or one seed's if those are more


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` symbols at least."""
    n, width = len(text), 7
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key * 512 + padded[i:i + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if width >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (n + 1) + after
        width *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where, in the order of suffixes, one shares ``length`` symbols or more with the one before.

    Symbol 0 ends a stretch and is never part of a prefix. ``text`` ends with it.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1]  # the transform; the last symbol, 0, stands before the first
    came = place[order - 1]  # where the suffix that is one symbol longer stands
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)
        symbol = before[at]
        real = symbol > 0
        to, owner, symbol = came[at[real]], owner[real], symbol[real]
        by = np.argsort(to)
        to, owner, symbol = to[by], owner[by], symbol[by]
        if not len(to):
            break
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        new = ~settled[high]
        low, high = low[new], high[new]
        settled[high] = True
        if not len(low):
            break
    return ~settled[:n]


def repeated_starts(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """Of each stretch, the starts of strings of ``length`` bytes that start elsewhere too."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    text = np.zeros(total, np.int16)
    raw = np.frombuffer(b"".join(stretches), np.uint8)
    inside = np.ones(total, bool)
    inside[begin + sizes] = False
    text[inside] = raw.astype(np.int16) + 1
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(total)  # symbols before the stretch ends
    order = suffix_order(text, length)
    fits = left[order] >= length
    again = long_prefixes(text, order, length)
    again[1:] &= fits[1:] & fits[:-1]
    found = np.zeros(total, bool)
    rows = np.flatnonzero(again)
    found[order[rows]] = True
    found[order[rows - 1]] = True
    return [np.flatnonzero(found[b:b + s]) for b, s in zip(begin, sizes)]


def seeds_of(raw: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    grams = gram_hashes(_BYTE[np.frombuffer(raw, np.uint8)], k)
    place, first, last = anchors(grams, length - k + 1)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b + length], seed=p - a)
                         for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())), _U, len(place))
    return first, last, mixed(grams[place]), whole


def seed_rows(rows: DataFrame, length: int, k: int) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [seeds_of(t.encode("utf-8", "surrogatepass"), length, k) for t in batch["text"]]
            n = [len(p[0]) for p in parts]
            out = {c: np.repeat(batch[c].to_numpy(), n) for c in ("rid", "th")}
            out["span"] = np.concatenate([as_span(p[0], p[1]) for p in parts])
            for i, c in enumerate(("seed", "class"), 2):
                out[c] = np.concatenate([p[i] for p in parts]).view(np.int64)
            yield pd.DataFrame(out)

    return rows.select("rid", "th", "text").mapInPandas(
        of, "rid bigint, th bigint, span bigint, seed bigint, class bigint")


def stretches_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted stretches as bytes; of crowded seeds, a digest of each string instead."""
    names = ["seed", "crowded", "first", "body", "rid", "th"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for rid, th, text, runs in zip(batch["rid"], batch["th"], batch["text"], batch["runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    (first, last), seed = of_span(int(r["span"])), r["seed"]
                    if r["crowded"]:
                        out += [(seed, True, i, xxhash.xxh3_128_digest(raw[i:i + length]), rid, th) for i in range(first, last + 1)]
                        size += 32 * (last + 1 - first)
                    else:
                        out.append((seed, False, first, raw[first:last + length], rid, th))
                        size += last + length - first
                if size >= 4 * _BLOCK:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    runs = wanted.groupBy("rid", "th").agg(F.collect_set(F.struct("span", "seed", "crowded")).alias("runs"))
    return rows.select("rid", "th", "text").join(runs, ["rid", "th"]).mapInPandas(
        of, "seed bigint, crowded boolean, first int, body binary, rid bigint, th bigint")


def expanded(stretches: DataFrame, length: int) -> DataFrame:
    """``(rid, th, span)``: runs of strings that repeat among the stretches of a seed."""
    def solved(rows: list[tuple]) -> pd.DataFrame:
        ids, spans = [], []
        for (_, rid, th, first, _), places in zip(rows, repeated_starts([r[4] for r in rows], length)):
            if len(places):
                cut = np.flatnonzero(np.diff(places) > 1)
                spans.append(as_span(first + places[np.append(0, cut + 1)], first + places[np.append(cut, len(places) - 1)]))
                ids += [(rid, th)] * len(spans[-1])
        found = pd.DataFrame(ids, columns=["rid", "th"], dtype=np.int64)
        return found.assign(span=np.concatenate(spans) if spans else np.zeros(0, np.int64))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:  # the stretches of a seed are neighbours
            for row in zip(*(batch[c].tolist() for c in ("seed", "rid", "th", "first", "body"))):
                if size >= _BLOCK and held[-1][0] != row[0]:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solved(held)

    return (stretches.filter("not crowded").select("seed", "rid", "th", "first", "body")
            .repartition("seed").sortWithinPartitions("seed")
            .mapInPandas(of, "rid bigint, th bigint, span bigint"))


def repeated_spans(rows: DataFrame, length: int, k: int, crowd: int) -> DataFrame:
    """``(rid, th, spans)``: of every row that holds some, its runs of strings that repeat."""
    seeds = materialize(seed_rows(rows, length, k), "byte-seeds")
    # written out, so that a seed that very many rows share can be split in the join
    often = materialize(seeds.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n > 1").select("seed"), "byte-seeds-often")
    met = materialize(seeds.join(often, "seed"), "byte-seeds-met")
    discard(seeds, often)
    classes = materialize(met.groupBy("seed", "class").agg(
        F.count("*").alias("times"), F.min(F.struct("rid", "th", "span")).alias("at")), "byte-classes")
    twice = materialize(classes.filter("times > 1").select("seed", "class"), "byte-classes-twice")
    whole = materialize(met.join(twice, ["seed", "class"]).select("rid", "th", "span"), "byte-repeats-whole")
    unequal = classes.groupBy("seed").agg(F.count("*").alias("_kinds"), F.min("times").alias("_least")).filter(
        "_kinds > 1 and _least = 1").select("seed", (F.col("_kinds") > crowd).alias("crowded"))
    wanted = materialize(classes.join(materialize(unequal, "byte-seeds-unequal"), "seed").select("at.*", "seed", "crowded"), "byte-wanted")
    discard(met, twice, classes)
    stretches = materialize(stretches_of(rows, wanted, length), "stretches")
    single = stretches.filter("crowded")
    again = materialize(single.groupBy("seed", "body").agg(F.count("*").alias("_n")).filter("_n > 1").select("seed", "body"), "strings-twice")
    again = single.join(again, ["seed", "body"]).select("rid", "th", F.shiftleft(F.col("first").cast("long"), _SPAN_BITS).alias("span"))
    found = whole.union(expanded(stretches, length)).union(again)
    found = materialize(found.groupBy("rid", "th").agg(F.collect_set("span").alias("spans")), "byte-repeats")
    discard(whole, wanted, stretches)
    return found


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 128, crowd: int = 4096, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and
    ``kept``, the remaining bytes (null unless ``texts``; a cut may split a character)."""
    rows = keyed(docs)
    spans = repeated_spans(rows, length, k, crowd)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                runs = covered([] if found is None else [of_span(int(x)) for x in found], length, len(raw))
                ends = [0, *(x for run in runs for x in run), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((doc_id, len(raw), len(raw) - len(left), len(runs), sha256(left).hexdigest(), left if texts else None))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return rows.join(spans, ["rid", "th"], "left").mapInPandas(of, _RESULT)
