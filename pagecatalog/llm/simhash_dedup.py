"""SimHash near-duplicates: fingerprints, and a self-join of the binary trie that they form.

Fingerprints are cut into one block more than the bits that may differ, so two that
link agree on one block at least. For each block, fingerprints are rotated so that it
leads, and dealt out by its value: that is the trie below the depth at which no bit has
differed yet. Each task walks its part of the trie from pairs of nodes to pairs of their
children, adds up the bits in which the paths differ, and drops a pair beyond the limit.

A block value that very many fingerprints share is dealt again, by pairs of nodes some
levels further down; each such pair is a start of its own with its difference so far.

Cases: a null, empty or blank text has fingerprint zero and links like any other; repeated
rows and ties give one fingerprint each; a null id never names a component that has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagecatalog.llm.common import keyed
from pagecatalog.llm.components import connected_components
from pagecatalog.session import materialize

BITS = 64
_CHUNK = 1 << 16  # shingles whose bits are held at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in more than half the hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + shingle]), 42) for i in range(n)), np.uint64, n)
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, n, _CHUNK):
        part = hashes[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, rid, th, fp)`` of every row; ``fp`` holds the 64 bits as a signed number."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "rid", "th")] + [pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "th", "fp"])

    return keyed(docs).mapInArrow(of, "doc_id bigint, rid bigint, th bigint, fp bigint")


def _widths(distance: int) -> list[int]:
    base, extra = divmod(BITS, distance + 1)
    return [base + (i < extra) for i in range(distance + 1)]


def _children(lo, hi, ones):
    split = hi - (ones[hi] - ones[lo])
    return (lo, split), (split, hi)


def trie_pairs(keys: np.ndarray, starts: list[tuple[np.ndarray, ...]], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``keys`` that differ in ``distance`` bits at most, below the given node pairs.

    ``keys`` are sorted within every node. A node is a range of them; ``starts`` holds,
    per depth, the pairs of ranges ``(lo, hi, lo2, hi2, differing)`` to start from there.
    """
    empty = np.zeros(0, np.int64)
    front, found = (empty,) * 5, []
    for depth in range(BITS + 1):
        front = tuple(np.concatenate([f, s]) for f, s in zip(front, starts[depth])) if starts[depth] else front
        a, b, c, d, diff = front
        if not len(a):
            continue
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            i, j = i[i != j], j[i != j]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= distance
            found.append((i[near], j[near]))
            a, b, c, d, diff = (x[~single] for x in (a, b, c, d, diff))
        if depth == BITS:
            break
        bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        (a0, b0), (a1, b1) = _children(a, b, ones)
        (c0, d0), (c1, d1) = _children(c, d, ones)
        same = a == c
        cross = ~same  # of a node with itself, the two mixed pairs are one
        front = tuple(np.concatenate(x) for x in zip(
            (a0, b0, c0, d0, diff), (a1, b1, c1, d1, diff), (a0, b0, c1, d1, diff + 1),
            tuple(x[cross] for x in (a1, b1, c0, d0, diff + 1))))
        a, b, c, d, diff = front
        keep = (diff <= distance) & (b > a) & (d > c)
        front = tuple(x[keep] for x in front)
    if not found:
        return empty, empty
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's group, given linked pairs."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _links_of_part(part: pd.DataFrame, widths: list[int], levels: int, distance: int) -> pd.DataFrame:
    """Links that tie together what is near within one task's groups."""
    part = part.sort_values(["rotation", "block", "lower", "upper", "key"], ignore_index=True, kind="stable")
    keys = part["key"].to_numpy().view(np.uint64)
    keys = keys ^ np.uint64(1 << 63)  # sorted as signed numbers until here
    n = len(keys)
    cols = part[["rotation", "block", "lower", "upper"]].to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (cols[1:] != cols[:-1]).any(axis=1)]))
    end = np.append(new[1:], n)
    rotation, lower, upper = (part[c].to_numpy()[new] for c in ("rotation", "lower", "upper"))
    starts: list = [[] for _ in range(BITS + 1)]
    zero = lambda x: np.zeros(len(x), np.int64)
    for r, width in enumerate(widths):
        whole = (rotation == r) & (lower < 0)
        starts[width].append((new[whole], end[whole], new[whole], end[whole], zero(new[whole])))
        within = (rotation == r) & (lower >= 0) & (lower == upper)
        starts[width + levels].append((new[within], end[within], new[within], end[within], zero(new[within])))
        across = (rotation == r) & (lower >= 0) & (lower != upper)
        if across.any():
            lo, hi = new[across], end[across]
            below = ((keys >> np.uint64(BITS - width - levels)) & np.uint64((1 << levels) - 1)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(below == part["lower"].to_numpy())])
            mid = lo + first[hi] - first[lo]
            apart = np.bitwise_count(np.bitwise_xor(lower[across], upper[across])).astype(np.int64)
            starts[width + levels].append((lo, mid, mid, hi, apart))
    starts = [tuple(np.concatenate(x).astype(np.int64) for x in zip(*s)) if s else () for s in starts]
    left, right = trie_pairs(keys, starts, distance)
    if not len(left):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    names, where = np.unique(part["fp"].to_numpy(), return_inverse=True)
    root = _roots(len(names), where[left], where[right])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[moved], "b": names[root[moved]]})


def near_links(distinct: DataFrame, distance: int = 2, hot: int = 50_000, levels: int = 8) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``, enough to join all that are
    near each other, directly or by a chain. ``hot``: fingerprints of one block value
    above which that value is dealt again, by node pairs ``levels`` further down."""
    widths = _widths(distance)
    offsets = [sum(widths[:i]) for i in range(len(widths))]
    rotated = [F.struct(F.lit(i).alias("rotation"),
                        (F.shiftleft("fp", o).bitwiseOR(F.shiftrightunsigned("fp", BITS - o)) if o else F.col("fp")).alias("key"),
                        ) for i, o in enumerate(offsets)]
    width = f"element_at(array({', '.join(map(str, widths))}), rotation + 1)"
    rows = (distinct.select("fp", F.inline(F.array(*rotated)))
            .withColumn("block", F.expr(f"shiftrightunsigned(key, {BITS} - {width})"))
            .withColumn("below", F.expr(
                f"cast(shiftrightunsigned(key, {BITS - levels} - {width}) & {(1 << levels) - 1} as int)")))
    crowded = materialize(rows.groupBy("rotation", "block").agg(F.count("*").alias("n")).filter(f"n > {hot}").select(
        "rotation", "block", F.lit(True).alias("hot")), "simhash-crowded")
    marked = rows.join(crowded, ["rotation", "block"], "left")
    masks = [m for m in range(1 << levels) if bin(m).count("1") <= distance]
    others = F.expr(f"transform(array({','.join(map(str, masks))}), m -> below ^ m)")
    dealt = marked.withColumn("other", F.explode(F.when(F.col("hot"), others).otherwise(F.array(F.lit(-1)))))
    dealt = dealt.select(
        "rotation", "block", "fp", F.expr("key ^ (-9223372036854775807L - 1L)").alias("key"),
        F.when(F.col("other") < 0, -1).otherwise(F.least("below", "other")).alias("lower"),
        F.when(F.col("other") < 0, -1).otherwise(F.greatest("below", "other")).alias("upper"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:  # groups arrive in order; a part ends where a group does
            held.append(batch)
            size += len(batch)
            if size < 4 * hot:
                continue
            part = pd.concat(held, ignore_index=True)
            group = part[["rotation", "block", "lower", "upper"]]
            last = (group == group.iloc[-1]).all(axis=1)
            if not last.all():
                yield _links_of_part(part[~last].reset_index(drop=True), widths, levels, distance)
                part = part[last]
            held, size = [part], len(part)
        if held and sum(map(len, held)):
            yield _links_of_part(pd.concat(held, ignore_index=True), widths, levels, distance)

    group = ["rotation", "block", "lower", "upper"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(of, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, rid, th, fp, root, component_id)`` for every row of ``docs``; rows of one
    component share ``root``.

    The text is read once; after that only fingerprints move. Copies meet in a map-side
    aggregation, so a fingerprint that many rows share is one node. An empty table gives
    no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-first")
    parts = materialize(connected_components(near_links(firsts.select("fp"), distance)), "simhash-parts")
    tied = firsts.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp"))
    smallest = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(tied.join(smallest, "root").select("fp", "root", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "rid", "th", "fp", "root", "component_id")
