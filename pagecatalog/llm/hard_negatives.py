"""Hard negatives by a multiway hyperplane tree over all vectors.

A node of the tree has split points; a vector belongs to the subtree of the nearest one, the
first of equals. For every split point and every sibling subtree the node stores the least
and largest distance between the point and the subtree's vectors. A search knows the *window*
of scores that matter. As a score is an inner product, ``|q - x|^2 = |q|^2 + |x|^2 - 2 score``
turns a window into an annulus around the query, given the norms in a subtree; a subtree is
eliminated as soon as the ranges to any split point show that it cannot meet the annulus.
Leaves that remain are scored in full, so results are exact.

The split points come from a bounded sample (``SAMPLE`` vectors) on the driver; all vectors
are dealt to leaves, and all distance ranges measured, in tasks. Neighbouring leaves form
groups of about ``GROUP`` vectors, and a leaf that holds more (a vector that a third of the
rows repeat) is cut into slices by row number, a group each. Three searches follow:

1. Inside each group, its own anchors meet its own vectors. The last of the positives found
   there is a lower bound for the whole search.
2. Anchors go to all other groups with a leaf that can hold a better positive.
3. With the positives known, anchors go to all groups with a leaf in the annulus of one of
   their windows ``[80 %, 100 %]`` of a positive's score, and the first negatives are taken.

Anchors are a part of the table that grows with it, so they travel in blocks of ``BLOCK``,
each with a copy of the groups it meets. Per group, an anchor hands on at most as many rows
as it can keep; the shuffle after that limits before it sends.

Scores are exact: components are whole numbers, multiplied as doubles while every sum stays
below 2**53, and as Python integers beyond; a score outside 64 bits counts as the nearest
that fits. Ranges are widened by ``SLACK`` for the rounding of distances.

Cases: rows with a null label or vector, or with a component that is null or not finite, take
no part; vectors of unequal length are as if padded with zeros; a null id is no anchor and
comes after all others; rows that repeat an id are rows of their own, so a copy of an anchor
can be its positive and each copy gets the same answers; ties go to the smaller id; a score
of zero or less has a window of that score alone or an empty one; an empty table, or one
without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagecatalog.session import materialize

POSITIVES = 5
NEGATIVES = 5
LEAST, MOST = 80, 100  # per cent of the positive's score
FANOUT = 16
LEAF = 1024
GROUP = 8192
BLOCK = 16_384
SAMPLE = 8192
SLACK = 1e-6
_EXACT = 2.0 ** 53
_LONG = 2 ** 63 - 1
_NO_ID = _LONG  # stands for a null id

_VECTOR = "uid bigint, vec_id bigint, label int, wide boolean, q binary"
_NAMES = ["uid", "vec_id", "label", "wide", "q"]


def vectors(table: DataFrame, label: Column) -> DataFrame:
    """``(uid, vec_id, label, wide, q)``: components times 256, rounded down, four bytes each or,
    where these lose something, eight (``wide``)."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wide, packed = [], []
            for v in batch["embedding"]:
                q = np.floor(np.asarray(v, np.float64) * 256)
                with np.errstate(over="ignore"):
                    short = q.astype("<f4")
                wide.append(not np.array_equal(short, q))
                packed.append((q.astype("<f8") if wide[-1] else short).tobytes())
            yield batch[["uid", "vec_id", "label"]].assign(wide=wide, q=packed)

    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0 ** 1015)))
    rows = table.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(_NO_ID)).alias("vec_id"), label.cast("int").alias("label"), x.alias("embedding"))
    return (rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "label", "embedding").mapInPandas(of, _VECTOR))


def matrix(wide, packed, width: int) -> np.ndarray:
    """Rows of packed components, padded with zeros to ``width``."""
    out = np.zeros((len(packed), width))
    for i, (w, b) in enumerate(zip(wide, packed)):
        row = np.frombuffer(b, "<f8" if w else "<f4")
        out[i, :len(row)] = row
    return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(np.nan_to_num(squares, nan=np.inf), 0))


@dataclass
class Node:
    points: np.ndarray  # split points, one a row
    children: list[int]  # a node's number, or -1 - number of a leaf
    low: np.ndarray  # split point x subtree: least distance
    high: np.ndarray  # and largest; none below least for an empty subtree
    shortest: np.ndarray  # norms in each subtree
    longest: np.ndarray


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    width: int

    def descend(self, x: np.ndarray):
        """``(node, rows, nearest, distances)`` for every node that rows of ``x`` pass."""
        ahead = [(0, np.arange(len(x)))] if self.nodes else []
        while ahead:
            n, rows = ahead.pop()
            d = distances(x[rows], self.nodes[n].points)
            nearest = d.argmin(axis=1)
            yield n, rows, nearest, d
            for j, child in enumerate(self.nodes[n].children):
                if child >= 0 and (at := rows[nearest == j]).size:
                    ahead.append((child, at))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int64)
        for n, rows, nearest, _ in self.descend(x):
            child = np.array(self.nodes[n].children)[nearest]
            leaf[rows[child < 0]] = -1 - child[child < 0]
        return leaf

    def met(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries x leaves: which leaves can hold a score in one of a query's windows
        (``low``, ``high``: queries x windows; a window with ``low > high`` is empty)."""
        out = np.zeros((len(q), self.leaves), bool)
        if not self.nodes:
            out[:] = (low <= high).any(axis=1)[:, None]
            return out
        own = (q * q).sum(axis=1)
        ahead = [(0, np.arange(len(q)))]
        while ahead:
            n, rows = ahead.pop()
            node = self.nodes[n]
            d = distances(q[rows], node.points)
            nearest = np.maximum(d[:, :, None] - node.high, node.low - d[:, :, None]).max(axis=1)
            farthest = (d[:, :, None] + node.high).min(axis=1)
            spare = SLACK * (np.sqrt(own[rows])[:, None] + node.longest)
            keep = np.zeros(nearest.shape, bool)
            for w in range(low.shape[1]):
                a, b = low[rows, w][:, None], high[rows, w][:, None]
                outer = np.sqrt(np.maximum(own[rows][:, None] + node.longest ** 2 - 2 * a, 0))
                inner = np.sqrt(np.maximum(own[rows][:, None] + node.shortest ** 2 - 2 * b, 0))
                keep |= (a <= b) & ~(nearest > outer + spare) & ~(farthest < inner - spare)
            keep &= node.longest >= node.shortest  # not an empty subtree
            for j, child in enumerate(node.children):
                at = rows[keep[:, j]]
                if child < 0:
                    out[at, -1 - child] = True
                elif at.size:
                    ahead.append((child, at))
        return out


def split_points(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers of rows far from each other, chosen greedily among three times as many; fewer
    than two if the rows are alike."""
    among = np.linspace(0, len(x) - 1, min(len(x), 3 * n)).astype(int)
    chosen, away = [0], distances(x[among], x[among[:1]])[:, 0]
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(x[among], x[among[chosen[-1:]]])[:, 0])
    return among[chosen]


def grown(sample: np.ndarray, rows: int, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
    """A tree for ``rows`` vectors of which ``sample`` is a part; its ranges are still to be measured."""
    nodes: list[Node] = []
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        expected = rows * len(x) / max(1, len(sample))
        points = split_points(x, min(fanout, max(2, int(np.ceil(expected / leaf))))) if expected > leaf and len(x) > 1 else []
        if len(points) < 2:
            leaves += 1
            return -leaves
        m = len(points)
        node = Node(x[points], [], np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf))
        number = len(nodes)
        nodes.append(node)
        nearest = distances(x, node.points).argmin(axis=1)
        for j in range(m):
            node.children.append(grow(x[nearest == j]))
        return number

    grow(sample)
    return Tree(nodes, leaves, sample.shape[1])


def _dealt(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with the leaf each belongs to."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.leaf_of(matrix(batch["wide"], batch["q"], tree.width)))

    return rows.mapInPandas(of, _VECTOR + ", leaf bigint")


def _measured(dealt: DataFrame, tree: Tree) -> Tree:
    """The tree with its ranges: per node, split point and subtree one row reaches the driver."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["wide"], batch["q"], tree.width)
            norms = np.sqrt((x * x).sum(axis=1))
            out = []
            for n, rows, nearest, d in tree.descend(x):
                for j in np.unique(nearest):
                    at = nearest == j
                    out += [(n, i, int(j), a, b) for i, (a, b) in enumerate(zip(d[at].min(axis=0), d[at].max(axis=0)))]
                    out.append((n, -1, int(j), norms[rows[at]].min(), norms[rows[at]].max()))
            yield pd.DataFrame(out, columns=["node", "point", "subtree", "low", "high"])

    ranges = dealt.select("wide", "q").mapInPandas(of, "node int, point int, subtree int, low double, high double")
    for r in ranges.groupBy("node", "point", "subtree").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        node = tree.nodes[r["node"]]
        if r["point"] < 0:
            node.shortest[r["subtree"]], node.longest[r["subtree"]] = r["low"], r["high"]
        else:
            node.low[r["point"], r["subtree"]], node.high[r["point"], r["subtree"]] = r["low"], r["high"]
    return tree


def grouped(counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf, its first group and the number of groups it is cut into."""
    first, slices, group, filled = [], [], 0, 0
    for n in counts:
        if filled and filled + n > size:
            group, filled = group + 1, 0
        first.append(group)
        slices.append(max(1, -(-n // size)))
        if slices[-1] > 1:
            group, filled = group + slices[-1], 0
        else:
            filled += n
    return np.array(first, np.int64), np.array(slices, np.int64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as doubles or, beyond these, as Python integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < _EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    found = whole(q) @ whole(x).T
    return np.clip(found, -_LONG, _LONG) if found.size else found


def in_order(score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Order by falling score, then id, then row."""
    falling = np.unique(-score, return_inverse=True)[1] if score.dtype == object else -score
    return np.lexsort((uids, ids, falling))


def _positives_in(asked: pd.DataFrame, held: pd.DataFrame, width: int, n: int) -> list[tuple]:
    """``(uid, found_uid, found_id, score)``: the first ``n`` rows of an anchor's label, itself left out."""
    ids, uids, labels = (held[c].to_numpy() for c in ("vec_id", "uid", "label"))
    x, q = matrix(held["wide"], held["q"], width), matrix(asked["wide"], asked["q"], width)
    out = []
    for label, rows in asked.groupby("label").indices.items():
        like = np.flatnonzero(labels == label)
        for row, s in zip(rows, scores(q[rows], x[like])):
            uid = int(asked["uid"].iloc[row])
            if len(s) > n + 1:  # all that are not below the last that can count
                kept = np.flatnonzero(s >= np.partition(s, -(n + 1))[-(n + 1)])
            else:
                kept = np.arange(len(s))
            kept = kept[uids[like[kept]] != uid]
            best = kept[in_order(s[kept], ids[like[kept]], uids[like[kept]])][:n]
            out += [(uid, int(uids[like[k]]), int(ids[like[k]]), int(s[k])) for k in best]
    return out


def windows(positive: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of scores ``s`` with ``least * p <= 100 * s <= most * p``, as doubles a little too wide."""
    p = positive.astype(np.float64)
    spare = np.abs(p) * 1e-9
    return least * p / 100 - spare, most * p / 100 + spare


def _negatives_in(asked: pd.DataFrame, held: pd.DataFrame, width: int, n: int, least: int, most: int) -> list[tuple]:
    """``(uid, positive_uid, found_uid, found_id, score)``: the first ``n`` in each positive's window."""
    ids, uids, labels = (held[c].to_numpy() for c in ("vec_id", "uid", "label"))
    x, q = matrix(held["wide"], held["q"], width), matrix(asked["wide"], asked["q"], width)
    out = []
    for at in range(0, len(asked), 256):
        part = asked.iloc[at:at + 256]
        for uid, label, p_uids, p_scores, s in zip(*(part[c] for c in ("uid", "label", "p_uids", "p_scores")), scores(q[at:at + 256], x)):
            found = list(zip(map(int, p_uids), map(int, p_scores)))
            low, high = windows(np.array([p for _, p in found], dtype=object), least, most)
            some = np.flatnonzero((s >= low.min()) & (s <= high.max()) & (labels != label))
            some = some[in_order(s[some], ids[some], uids[some])]
            whole = [int(v) for v in s[some]]
            for p_uid, p in found:
                out += [(int(uid), p_uid, int(uids[some[k]]), int(ids[some[k]]), whole[k]) for k in _first_inside(whole, p, n, least, most)]
    return out


def _first_inside(falling: list[int], p: int, n: int, least: int, most: int) -> list[int]:
    """Places of the first ``n`` scores of a window in a falling list, by bisection."""
    a, b = 0, len(falling)
    while a < b:
        mid = (a + b) // 2
        a, b = (mid + 1, b) if 100 * falling[mid] > most * p else (a, mid)
    return [k for k in range(a, min(a + n, len(falling))) if 100 * falling[k] >= least * p]


def _answers(asked: DataFrame, held: DataFrame, solve, schema: str, names: list[str]) -> DataFrame:
    """``solve`` on each group's vectors with each block of the anchors sent there."""
    def of(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(solve(one, other) if len(one) and len(other) else [], columns=names)

    return asked.groupBy("group", "block").cogroup(held.groupBy("group", "block")).applyInPandas(of, schema)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id", "found_uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(table: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST, label: Column | None = None, leaf: int = LEAF,
                   group: int = GROUP, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows of
    ``table (vec_id, embedding, label)`` whose id is divisible by ``every``."""
    rows = materialize(vectors(table, F.col("label") if label is None else label), "vectors")
    is_anchor = (F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID)
    size = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("q") / F.when(F.col("wide"), 8).otherwise(4)).alias("width"),
                    F.count_if(is_anchor).alias("anchors")).first()
    width = int(size["width"] or 0)
    some = rows.orderBy(F.xxhash64("uid", F.lit("tree")), "uid").limit(sample).select("wide", "q").collect()
    tree = grown(matrix([r["wide"] for r in some], [r["q"] for r in some], width), size["n"], leaf)
    dealt = materialize(_dealt(rows, tree), "dealt-vectors")
    if tree.nodes:
        tree = _measured(dealt, tree)
    counts = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    first, slices = grouped([counts.get(i, 0) for i in range(tree.leaves)], group)
    blocks = max(1, -(-size["anchors"] // block))

    listed = lambda numbers: F.element_at(F.split(F.lit(",".join(map(str, numbers))), ","), (F.col("leaf") + 1).cast("int")).cast("bigint")
    held = dealt.withColumn("group", listed(first) + F.pmod(F.xxhash64("uid"), listed(slices))).drop("leaf")
    anchors = held.filter(is_anchor)
    copied = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["uid", "found_uid", "found_id", "score"]
    schema = "uid bigint, found_uid bigint, found_id bigint, score bigint"

    def at_home(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        asked = part[(part["vec_id"] % every == 0) & (part["vec_id"] != _NO_ID)].reset_index(drop=True)
        return pd.DataFrame(_positives_in(asked, part, width, positives) if len(asked) else [], columns=names)

    home = materialize(held.groupBy("group").applyInPandas(at_home, schema), "positives-near")
    bound = home.groupBy("uid").agg(F.when(F.count("*") >= positives, F.min("score")).alias("bound"))

    def routed(batches: Iterator[pd.DataFrame], search_all: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512].reset_index(drop=True)
                if search_all:
                    lists = [[*p, *[p[-1]] * (positives - len(p))] for p in part["p_scores"]]
                    low, high = windows(np.array(lists, np.float64).reshape(len(part), positives), least, most)
                else:
                    low = part["bound"].astype("float64").fillna(-np.inf).to_numpy()[:, None]
                    low, high = low - np.abs(np.nan_to_num(low, neginf=0)) * 1e-9, np.full(low.shape, np.inf)
                met = tree.met(matrix(part["wide"], part["q"], width), low, high)
                took, leaves = np.nonzero(met)
                pairs = np.unique(np.stack([np.repeat(took, slices[leaves]), np.concatenate(
                    [np.arange(first[x], first[x] + slices[x]) for x in leaves] or [np.zeros(0, np.int64)])], axis=1), axis=0)
                if not search_all:
                    pairs = pairs[part["group"].to_numpy()[pairs[:, 0]] != pairs[:, 1]]
                yield part.iloc[pairs[:, 0]].assign(group=pairs[:, 1])

    place = F.pmod(F.xxhash64("uid", F.lit("block")), F.lit(blocks)).cast("int").alias("block")
    asked = anchors.join(bound, "uid", "left").select("group", place, *_NAMES, "bound").mapInPandas(
        lambda batches: routed(batches, False), f"group bigint, block int, {_VECTOR}, bound bigint")
    far = _answers(asked, copied, lambda one, other: _positives_in(one, other, width, positives), schema, names)
    best = materialize(_first(home.union(far), ["uid"], positives), "positives")

    chosen = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "found_uid", "score"))).alias("p"))
    chosen = chosen.select("uid", F.col("p.found_uid").alias("p_uids"), F.col("p.score").alias("p_scores"))  # at most ``positives``
    asked = anchors.join(chosen, "uid").select("group", place, *_NAMES, "p_uids", "p_scores").mapInPandas(
        lambda batches: routed(batches, True), f"group bigint, block int, {_VECTOR}, p_uids array<bigint>, p_scores array<bigint>")
    found = _answers(asked, copied, lambda one, other: _negatives_in(one, other, width, negatives, least, most),
                     "uid bigint, positive_uid bigint, found_uid bigint, found_id bigint, score bigint",
                     ["uid", "positive_uid", "found_uid", "found_id", "score"])
    of_pair = best.select("uid", F.col("found_uid").alias("positive_uid"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = _first(found, ["uid", "positive_uid"], negatives).join(of_pair, ["uid", "positive_uid"]).join(
        anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return named.withColumnRenamed("found_id", "negative_id").select(
        "anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", F.col("score").alias("negative_score"))
