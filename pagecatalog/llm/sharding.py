"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells, or as many more as leave four for each virtual node; each shard
owns ``virtual`` of them. A finer ring keeps every place of a coarser one. A row's cell follows from
the hash of its text, and its first choice is the first owned cell from there on. A shard
holds so many rows and no more: rows of an arc beyond that go on clockwise, to the next
shard with room. Capacities add up to the number of rows and are at most one apart, so the
shards are balanced exactly (law ``rows``). Only what overflows moves on, and more shards
add cells without moving any, so few rows move when shards are added.

Equal texts have equal cells, so a group of copies lies side by side and stays together
except where a shard fills up in its midst.

How many rows go from which arc to which shard follows from the number of rows per arc
alone, ``shards * virtual + 1`` numbers that the driver reads. Rows are placed by their
position in the order of (cell, text hash, id), which is computed in range-partitioned
slices: a text that a third of the rows share is many slices, not one task.

Cases: a null text counts as empty, size 1; repeated rows get slots of their own; a null id
comes first among its equals; an empty table gives no rows; fewer rows than shards leave
shards empty.
"""

from __future__ import annotations

from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame, functions as F

from pagecatalog.functions.ordering import global_index
from pagecatalog.session import materialize

CELLS = 1 << 12
LAW = "rows"


def ring_bits(shards: int, virtual: int) -> int:
    return max(CELLS.bit_length() - 1, (4 * shards * virtual - 1).bit_length())


def owned_cells(shards: int, virtual: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` in ring order; a cell that is taken already is tried anew."""
    bits = ring_bits(shards, virtual)
    cells: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            turn = 0
            while (cell := xxhash.xxh64_intdigest(f"{shard}/{v}/{turn}", seed=7) >> (64 - bits)) in cells:
                turn += 1
            cells[cell] = shard
    return sorted(cells.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def bounded_loads(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(arc, from, to, shard, slot)``: the rows of an arc with these ranks go to the
    shard, in slots from ``slot`` on.

    Every arc is first served by its own shard, in ring order, as far as that has room; what
    is left then goes, round by round, to the next other shard clockwise.
    """
    room = capacities(sum(counts), shards)
    left, used = list(counts), [0] * shards
    ahead, seen = list(range(len(counts))), [set() for _ in counts]
    pieces = []
    while any(left):
        for arc in range(len(counts)):
            if not left[arc]:
                continue
            while owners[ahead[arc] % len(owners)] in seen[arc]:
                ahead[arc] += 1
            shard = owners[ahead[arc] % len(owners)]
            seen[arc].add(shard)
            taken = min(left[arc], room[shard] - used[shard])
            if taken:
                start = counts[arc] - left[arc]
                pieces.append((arc, start, start + taken, shard, used[shard]))
                used[shard] += taken
                left[arc] -= taken
    return pieces


def assign(docs: DataFrame, shards: int = 8, virtual: int = 64) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    spark = docs.sparkSession
    owned, bits = owned_cells(shards, virtual), ring_bits(shards, virtual)
    owners = [s for _, s in owned] + [owned[0][1]]  # past the last owned cell, the first one's
    arc_of, arc = [], 0
    for cell in range(1 << bits):
        while arc < len(owned) and owned[arc][0] < cell:
            arc += 1
        arc_of.append(arc)
    text = F.coalesce(F.col("text"), F.lit(""))
    arcs = F.split(F.lit(",".join(map(str, arc_of))), ",")
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text, F.lit("ring")), 64 - bits).cast("int").alias("cell"),
        F.xxhash64(text, F.lit("order")).alias("_text"))
    rows = materialize(rows, "ring")
    placed = global_index(rows, ["cell", "_text", "size", "doc_id"], "_at").withColumn(
        "arc", F.element_at(arcs, F.col("cell") + 1).cast("int"))
    found = {r["arc"]: r["n"] for r in rows.groupBy(F.element_at(arcs, F.col("cell") + 1).cast("int").alias("arc"))
             .agg(F.count("*").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(owners))]
    starts = [0, *accumulate(counts)]
    pieces = spark.createDataFrame(
        [(a, starts[a] + f, starts[a] + t, s, slot - starts[a] - f) for a, f, t, s, slot in bounded_loads(counts, owners, shards)],
        "arc int, _from bigint, _to bigint, shard int, _shift bigint")  # at most shards for each arc
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    joined = placed.join(F.broadcast(pieces.withColumnRenamed("arc", "_arc")), (F.col("arc") == F.col("_arc")) & inside)
    return joined.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                         (F.col("_at") + F.col("_shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
