"""Document fingerprints from closed syncmers, matched by position.

A text is read as *letters* whose borders follow from its content alone: a run of ASCII characters
up to and with the next a, e or digit, and every character beyond ASCII by itself, so scripts
without blanks are read character by character. White space and control characters
divide letters and are no part of them. Of the k-mers of letters, a closed syncmer is one whose
least s-mer (by hash) is its first or its last. Whether a k-mer is chosen depends on nothing but
itself, so two texts that share a passage choose the same anchors in it, wherever it stands:
about ``2 / (k - s + 1)`` of its k-mers.

A fingerprint holds the hashes of all distinct anchors, each with the place of its first
occurrence, so likeness counts whole texts. Anchors in common *match by position* if the common anchor before or after them,
in the order of the text, lies at the same offset between the texts; the likeness is the
share of anchors that do (Dice). A single anchor in common counts.

DataFrame functions only. Cases: a null text is empty; an empty or blank text has the empty
fingerprint, alike only to another empty one (1, else 0); a text with fewer letters than k has
one anchor, the whole of it; ties between s-mers choose the k-mer; equal texts have equal
fingerprints and likeness 1; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagecatalog.functions.binding import bind

#: What can stand in a letter before its last character, and what ends one.
_WITHIN = r"[!-/:-@B-DF-`b-df-~]"
_END = r"(?:[0-9AEae]|[^\x00-\x7F])"
LETTER = f"{_WITHIN}*+{_END}|{_WITHIN}++"
K = 8
S = 3
#: Nothing is sampled: of the distinct anchors one in ``SHARE`` counts, ``LEAST`` at least, which no array exceeds.
SHARE = 1
LEAST = (1 << 31) - 1
SLICE_BYTES = 32 << 20
_HASH_BITS, _PLACE_BITS = 30, 32  # of an anchor in one number: hash, a bit to spare, place
_HEX = 8


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTER), F.lit(0))


def _chosen(smers: Column, at: Column) -> Column:
    """Whether the k-mer at a position has its least s-mer at an edge."""
    inner = [F.get(smers, at + i) for i in range(1, K - S)]
    return F.least(F.get(smers, at), F.get(smers, at + (K - S))) <= F.least(*inner)


def _anchor(hashed: Column, place: Column) -> Column:
    """Hash and place in one number, in the order of hashes."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - _HASH_BITS), _PLACE_BITS + 1) + place


def anchors(text: Column) -> Column:
    """``array<bigint>``: the chosen k-mers, each with the letter it starts at; see ``hash_of``, ``place_of``."""
    def long_enough(h: Column) -> Column:
        smers = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))
        return bind(smers, lambda m: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: _chosen(m, i)),
            lambda i: _anchor(F.xxhash64(F.get(m, i), F.get(m, i + S), F.get(m, i + (K - S))), i)))

    hashes = F.transform(letters(text), lambda p: F.xxhash64(p))
    return bind(hashes, lambda h: F.when(F.size(h) >= K, long_enough(h)).when(
        F.size(h) > 0, F.array(_anchor(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>")))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, _PLACE_BITS + 1)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def sketch(text: Column) -> Column:
    """The distinct anchors in order, each at its first place."""
    return bind(F.sort_array(anchors(text)), lambda a: F.filter(
        a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1)))))


def as_text(anchor_list: Column) -> Column:
    return F.array_join(F.transform(anchor_list, lambda x: F.lower(F.lpad(F.hex(hash_of(x)), _HEX, "0"))), "")


def _matches(a: Column, b: Column) -> Column:
    """Places of the anchors in common, ``(place in a) * 2**32 + (place in b)``, in the order of a."""
    mark = 1 << _PLACE_BITS  # after an anchor of a comes the same one of b
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x + mark)))
    met = bind(both, lambda u: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(u) - 2), lambda i: hash_of(F.get(u, i)) == hash_of(F.get(u, i + 1))),
        lambda i: F.shiftleft(place_of(F.get(u, i)), _PLACE_BITS) + place_of(F.get(u, i + 1))))
    return F.when(F.size(a) + F.size(b) > 1, F.sort_array(met)).otherwise(F.array().cast("array<bigint>"))


def _aligned(met: Column) -> Column:
    """How many matches lie at the offset of a neighbour."""
    def offset(x: Column) -> Column:
        return F.shiftright(x, _PLACE_BITS) - place_of(x)

    return bind(F.transform(met, offset), lambda o: F.when(F.size(o) == 1, 1).otherwise(F.size(F.filter(
        o, lambda x, i: F.coalesce(x == F.get(o, i - 1), F.lit(False)) | F.coalesce(x == F.get(o, i + 1), F.lit(False))))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of both texts that match by position."""
    number = F.size(a) + F.size(b)
    return F.when(number == 0, 1.0).otherwise(2.0 * _aligned(_matches(a, b)) / number)


_KEY = ("doc_id", "_said")


def next_documents(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows ``(doc_id, text, sketch, next_text, next_sketch)``: the next by descending id, the first
    after the last; of rows that repeat an id, by the hash of their text.

    Ids are cut into ranges of about ``SLICE_BYTES``, and a null id or one that many rows repeat
    into ranges of hashes; in each, a window hands texts on. Only the first row of each range (and
    rows that repeat it as a whole) is sent a second time, to the range before it.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_said", F.shiftrightunsigned(F.xxhash64("text"), 1))
    if slices is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("size")).first()["size"] or 0
        slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES))
    quantiles = ",".join(str(i / slices) for i in range(1, slices))
    found = rows.agg(F.count("*").alias("n"), F.expr(
        f"percentile_approx(doc_id, array({quantiles}), 10000)" if slices > 1 else "cast(null as array<bigint>)").alias("cuts")).first()
    # ids with more rows than a range: at most as many as there are ranges
    many = {r["doc_id"]: -(-r["count"] * slices // found["n"]) for r in rows.groupBy("doc_id").count().filter(
        F.col("count") * slices > 2 * found["n"]).collect()}
    bounds = sorted({*(found["cuts"] or []), *(i for i in many if i is not None), *(i - 1 for i in many if i is not None and i > -(1 << 63))}, reverse=True)
    # range p holds ids from bounds[p] + 1 to bounds[p - 1], the last one null ids
    parts = [many.get(top, 1) for top in [None, *bounds]] + [many.get(None, 1)]
    parts[0] = 1
    before = [0, *accumulate(parts)]
    place = F.lit(len(bounds) + 1)
    if bounds:
        place = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(
            F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("doc_id"))))
    else:
        place = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    listed = lambda numbers: F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("_range") + 1)
    inside = F.floor(F.col("_said").cast("double") / 2.0 ** 63 * listed(parts)).cast("int")
    placed = rows.withColumn("_range", place).withColumn("_place", (listed(before) + F.least(inside, listed(parts) - 1)).cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), "_said", "text"]
    firsts = {r["_place"]: (r["first"]["doc_id"], r["first"]["_said"]) for r in placed.groupBy("_place").agg(
        F.max_by(F.struct(*_KEY), F.struct(F.coalesce("doc_id", F.lit(0)), -F.col("_said"))).alias("first")).collect()}
    if not firsts:
        return spark.createDataFrame([], "doc_id bigint, text string, sketch array<bigint>, next_text string, next_sketch array<bigint>")
    used = sorted(firsts)
    heads = spark.createDataFrame([(p, *firsts[p], q) for p, q in zip(used, [used[-1]] + used[:-1])],
                                  "_first bigint, _id bigint, _hash bigint, _to int")  # one row per range
    is_head = (F.col("_place") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_said") == F.col("_hash"))
    sent = placed.join(F.broadcast(heads), is_head).select("doc_id", "text", "_said", F.col("_to").alias("_place"), F.lit(True).alias("_sent"))
    both = placed.select("doc_id", "text", "_said", "_place", F.lit(False).alias("_sent")).unionByName(sent)
    # texts alone are shuffled: a sketch is as large as its text, and is made where the text arrives
    both = both.repartition(slices, "_place").withColumn("sketch", sketch(F.col("text")))
    window = Window.partitionBy("_place").orderBy("_sent", *order)
    led = both.withColumns({"next_text": F.lead("text").over(window), "next_sketch": F.lead("sketch").over(window)})
    return led.filter("not _sent").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def compare(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """``(doc_id, text, edited, sketch, edited_sketch, next_sketch)`` for every row: the edited
    text has its last half replaced by the start of the next document."""
    rows = next_documents(docs, slices)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return rows.withColumn("edited", edited).select(
        "doc_id", "text", "edited", "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
