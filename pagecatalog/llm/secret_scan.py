"""Secrets in text: certain ones by pattern, weak ones by what stands near them.

Certain findings (the base) are assignments to a secret-like name, access ids and long runs
of hex digits. Weak candidates prove nothing alone: a long mixed token, an account or client
id, an endpoint. A token is a run of 32 letters, digits and ``+/_-`` or more, of any length, with
both cases and a digit; it may stand straight after ``=``. Candidates are parts of a credential,
and are linked by an interval join within their scope, ``REACH`` characters to both sides: a
weak candidate is reported only when the parts that complete it lie in reach:

=========  =========================================================
token      an access id or account id, or an endpoint
account    a secret: an assignment, a hex run or a token
endpoint   a secret, and an access id or account id
=========  =========================================================

DataFrame functions only. Positions come from the pieces between matches, in the row; only
the spans of rows with a weak candidate are shuffled for the join, never a text. The join
sweeps the spans of a text in order and carries the nearest part of each role from both
sides, so it is linear in the spans and never pairs them.

Cases: a null text is empty; repeated rows have equal findings; a null id is kept; an empty
table gives no rows. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagecatalog.functions.binding import bind
from pagecatalog.llm.common import keyed
from pagecatalog.session import materialize

# The patterns of the base.
ASSIGN = (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
          r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Weak candidates: kind and pattern.
WEAK = {
    # from the start of a run on, so each run is looked at once however long it is
    "token": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])"
             r"[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])",
    "account": r"(?i:account|client|user|tenant)[_-]?(?i:id)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9._@-]{4,}",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?",
}
KINDS = ("assign", "access", "hex", *WEAK)
REACH = 200
_BLOCK = 256


def _running(sizes: Column) -> Column:
    """Sums up to and with each element, block by block so that arrays stay short to append to."""
    def summed(values: Column) -> Column:
        return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums")),
                           lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + v)).alias("sums")),
                           lambda acc: acc["sums"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
                         lambda b: summed(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
    return bind(blocks, lambda inner: bind(
        summed(F.transform(inner, lambda x: F.element_at(x, -1))),
        lambda ends: F.flatten(F.transform(inner, lambda x, i: F.transform(
            x, lambda v: v + F.when(i > 0, F.get(ends, i - 1)).otherwise(0))))))


def spans(text: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """``array<struct<start, kind, end>>`` of all matches; with ``value``, of those whose
    group 1 has at least so many characters."""
    def located(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return bind(_running(sizes), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(ends, i).alias("end"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = bind(found, lambda f: F.when(F.size(f) > 0, located(f, F.split(text, pattern, -1))).otherwise(none))
    if value is None:
        return every
    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.filter(
        every, lambda s, i: F.length(F.get(v, i)) >= value))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, rid, th, base, weak)``: arrays of spans, sorted, before any linking."""
    rows = keyed(docs)
    text = F.col("text")
    rows = rows.withColumns({"_" + k: spans(text, p, k, v) for k, p, v in (
        ("assign", ASSIGN, LEAST_VALUE), ("access", ACCESS, None), ("hex", HEX, None), *((k, p, None) for k, p in WEAK.items()))})
    overlaps = lambda s: F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    return rows.select("doc_id", "rid", "th", F.col("_base").alias("base"), F.array_sort(F.concat(
        F.filter("_token", lambda s: ~overlaps(s)), F.filter("_account", lambda s: ~overlaps(s)), "_endpoint")).alias("weak"))


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``(rid, th, linked)``: per row, the weak spans that the parts in reach complete."""
    role = {"assign": "secret", "hex": "secret", "token": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
    parts = found.filter(F.size("weak") > 0).select("rid", "th", F.inline(F.array_distinct(F.concat("base", "weak")))).distinct()
    text = Window.partitionBy("rid", "th").orderBy("start", "kind", "end")
    left, right = text.rowsBetween(Window.unboundedPreceding, -1), text.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for name in ("secret", "id", "endpoint"):
        is_role = F.col("kind").isin([i for i, k in enumerate(KINDS) if role[k] == name])
        before, after = F.max(F.when(is_role, F.col("end"))).over(left), F.min(F.when(is_role, F.col("start"))).over(right)
        near["near_" + name] = F.coalesce(F.col("start") - before <= reach, F.lit(False)) | F.coalesce(
            after - F.col("end") <= reach, F.lit(False))
    kind = lambda name: F.col("kind") == KINDS.index(name)
    complete = (kind("token") & (F.col("near_id") | F.col("near_endpoint"))) | (kind("account") & F.col("near_secret")) | (
        kind("endpoint") & F.col("near_secret") & F.col("near_id"))
    return parts.withColumns(near).filter(complete).groupBy("rid", "th").agg(
        F.collect_set(F.struct("start", "kind", "end")).alias("linked"))


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``(doc_id, base, linked)`` for every row: certain spans, and weak ones that are complete.

    A span is ``struct<start, kind, end>``, ``kind`` an index of ``KINDS``.
    """
    found = materialize(scan(docs), "secrets")
    return found.join(link(found, reach), ["rid", "th"], "left").select("doc_id", "base", F.coalesce(
        F.col("linked"), F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("linked"))


def listed(spans_of: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans_of), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
