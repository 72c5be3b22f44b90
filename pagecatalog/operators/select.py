"""Selectors as expressions on parsed pages, see ``elements``: no row leaves its task.

Forms: ``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr="v"]``, ``[attr*="v"]``, any of
them run together, and descendants separated by white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from pagecatalog.functions import clean
from pagecatalog.functions.binding import bind
from pagecatalog.operators.elements import TEXT_PIECE

_PART = re.compile(
    r"""(?P<tag>[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""")


def _condition(part: re.Match) -> Callable[[Column], Column]:
    named = part.groupdict()
    if named["tag"]:
        return lambda e: e["tag"] == named["tag"].lower()
    if named["cls"]:
        return lambda e: F.array_contains(e["classes"], named["cls"])
    if named["id"]:
        return lambda e: F.coalesce(e["elem_id"] == named["id"], F.lit(False))
    value = named["value"]
    if named["op"] == "=":
        return lambda e: F.coalesce(e["attrs"][named["attr"]] == value, F.lit(False))
    if named["op"] == "*=":
        return lambda e: F.coalesce(F.contains(e["attrs"][named["attr"]], F.lit(value)), F.lit(False))
    return lambda e: e["attrs"][named["attr"]].isNotNull()


def _all_of(conditions: list[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    return lambda e: reduce(lambda test, c: test & c(e), conditions[1:], conditions[0](e))


@dataclass(frozen=True)
class _Step:
    """One link of the descendant chain: a name that its elements have, if it has one, and what else holds."""

    name: str | None
    others: list[Callable[[Column], Column]]

    def numbers(self) -> Column:
        """Numbers of the elements that this step accepts, in document order; NULL if none has the name."""
        if self.name is None:
            return F.transform(F.filter("elements", _all_of(self.others)), lambda e: e["ord"])
        named = F.get("places", F.array_position("names", self.name).cast("int") - 1)
        if not self.others:
            return named
        return F.filter(named, lambda n: _all_of(self.others)(F.get("elements", n)))


def _steps(selector: str) -> tuple[list[_Step], list[str]]:
    """The steps of a selector, and the names that all of them need."""
    steps, names = [], []
    # spaces inside an attribute value do not separate steps
    for text in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector):
        parts = list(_PART.finditer(text))
        if "".join(p.group(0) for p in parts) != text:
            raise ValueError(f"unsupported selector: {selector!r}")
        named = {p.group(0).lower() if p["tag"] else p.group(0): p for p in parts if not p["attr"]}
        # an id is rarer than a class, a class than a tag
        name = min(named, key=lambda n: (n[0] != "#", n[0] != "."), default=None)
        steps.append(_Step(name, [_condition(p) for p in parts if p is not named.get(name)]))
        names += named
    if not steps:
        raise ValueError("empty selector")
    return steps, names


def names_of(*selectors: str) -> frozenset[str] | None:
    """The names that these selectors look at, for ``elements(only=...)``; None if some step has none."""
    found = [_steps(s) for s in selectors]
    if any(step.name is None for steps, _ in found for step in steps):
        return None
    return frozenset(name for _, names in found for name in names)


def inside(e: Column, scope: Column) -> Column:
    return (e["ord"] > scope["ord"]) & (e["ord"] <= scope["last_ord"])


def _numbers_in(scope: Column) -> Column:
    return F.when(scope["last_ord"] > scope["ord"], F.sequence(scope["ord"] + 1, scope["last_ord"])) \
        .otherwise(F.array().cast("array<int>"))


_BLOCK = 256


def _outermost(scopes: Column) -> Column:
    """The ranges, as ``struct<ord, last_ord>``, of the scopes that lie in no other one.

    Scopes nest and come in document order, so one lies in another if an earlier one
    reaches as far. Blocks of scopes are walked one by one, each with the reach of those
    before it, which keeps the arrays that grow short.
    """
    def of_block(block: Column, reach: Column) -> Column:
        start = F.struct(reach.alias("reach"), F.array().cast("array<struct<ord:int,last_ord:int>>").alias("kept"))
        return F.aggregate(block, start, lambda acc, s: F.when(s["ord"] > acc["reach"], F.struct(
            s["last_ord"].alias("reach"),
            F.concat(acc["kept"], F.array(F.struct(s["ord"].alias("ord"), s["last_ord"].alias("last_ord")))).alias("kept")),
        ).otherwise(acc), lambda acc: acc["kept"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(scopes) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(scopes, b * _BLOCK + 1, F.lit(_BLOCK)))
    return bind(blocks, lambda parts: bind(
        F.transform(parts, lambda p: F.array_max(F.transform(p, lambda s: s["last_ord"]))),
        lambda ends: F.flatten(F.transform(parts, lambda p, i: of_block(
            p, F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(-1)))))))


def _below(outer: Column, step: _Step) -> Column:
    """Numbers of the elements that ``step`` accepts and that lie below one of ``outer``.

    Numbers below the outermost scopes and numbers of accepted elements are intersected,
    which is linear in the page. A single scope is the usual case, and takes no lambda: lambdas
    are interpreted, the rest is compiled.
    """
    def of_many(numbers: Column) -> Column:
        scopes = F.transform(numbers, lambda n: F.get("elements", n))
        return F.array_intersect(step.numbers(), F.flatten(F.transform(_outermost(scopes), _numbers_in)))

    single = F.array_intersect(step.numbers(), _numbers_in(element(F.get(outer, F.lit(0)))))
    return F.when(F.size(step.numbers()) > 0, F.when(F.size(outer) == 1, single).when(F.size(outer) > 1, bind(outer, of_many)))


def element(number: Column) -> Column:
    return F.get("elements", number)


def _elements(numbers: Column) -> Column:
    return F.transform(numbers, element)


def _numbers(selector: str) -> Column:
    """Numbers of the elements that ``selector`` matches; NULL or none where there are none."""
    (outermost, *inner), _ = _steps(selector)
    if not inner:
        return outermost.numbers()
    # an expression that is used several times is bound, or it would double with every step
    below = _below(outermost.numbers(), inner[0])
    return reduce(lambda outer, step: bind(outer, lambda numbers: _below(numbers, step)), inner[1:], below)


def matches(selector: str) -> Column:
    """All elements of the page that ``selector`` matches, in document order.

    NULL, without a look at the elements, where the page lacks a name the selector needs.
    """
    _, names = _steps(selector)
    found = F.coalesce(_elements(_numbers(selector)), F.slice("elements", 1, 0))
    if not names:
        return found
    possible = reduce(lambda a, b: a & b, [F.array_contains("names", n) for n in dict.fromkeys(names)])
    return F.when(possible, found)


def matches_in(scope: Column, selector: str) -> Column:
    """Matches of ``selector`` below the element ``scope``."""
    return bind(scope, lambda s: F.filter(matches(selector), lambda e: inside(e, s)))


def first(found: Column) -> Column:
    """The first of an array of elements, or NULL."""
    return F.get(found, F.lit(0))


def text_of(e: Column) -> Column:
    """Trimmed text of an element, NULL for no element."""
    first_piece = F.floor(e["text_from"] / TEXT_PIECE).cast("int")
    skipped = e["text_from"] % TEXT_PIECE
    pieces = F.ceil((skipped + e["text_len"]) / TEXT_PIECE).cast("int")
    joined = F.when(pieces > 1, F.array_join(F.slice("text_pieces", first_piece + 1, pieces), "")) \
        .otherwise(F.coalesce(F.get("text_pieces", first_piece), F.lit("")))
    return clean(F.substring(joined, skipped + 1, e["text_len"]))


def first_number(*selectors: str) -> Column:
    """Number of the first match of the first selector, in priority order, that matches anything, or NULL."""
    return F.coalesce(*[F.get(_numbers(s), F.lit(0)) for s in selectors])


def first_numbers(*selectors: str) -> Column:
    """Numbers of the matches of the first selector, in priority order, that matches anything, or NULL.

    Later selectors are not evaluated once one has matched.
    """
    return F.coalesce(*[F.when(F.size(_numbers(s)) > 0, _numbers(s)) for s in selectors])


def numbers_in(number: Column, selector: str) -> Column:
    """Numbers of the matches of ``selector`` below an element."""
    return F.array_intersect(_numbers(selector), _numbers_in(element(number)))


def first_matching(selectors: Sequence[str]) -> Column:
    """The matches of the first selector, in priority order, that matches anything, or NULL."""
    return _elements(first_numbers(*selectors))
