"""Stored HTML -> one row per page that carries the page's elements as an array.

This is the only step that leaves the JVM. The tree is kept flat: an element holds the
range of element numbers below it and its place in the page's text, so a page's text
crosses the Arrow boundary once, whatever the nesting, and everything after (selection,
priority, order, joins) is an expression on the array, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ELEMENT = T.StructType([
    T.StructField("ord", T.IntegerType(), False),       # document order
    T.StructField("last_ord", T.IntegerType(), False),  # last element inside this one
    T.StructField("tag", T.StringType(), False),
    T.StructField("elem_id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text_from", T.IntegerType(), False),
    T.StructField("text_len", T.IntegerType(), False),
])

# Fixed values of the HTML standard: elements without content, elements whose text is
# not page text, elements whose text holds no tags, and which open elements a start tag
# closes (up to a containing one).
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NO_TEXT = frozenset(("script", "style", "template"))
_RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
_BLOCKS = frozenset((
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul").split())
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    **{tag: (("p",), ("table", "td", "th", "button", "caption")) for tag in _BLOCKS},
}

#: Page text is handed over in pieces of this many characters, so that the text of one
#: element is cut from the pieces it lies in and not from the start of the page.
TEXT_PIECE = 1024

# One match per piece of markup, with the text before it; an element of raw text is one with its
# content, an element that holds text alone one with its end tag, and markup that never ends takes what is left. Quantifiers are possessive, so a page is
# scanned in time linear in its length whatever it holds.
_ATTRIBUTE = r"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+"""
_IN_TAG = r"((?:[\s/]++|" + _ATTRIBUTE.replace("([^", "(?:[^").replace("(=[^", "(?:=[^") + r")*+)>"
_MARKUP = re.compile(
    r"([^<]*+(?:<(?![A-Za-z/!?])[^<]*+)*+)(?:"
    r"</([A-Za-z][^\s/>]*+)[^>]*+>"
    rf"|<(?ai:({'|'.join(sorted(_RAW))}))(?=[\s/>]){_IN_TAG}([^<]*+(?:<(?!(?ai:/\3)[\s/>])[^<]*+)*+)"
    rf"|<([A-Za-z][^\s/>]*+){_IN_TAG}(?:([^<]*+</)\6(?=[\s/>])[^>]*+>)?+"
    r"|<!--.*?-->"
    r"|<(?=!--).*+"
    r"|<[!?/][^>]*+>"
    r"|<.*+"
    r"|\Z)", re.S)
_ATTRIBUTES = re.compile(_ATTRIBUTE)


def _implied_end(depths: dict[str, list[int]], closes: tuple[str, ...], within: tuple[str, ...]) -> int:
    """Where the outermost element that a start tag closes stands, 0 if it closes none."""
    for tag in closes:
        if depths.get(tag):
            break
    else:
        return 0
    floor = max((depths[n][-1] for n in within if depths.get(n)), default=-1)
    above = [d[at] for n in closes if (d := depths.get(n)) and (at := bisect_right(d, floor)) < len(d)]
    return min(above, default=0)


class _Pages:
    """Element columns of many pages, filled page by page; with ``only``, of the elements that have one
    of these names, numbered among themselves, and of the text inside them."""

    def __init__(self, only: frozenset[str] | None = None):
        self.only = only
        self.texts: list[list[str]] = []
        self.names: list[str] = []  # tags, .classes and #ids of a page
        self.name_ends = [0]
        self.places: list[int] = []  # of each name, the elements that have it
        self.place_ends = [0]
        self.page_ends = [0]
        self.ord: list[int] = []
        self.last_ord: list[int] = []
        self.tag: list[str] = []
        self.elem_id: list[str | None] = []
        self.classes: list[str] = []
        self.class_ends = [0]
        self.attr_names: list[str] = []
        self.attr_values: list[str] = []
        self.attr_ends = [0]
        self.text_from: list[int] = []
        self.text_len: list[int] = []

    def add(self, html: str) -> None:
        """Flatten one page: elements in document order, each closed where the standard
        implies it or at the nearest end tag of its name."""
        only = self.only
        tags, last_ord, text_from, text_len = self.tag, self.last_ord, self.text_from, self.text_len
        attr_names, attr_values, attributes_of = self.attr_names, self.attr_values, _ATTRIBUTES.findall
        base = row = len(tags)
        named: dict[str, list[int]] = {}
        text: list[str] = []
        length = 0
        hidden = 0
        reading = only is None  # or how many of the open elements are kept
        opened: list[tuple[str, int]] = [("", -1)]  # tags and row numbers of the open elements, -1 if not kept
        depths: dict[str, list[int]] = {}  # where in ``opened`` each tag stands

        for data, end, raw_tag, raw_attributes, raw_data, tag, attributes, leaf in _MARKUP.findall(html):
            if data and reading and not hidden:
                data = unescape(data) if "&" in data else data
                text.append(data)
                length += len(data)
            if end:
                if opened[-1][0] != end:
                    end = end.lower()
                    if not depths.get(end):
                        continue
                stay = depths[end][-1]
            elif tag or raw_tag:
                if raw_tag:
                    tag, attributes = raw_tag, raw_attributes
                tag = tag.lower()
                stay = _implied_end(depths, *_CLOSES[tag]) if tag in _CLOSES else 0
            else:
                continue
            if stay:
                while len(opened) > stay:
                    closed, kept = opened.pop()
                    depths[closed].pop()
                    if kept >= 0:
                        last_ord[kept] = row - base - 1
                        text_len[kept] = length - text_from[kept]
                        if only is not None:
                            reading -= 1
                    if hidden and closed in _NO_TEXT:
                        hidden -= 1
            if end:
                continue
            names = [tag] if only is None or tag in only else []
            found = attributes_of(attributes) if attributes else ()
            elem_id = None
            classes: list[str] = []
            if found:
                seen: list[str] = []
                values: list[str] = []
                for name, double, single, bare in found:
                    name = name.lower()
                    if name in seen:  # the first of repeated attributes counts
                        continue
                    value = double or single or bare
                    if "&" in value:
                        value = unescape(value)
                    seen.append(name)
                    values.append(value)
                    if name == "class":
                        classes = value.split()
                        for one in classes if len(classes) == 1 else dict.fromkeys(classes):
                            name = "." + one
                            if only is None or name in only:
                                names.append(name)
                    elif name == "id":
                        elem_id = value
                        name = "#" + value
                        if only is None or name in only:
                            names.append(name)
            kept = -1
            if names:
                kept = row
                number = row - base
                row += 1
                for name in names:
                    if name in named:
                        named[name].append(number)
                    else:
                        named[name] = [number]
                if found:
                    attr_names += seen
                    attr_values += values
                    if classes:
                        self.classes += classes
                tags.append(tag)
                last_ord.append(number)
                text_from.append(length)
                text_len.append(0)  # until it is closed
                self.elem_id.append(elem_id)
                self.class_ends.append(len(self.classes))
                self.attr_ends.append(len(attr_names))
            if leaf:
                data = leaf[:-2]
                if data and not hidden and tag not in _NO_TEXT and (reading or names):
                    data = unescape(data) if "&" in data else data
                    text.append(data)
                    length += len(data)
                    if names and tag not in _VOID:
                        text_len[kept] = len(data)
            elif tag not in _VOID:
                if tag in depths:
                    depths[tag].append(len(opened))
                else:
                    depths[tag] = [len(opened)]
                opened.append((tag, kept))
                if names and only is not None:
                    reading += 1
                if tag in _NO_TEXT:
                    hidden += 1
            if raw_data and reading and not hidden:
                raw_data = unescape(raw_data) if "&" in raw_data else raw_data
                text.append(raw_data)
                length += len(raw_data)
        for _, kept in opened:
            if kept >= 0:
                last_ord[kept] = row - base - 1
                text_len[kept] = length - text_from[kept]
        whole = "".join(text)
        self.texts.append([whole[i:i + TEXT_PIECE] for i in range(0, length, TEXT_PIECE)])
        self.ord += range(len(tags) - base)
        self.page_ends.append(len(tags))
        self.names += named
        for numbers in named.values():
            self.places += numbers
            self.place_ends.append(len(self.places))
        self.name_ends.append(len(self.names))

    def arrow(self) -> tuple[pa.Array, ...]:
        def ints(values: list[int]) -> pa.Array:
            return pa.array(values, pa.int32())

        def strings(values: list) -> pa.Array:
            return pa.array(values, pa.string())

        columns = {
            "ord": ints(self.ord), "last_ord": ints(self.last_ord), "tag": strings(self.tag),
            "elem_id": strings(self.elem_id),
            "classes": pa.ListArray.from_arrays(ints(self.class_ends), strings(self.classes)),
            "attrs": pa.MapArray.from_arrays(
                ints(self.attr_ends), strings(self.attr_names), strings(self.attr_values)),
            "text_from": ints(self.text_from), "text_len": ints(self.text_len),
        }
        rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        places = pa.ListArray.from_arrays(ints(self.place_ends), ints(self.places))
        return (pa.array(self.texts, pa.list_(pa.string())), pa.ListArray.from_arrays(ints(self.name_ends), strings(self.names)),
                pa.ListArray.from_arrays(ints(self.name_ends), places), pa.ListArray.from_arrays(ints(self.page_ends), rows))


_PAGES_PER_OUTPUT = 200


def elements(captures: DataFrame, keep: Sequence[str] = ("url",), html: str = "html",
             only: frozenset[str] | None = None) -> DataFrame:
    """``keep`` columns, ``text_pieces``, ``names``, ``places`` and ``elements`` of every capture
    with HTML.

    ``names`` are the tags, ``.classes`` and ``#ids`` that occur on the page, and ``places`` the
    numbers of the elements that have each: a selector looks at these elements alone. The HTML
    itself is dropped here, as early as can be.

    With ``only``, the names that the caller's selectors look at (``select.names_of``), the other
    elements and the text outside are left behind as well. Numbers count the elements that stay, in
    document order, so these selectors find the same.
    """
    source = captures.filter(F.col(html).isNotNull()).select(*keep, html)
    schema = T.StructType([
        *[source.schema[k] for k in keep],
        T.StructField("text_pieces", T.ArrayType(T.StringType())),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("elements", T.ArrayType(ELEMENT)),
    ])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PAGES_PER_OUTPUT):
                part = batch.slice(at, _PAGES_PER_OUTPUT)
                pages = _Pages(only)
                for page in part.column(part.num_columns - 1).to_pylist():
                    pages.add(page)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *pages.arrow()], names=[*part.schema.names[:-1], "text_pieces", "names", "places", "elements"])

    return source.mapInArrow(flatten, schema)
