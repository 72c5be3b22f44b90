"""URL columns. Everything is a built-in expression, so it stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from pagecatalog.functions.binding import bind

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_PLAIN_PATH = r"^/(?![/.])(?:[^/.?#\t\r\n]|/(?![/.])|\.)*$"
_PLAIN_RELATIVE = r"^[^/.?#:\x00-\x20](?:[^/.?#:\t\r\n]|/(?![/.])|\.)*\z"
_DOTTED = r"(^|/)\.\.?(/|$)|//"
# schemes under which a relative reference means something
_HIERARCHICAL = ("http", "https", "ftp", "file")


def _col(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def site_root(url: Column | str) -> Column:
    """Scheme and authority: ``https://a.b/c?d`` -> ``https://a.b``."""
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)


def host_of(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def record_id(url: Column) -> Column:
    """Text after the last slash, query kept; a trailing slash gives ``''``."""
    return F.substring_index(url, "/", -1)


def capture_key(url: Column) -> Column:
    """Storage key of a capture: last segments collide, digests of whole URLs do not."""
    return F.md5(url)


def query_url(url: Column | str, params: Column | Mapping[str, Column | str]) -> Column:
    """``url?k=v&k=v`` without percent-encoding; no parameters, no question mark."""
    if isinstance(params, Mapping):
        params = F.create_map(*[c for k, v in params.items() for c in (F.lit(k), _col(v))]) \
            if params else F.create_map().cast("map<string,string>")
    pairs = F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.when(F.coalesce(F.size(params), F.lit(0)) == 0, _col(url)) \
        .otherwise(F.concat(_col(url), F.lit("?"), F.array_join(pairs, "&")))


def _dot_free(segments: Column) -> Column:
    """Drop ``.`` segments and let each ``..`` take the segment before it."""
    def step(kept: Column, seg: Column) -> Column:
        return (F.when(seg == ".", kept)
                .when(seg == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .otherwise(F.concat(kept, F.array(seg))))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    path = F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    # ".." may have taken the empty segment before the first slash
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _split_base(base: Column) -> Column:
    after_root = F.regexp_replace(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    return F.struct(
        F.lower(F.regexp_extract(base, _SCHEME, 1)).alias("scheme"),
        F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", 0).alias("root"),
        F.regexp_extract(after_root, r"^[^?#]*", 0).alias("path"),
        F.regexp_extract(after_root, r"^[^?#]*(\?[^#]*)?", 1).alias("query"),
    )


def _split_reference(ref: Column) -> Column:
    """An optional scheme, then the rest in parts; a bare ``?`` or ``#`` counts as none."""
    body = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
    return F.struct(
        F.lower(F.regexp_extract(ref, _SCHEME, 1)).alias("scheme"),
        F.regexp_replace(ref, _SCHEME, "").alias("rest"),
        F.regexp_extract(ref, body + r"([^?#]*)", 1).alias("path"),
        F.regexp_extract(ref, body + r"[^?#]*(\?[^#]+)?", 1).alias("query"),
        F.regexp_extract(ref, r"(#.+)$", 1).alias("fragment"),
    )


def _folder(base: Column) -> Column:
    """What a plain relative path is put behind: the base up to the last slash of its path. NULL if dot
    segments of the base have to be unfolded."""
    parts = _split_base(base)
    folder = F.regexp_extract(parts["path"], r"^(.*/)[^/]*$", 1)
    return F.when(~folder.rlike(_DOTTED), F.concat(parts["root"], F.when(folder == "", F.lit("/")).otherwise(folder)))


def _merge_path(base_path: Column, path: Column) -> Column:
    """A relative path put in the base's folder, dot segments unfolded."""
    folder = F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1)
    whole = F.when(path.startswith("/"), path) \
        .otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))

    def unfold(parts: Column) -> Column:
        # empty segments vanish from the middle of a merged path, not from an absolute one
        middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        return _dot_free(F.when(path.startswith("/"), parts).otherwise(F.concat(
            F.slice(parts, 1, 1), F.filter(middle, lambda s: s != ""), F.slice(parts, -1, 1))))

    return bind(whole, lambda w: F.when(w.rlike(_DOTTED), bind(F.split(w, "/"), unfold)).otherwise(w))


def _resolve_parts(href: Column, b: Column, r: Column) -> Column:
    foreign = (r["scheme"] != "") & (
        (r["scheme"] != b["scheme"]) | ~r["scheme"].isin(*_HIERARCHICAL))
    scheme = F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise(F.lit(""))
    query = F.when(r["query"] == "", b["query"]).otherwise(r["query"])
    return (
        F.when(foreign, href)
        .when(r["rest"].startswith("//"), F.concat(scheme, r["rest"]))
        .when(r["path"] == "", F.concat(b["root"], b["path"], query, r["fragment"]))
        .otherwise(F.concat(b["root"], _merge_path(b["path"], r["path"]), r["query"], r["fragment"]))
    )


def resolve_url(base: Column | str, href: Column) -> Column:
    """Resolve ``href`` against ``base`` by the rules of RFC 3986.

    The common forms, a plain ``/path`` or ``path``, take the cheap branches; the other branches are
    evaluated only for the links that need them.
    """
    base = _col(base)
    ref = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return (
        F.when(href.isNull(), F.lit(None).cast("string"))
        .when(href == "", base)
        .when(href.rlike(_PLAIN_PATH), F.concat(site_root(base), href))
        .when(href.rlike(_PLAIN_RELATIVE) & _folder(base).isNotNull(), F.concat(_folder(base), href))
        .otherwise(bind(_split_base(base), lambda b: bind(
            _split_reference(ref), lambda r: _resolve_parts(href, b, r))))
    )
