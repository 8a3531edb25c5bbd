"""URL functions as Column expressions (UR1-UR5).

``resolve`` is RFC 3986 reference resolution as Python's ``urljoin`` does it
(dot segments removed, empty middle segments of a merged relative path
dropped), written with regex and array expressions so it stays on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# scheme, //authority, path, ?query, #fragment
SPLIT_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
WEB_SCHEMES = ("http", "https")


def format_url(u: Column | str) -> Column:
    """UR1: strip every trailing '/', then spaces at both ends."""
    return F.btrim(F.rtrim(_c(u), F.lit("/")), F.lit(" "))


def remove_fragments(u: Column | str) -> Column:
    """UR2: the part before the first '#', then UR1."""
    return format_url(F.substring_index(_c(u), "#", 1))


def url_parse_form(u: Column | str) -> Column:
    """What a URL parser sees: leading C0 controls and spaces removed, tabs
    and line breaks removed everywhere."""
    return F.regexp_replace(F.regexp_replace(_c(u), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(u: Column | str) -> Column:
    """Lowercase scheme, '' when the text has none."""
    return F.lower(F.regexp_extract(_c(u), SCHEME_RE, 1))


def is_web(u: Column | str) -> Column:
    """UR3: http or https."""
    return scheme(u).isin(*WEB_SCHEMES)


def host(u: Column | str) -> Column:
    """Lowercase host of an absolute URL ('' when none)."""
    return F.lower(F.regexp_extract(_c(u), HOST_RE, 1))


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, SPLIT_RE, i)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and the expression tree
    holding it once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _remove_dots(segments: Column) -> Column:
    """Fold path segments: '..' pops, '.' is skipped; a trailing '.' or '..'
    leaves a trailing slash."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                                          .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.try_element_at(segments, F.lit(-1)).isin(".", "..")
    return F.when(trailing, F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def base_parts(base: Column | str) -> Column:
    """The parts of a base URL ``resolve_with`` needs, as one struct column:
    scheme (lowercase), authority ('//host'), path, query, and the directory
    segments of the path.  Materialise it once per row."""
    base = _c(base)
    path = _part(base, 3)
    segs = F.split(path, "/")
    return F.struct(
        F.lower(_part(base, 1)).alias("scheme"),
        _part(base, 2).alias("auth"),
        path.alias("path"),
        _part(base, 4).alias("query"),
        F.when(F.try_element_at(segs, F.lit(-1)) != "", F.slice(segs, 1, F.size(segs) - 1))
        .otherwise(segs).alias("dir"),
        base.alias("url"),
    )


def _unsplit(sch: Column, auth: Column, path: Column, query: Column, frag: Column) -> Column:
    path = _let(path, lambda p: F.when((auth != "") & (p != "") & ~p.startswith("/"),
                                       F.concat(F.lit("/"), p)).otherwise(p))
    return F.concat(sch, F.lit(":"), auth, path,
                    F.when(query.isin("", "?"), F.lit("")).otherwise(query),
                    F.when(frag.isin("", "#"), F.lit("")).otherwise(frag))


def _merged_path(b_dir: Column, h_path: Column) -> Column:
    """Path of a relative reference: base dir segments + href segments, empty
    middle segments dropped, dot segments folded."""
    def cleaned(rel: Column) -> Column:
        return F.when(F.size(rel) <= 2, rel).otherwise(F.concat(
            F.slice(rel, 1, 1),
            F.filter(F.slice(rel, 2, F.size(rel) - 2), lambda s: s != ""),
            F.slice(rel, -1, 1)))

    parts = F.split(h_path, "/")
    segs = F.when(h_path.startswith("/"), parts).otherwise(_let(F.concat(b_dir, parts), cleaned))
    joined = F.array_join(_let(segs, _remove_dots), "/")
    return _let(joined, lambda j: F.when(j == "", F.lit("/")).otherwise(j))


def ref_parts(href: Column) -> Column:
    """The parts of a reference ``resolve_parts`` needs, as one struct."""
    names = ("scheme", "auth", "path", "query", "frag")
    return F.struct(href.alias("url"), *(_part(href, i).alias(n) for i, n in enumerate(names, 1)))


def resolve_with(b: Column, href: Column) -> Column:
    """UR4: ``href`` resolved against a ``base_parts`` struct."""
    return resolve_parts(b, ref_parts(href))


def resolve_parts(b: Column, ref: Column) -> Column:
    """UR4: a ``ref_parts`` struct resolved against a ``base_parts`` struct
    (Python ``urljoin`` rules)."""
    href = ref["url"]
    h_scheme, h_auth, h_path, h_query, h_frag = (ref[n] for n in ("scheme", "auth", "path", "query", "frag"))
    same_scheme = (h_scheme == "") | (F.lower(h_scheme) == b["scheme"])
    return (
        F.when(href == "", b["url"])
        .when(~same_scheme, href)
        .when(h_auth != "", _unsplit(b["scheme"], h_auth, h_path, h_query, h_frag))
        .when(h_path == "", _unsplit(b["scheme"], b["auth"], b["path"],
                                     F.when(h_query.isin("", "?"), b["query"]).otherwise(h_query), h_frag))
        .otherwise(_unsplit(b["scheme"], b["auth"], _merged_path(b["dir"], h_path), h_query, h_frag))
    )


def resolve(base: Column | str, href: Column | str) -> Column:
    """UR4 for one (base, href) pair of columns."""
    return resolve_with(base_parts(base), _c(href))


def host_suffixes(h: Column | str) -> Column:
    """'a.b.example.com' -> [a.b.example.com, b.example.com, example.com, com]."""
    parts = F.split(_c(h), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def in_scope(df: DataFrame, url_col: str, domains: DataFrame | None,
             key_cols: tuple[str, ...]) -> DataFrame:
    """UR5: rows whose URL host is an allowed domain or a subdomain of one.

    No domain table = everything allowed.  The test is an equi-join of the
    host's suffixes with the domain list (the list is broadcast by AQE when
    its measured size is small); a row matching several domains is kept once,
    by its key columns."""
    if domains is None:
        return df
    d = domains.select(F.lower(F.col("domain")).alias("_suffix")).distinct()
    keyed = df.select(*key_cols, F.explode(host_suffixes(host(url_col))).alias("_suffix"))
    hits = keyed.join(d, "_suffix", "left_semi").select(*key_cols).distinct()
    return df.join(hits, list(key_cols), "left_semi")
