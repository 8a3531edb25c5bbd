"""HTML extraction as Column expressions (HX1-HX8, HX11).

The parser is re-expressed as an ordered chain of regex rewrites:

    '</' -> ' </'                 a closing tag separates words, an opening
                                  or void tag does not ('a<br>b' -> 'ab')
    drop comments and <script>/<style> elements in one pass (before tag
                                  stripping: scripts may hold '</p>' in strings)
    drop remaining tags
    decode character references in one pass

All of it is built-in expressions, so extraction runs in the scan stage with
no Python and no shuffle.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls
from .text import _c

# The inside of a tag: a '>' within a quoted attribute value does not end it;
# a quote only opens a value after '='.  Possessive, so a long tag is matched
# by iteration, not recursion.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""


def _open(name: str) -> str:
    """Opening tag ``name`` (not of elements whose name only starts with it)."""
    return rf"<{name}(?:[\s/]{INSIDE})?+>"


VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# comments and dropped elements in one pass, leftmost first: a '<script>'
# inside a comment, or '<!--' inside a script, opens nothing; a script or style
# that is never closed goes on to the end of the document
DROP_RE = (r"(?is)<!--.*?-->|" + _open("script") + r".*?(?:</script\s*>|\z)|" + _open("style") + r".*?(?:</style\s*>|\z)")
TAG_RE = r"(?s)<[A-Za-z/!?]" + INSIDE + ">"
TITLE_RE = "(?is)" + _open("title") + "(.*?)</title"
META_RE = "(?is)" + _open("meta")
# the attribute's name is case-insensitive, its value is not
META_NAME_DESCRIPTION_RE = r"""(?s)\s(?i:name)\s*=\s*(?:"description"|'description'|description(?=[\s/>]|$))"""
META_CONTENT_RE = r"(?is)\scontent" + VALUE
A_RE = "(?is)" + _open("a")
BASE_RE = "(?is)" + _open("base")
HREF_ATTR_RE = r"(?is)\shref" + VALUE
IMG_RE = "(?is)" + _open("img")
SRC_ATTR_RE = r"(?is)\ssrc" + VALUE
ALT_ATTR_RE = r"(?is)\salt" + VALUE
NOT_BLANK_RE = r"[^ \t\n\r\f\x0b]"

# Named character references: HTML's table, from the standard library.  The
# references valid without ';' are tried longest first.
NAMED = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}
LEGACY = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
FREQUENT = ("amp", "lt", "gt", "quot", "nbsp")    # looked up first
LEGACY_IN_TEXT = "^(" + "|".join(LEGACY) + ")"
# in an attribute '&copy=1' and '&copyright' are query text, not references
LEGACY_IN_ATTRIBUTE = LEGACY_IN_TEXT + "(?:[^=A-Za-z0-9]|$)"

MAX_CODE_POINT = 0x10FFFF      # fixed values: Unicode range and the surrogate block
SURROGATES = (0xD800, 0xDFFF)
REPLACEMENT_CHAR = "�"


def _named_map() -> Column:
    """The named references as one literal map (folded once per plan)."""
    names = [*FREQUENT, *(n for n in NAMED if n not in FREQUENT)]
    return F.str_to_map(F.lit("\x02".join(f"{n}\x01{NAMED[n]}" for n in names)), F.lit("\x02"), F.lit("\x01"))


def _char(code: Column) -> Column:
    """The character with a code point; U+FFFD for 0, surrogates and values
    beyond Unicode (UTF-32 decoding of the 8-hex-digit code point)."""
    ok = (code > 0) & (code <= MAX_CODE_POINT) & ~code.between(*SURROGATES)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(REPLACEMENT_CHAR))


def decode_entities(c: Column | str, attribute: bool = False) -> Column:
    """HX3: every character reference of HTML -- named (the older names also
    without ';'), decimal and hexadecimal of any length -- decoded in one pass,
    so '&amp;lt;' gives '&lt;'.  The text is split on '&'; a piece that starts
    with a reference is decoded, any other gets its '&' back."""
    c = _c(c)
    table = _named_map()
    legacy_re = LEGACY_IN_ATTRIBUTE if attribute else LEGACY_IN_TEXT

    def found(p: Column) -> Column:
        return F.struct(
            p.alias("p"),
            F.regexp_extract(p, "^#[0-9]+;?", 0).alias("dec"),
            F.regexp_extract(p, "^#[xX][0-9a-fA-F]+;?", 0).alias("hex"),
            F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1).alias("name"),
            F.regexp_extract(p, legacy_re, 1).alias("legacy"))

    def digits(ref: Column, skip: int) -> Column:
        return F.ltrim(F.rtrim(ref.substr(F.lit(skip), F.length(ref)), F.lit(";")), F.lit("0"))

    def number(d: Column, base: int) -> Column:
        """0 (no character) for nothing but zeros and for more than 8 digits."""
        return F.when(F.length(d).between(1, 8), F.conv(d, base, 10).cast("bigint")).otherwise(F.lit(0))

    def one(f: Column) -> Column:
        p = f["p"]
        rest = lambda n: p.substr(n + 1, F.length(p))
        named = F.try_element_at(table, f["name"])
        return (F.when(f["dec"] != "", F.concat(_char(number(digits(f["dec"], 2), 10)), rest(F.length(f["dec"]))))
                .when(f["hex"] != "", F.concat(_char(number(digits(f["hex"], 3), 16)), rest(F.length(f["hex"]))))
                .when((f["name"] != "") & named.isNotNull(), F.concat(named, rest(F.length(f["name"]) + 1)))
                .when(f["legacy"] != "", F.concat(F.try_element_at(table, f["legacy"]), rest(F.length(f["legacy"]))))
                .otherwise(F.concat(F.lit("&"), p)))

    pieces = F.split(c, "&")
    tail = F.transform(F.transform(F.slice(pieces, 2, F.size(pieces) - 1), found), one)
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


def _unquote(c: Column) -> Column:
    """Attribute value without its surrounding quotes."""
    quoted = c.startswith('"') | c.startswith("'")
    return F.when(quoted, c.substr(F.lit(2), F.length(c) - F.lit(2))).otherwise(c)


def spaced(html: Column | str) -> Column:
    """Every '</' becomes ' </'."""
    return F.replace(_c(html), F.lit("</"), F.lit(" </"))


def cleaned(html: Column | str) -> Column:
    """HX1 + comments: the markup with script/style elements and comments
    removed (after the ' </' insertion)."""
    return F.regexp_replace(spaced(html), DROP_RE, "")


BREAK_ON = ("close_tag", "any_tag")


def page_text(clean: Column | str, break_on: str = "close_tag") -> Column:
    """HX2: document text (title included) from ``cleaned`` markup.

    Q12: by default only closing tags separate words (``spaced`` put a space
    before each '</'), so ``a<b>c</b>`` reads ``ac``; ``break_on='any_tag'``
    turns every tag into a space."""
    if break_on not in BREAK_ON:
        raise ValueError(f"break_on must be one of {BREAK_ON}, not {break_on!r}")
    gap = "" if break_on == "close_tag" else " "
    return decode_entities(F.regexp_replace(_c(clean), TAG_RE, gap))


def title(clean: Column | str) -> Column:
    """HX4: first <title>, its text formatted; '' when there is none."""
    inner = F.regexp_extract(_c(clean), TITLE_RE, 1)
    return text.format_text(decode_entities(F.regexp_replace(inner, TAG_RE, "")))


def meta_description_tag(clean: Column | str) -> Column:
    """HX5, first half: the first <meta name="description"> tag, or NULL."""
    metas = F.regexp_extract_all(_c(clean), F.lit(META_RE), 0)
    return F.try_element_at(F.filter(metas, lambda m: m.rlike(META_NAME_DESCRIPTION_RE)), F.lit(1))


def description(tag: Column | str) -> Column:
    """HX5, second half: the tag's content attribute, formatted; '' when
    there is no tag or no content attribute.  ``tag`` must be a column
    reference (it is read several times)."""
    tag = _c(tag)
    content = F.regexp_extract(tag, META_CONTENT_RE, 1)
    return F.when(tag.isNull(), F.lit("")).otherwise(
        text.format_text(decode_entities(_unquote_once(content), attribute=True)))


def _unquote_once(c: Column) -> Column:
    """``_unquote`` for an expression that must not be repeated: strips one
    pair of surrounding quotes with a single regex."""
    return F.regexp_replace(c, r"""^"([^"]*)"$|^'([^']*)'$""", "$1$2")


def hrefs(clean: Column | str) -> Column:
    """Raw href values of every <a href>, in document order."""
    tags = F.regexp_extract_all(_c(clean), F.lit(A_RE), 0)
    raw = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, HREF_ATTR_RE, 1)), lambda h: h != "")
    return F.transform(F.transform(raw, _unquote), lambda h: decode_entities(h, attribute=True))


def base_href(clean: Column | str) -> Column:
    """The first <base> tag's href value ('' when none)."""
    tag = F.regexp_extract(_c(clean), BASE_RE, 0)
    return decode_entities(_unquote_once(F.regexp_extract(tag, HREF_ATTR_RE, 1)), attribute=True)


def base_url(href: Column | str, fetch_url: Column | str) -> Column:
    """Base for relative links: the <base href> value resolved against the
    page URL, else the page URL.  Both arguments must be column references."""
    href = _c(href)
    return F.when(href != "", urls.resolve(fetch_url, href)).otherwise(_c(fetch_url))


def links(clean: Column | str, base: Column | str) -> Column:
    """HX7: absolute http(s) links in document order, formatted (UR1), each
    kept once at its first position.  ``base`` must be a materialised
    ``urls.base_parts`` column (see ``operators.pages.parse``)."""
    b = _c(base)
    forms = F.transform(hrefs(clean), lambda h: F.struct(h.alias("raw"), urls.url_parse_form(h).alias("p")))
    # each href is split once, into a struct the resolver reads by field
    split = F.transform(forms, lambda f: F.struct(f["raw"].alias("raw"), urls.ref_parts(f["p"]).alias("r")))
    cands = F.transform(split, lambda f: F.struct(
        F.when(F.lower(f["r"]["scheme"]).isin(*urls.WEB_SCHEMES), urls.format_url(f["raw"])).alias("abs"),
        urls.format_url(urls.resolve_parts(b, f["r"])).alias("joined")))
    picked = F.transform(cands, lambda c: F.when(c["abs"].isNotNull(), c["abs"])
                         .when(urls.is_web(c["joined"]), c["joined"]))
    return F.array_distinct(F.filter(picked, lambda u: u.isNotNull()))


def is_blank(html: Column | str) -> Column:
    """HX11: no character but white space."""
    return ~_c(html).rlike(NOT_BLANK_RE)


def images(clean: Column | str) -> Column:
    """HX8: array<struct<src, alt>> of every <img>, document order; missing
    attributes are ''.  ``src`` is not resolved."""
    tags = F.regexp_extract_all(_c(clean), F.lit(IMG_RE), 0)
    return F.transform(tags, lambda t: F.struct(
        decode_entities(_unquote_once(F.regexp_extract(t, SRC_ATTR_RE, 1)), attribute=True).alias("src"),
        decode_entities(_unquote_once(F.regexp_extract(t, ALT_ATTR_RE, 1)), attribute=True).alias("alt"),
    ))
