"""The element tree of cleaned markup as Column expressions (HX9).

A page's tags are folded once, left to right, over the stack of open elements.
An element that an image lies in leaves a *span* when it ends: the positions of
its tags and the offsets of its text.  The nearest enclosing element of an image
is then the span with the largest opening position around the image's own; no
tree is built, and nothing but the spans is kept.

Elements end at their end tag, at the end tag of an element around them, where
HTML implies an end tag, or at the end of the document.  An end tag without an
open element is ignored; ``<x/>`` has no content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html
from .text import _c

# Elements without content, and the elements whose start
# closes an open <p> (HTML's implied end tag).
VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = tuple(("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
                  "header hr main nav ol p pre section table ul").split())
# Elements whose end tag may be left out -> the open elements
# that their start ends, and the elements beyond which those are not looked for.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    "option": (("option",), ("select", "datalist")),
}
P_SCOPE = ("table", "td", "th", "button", "object", "caption")

TAG_NAME_RE = r"^</?([A-Za-z][^\s/>]*)"

_STACK = "array<struct<name: string, open: int, start: int, imgs: int>>"
_SPANS = "array<struct<open: int, close: int, start: int, end: int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def pieces(clean: Column | str) -> Column:
    """The decoded texts before, between and behind the tags."""
    return F.transform(F.split(_c(clean), html.TAG_RE), lambda t: html.decode_entities(t))


def tags(clean: Column | str) -> Column:
    return F.regexp_extract_all(_c(clean), F.lit(html.TAG_RE), 0)


def events(tags_col: Column | str, texts_col: Column | str) -> Column:
    """Per tag: its position, the length of the text before it, its name, what
    it does, which open elements it ends and beyond which it does not look."""
    def one(tag: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, TAG_NAME_RE, 1))
        return F.struct(i.cast("int").alias("i"), F.length(F.get(_c(texts_col), i)).alias("len"), name.alias("name"),
                        tag.startswith("</").alias("ends"), tag.endswith("/>").alias("empty"))

    def rule(e: Column) -> Column:
        n, starts = e["name"], ~e["ends"] & (e["name"] != "") & (~e["empty"] | (e["name"] == "img"))
        ended = F.when(e["ends"] & (n != ""), F.array(n)).when(~starts, _strings(()))
        beyond = F.when(~starts, _strings(()))
        for name, (closed, scope) in IMPLIED_END.items():
            ended = ended.when(n == name, _strings(closed))
            beyond = beyond.when(n == name, _strings(scope))
        ended = ended.when(n.isin(*CLOSES_P), _strings(("p",))).otherwise(_strings(()))
        beyond = beyond.when(n.isin(*CLOSES_P), _strings(P_SCOPE)).otherwise(_strings(()))
        return F.struct(e["i"].alias("i"), e["len"].alias("len"), n.alias("name"), (starts & ~n.isin(*VOID)).alias("push"),
                        (starts & (n == "img")).alias("img"), ended.alias("ended"), F.concat(ended, beyond).alias("looked"))

    return F.transform(F.transform(_c(tags_col), one), rule)


def image_spans(events_col: Column | str, length: Column) -> Column:
    """Spans of the elements that hold an image: (open, close, start, end)."""
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.lit(0).alias("off"), F.lit(0).alias("imgs"),
                     F.array().cast(_SPANS).alias("spans"))

    def innermost(stack: Column, e: Column) -> Column:
        """1-based place of the innermost open element that the tag ends or stops at; 0 if none."""
        places = F.transform(stack, lambda s, k: F.when(F.array_contains(e["looked"], s["name"]), k + 1).otherwise(0))
        return F.when(F.size(e["looked"]) == 0, F.lit(0)).otherwise(F.coalesce(F.array_max(places), F.lit(0)))

    def closed(stack: Column, imgs: Column, close: Column, end: Column) -> Column:
        held = F.filter(stack, lambda s: s["imgs"] < imgs)
        return F.transform(held, lambda s: F.struct(s["open"].alias("open"), close.alias("close"), s["start"].alias("start"),
                                                    end.alias("end")))

    def step(s: Column, e: Column) -> Column:
        off = s["off"] + e["len"]

        def cut(at: Column) -> Column:
            return F.when((at > 0) & F.array_contains(e["ended"], F.get(s["stack"], at - 1)["name"]), at).otherwise(0)

        def after(at: Column) -> Column:
            kept = F.when(at > 0, F.slice(s["stack"], F.lit(1), at - 1)).otherwise(s["stack"])
            node = F.struct(e["name"].alias("name"), e["i"].alias("open"), off.alias("start"), s["imgs"].alias("imgs"))
            gone = closed(F.slice(s["stack"], at, F.size(s["stack"])), s["imgs"], e["i"], off)
            return F.struct(F.when(e["push"], F.concat(kept, F.array(node))).otherwise(kept).alias("stack"), off.alias("off"),
                            (s["imgs"] + e["img"].cast("int")).alias("imgs"),
                            F.when(at > 0, F.concat(s["spans"], gone)).otherwise(s["spans"]).alias("spans"))

        return let(let(innermost(s["stack"], e), cut), after)

    def finish(s: Column) -> Column:
        return F.concat(s["spans"], closed(s["stack"], s["imgs"], F.lit(2 ** 31 - 1), length))

    return F.aggregate(_c(events_col), start, step, finish)


def nearest(spans: Column, at: Column, longer_than: int, length: Column) -> Column:
    """(start, end) of the innermost span around tag ``at`` whose text is longer
    than ``longer_than`` characters; the whole document if there is none."""
    around = F.filter(spans, lambda s: (s["open"] < at) & (at < s["close"]) & (s["end"] - s["start"] > longer_than))
    # of spans around one tag the innermost opens last
    best = F.array_max(F.transform(around, lambda s: F.struct(s["open"].alias("open"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.struct(F.coalesce(best["start"], F.lit(0)).alias("start"), F.coalesce(best["end"], length).alias("end"))
