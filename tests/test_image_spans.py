"""Image contexts against a plain walk over an explicit stack, on random broken markup."""

import random
import re

from spindex.functions import html, tree
from spindex.operators import images, pages
from spindex.sources import tables

TAG = re.compile(html.TAG_RE.replace("++", "+").replace("*+", "*").replace("?+", "?"))


def _walk(markup):
    """[(src, context)] of a page without comments, scripts and character references."""
    markup = markup.replace("</", " </")
    texts, tags = TAG.split(markup), TAG.findall(markup)
    doc, stack, found, ended = "", [], [], {}

    def end(k):
        for node in stack[k:]:
            ended[node[2]] = len(doc)
        del stack[k:]

    for i, tag in enumerate(tags):
        doc += texts[i]
        name = re.match(tree.TAG_NAME_RE, tag)
        name = name[1].lower() if name else ""
        if tag.startswith("</"):
            closes, scope = (name,), ()
        elif not name or (tag.endswith("/>") and name != "img"):
            continue
        else:
            closes, scope = tree.IMPLIED_END.get(name, (("p",), tree.P_SCOPE) if name in tree.CLOSES_P else ((), ()))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closes or stack[k][0] in scope:
                if stack[k][0] in closes:
                    end(k)
                break
        if tag.startswith("</"):
            continue
        if name == "img":
            found.append((re.search('src="(.*?)"', tag)[1], list(stack)))
        elif name not in tree.VOID:
            stack.append((name, len(doc), i))
    doc += texts[-1]
    end(0)
    out = []
    for src, chain in found:
        long = [(start, ended[i]) for _, start, i in chain if ended[i] - start > images.CONTEXT_MIN_CHARS]
        start, stop = long[-1] if long else (0, len(doc))
        out.append((src, doc[start:stop]))
    return out


def test_random_markup(spark):
    rng = random.Random(8)
    names = ["div", "p", "span", "table", "tr", "td", "ul", "li", "b", "dl", "dt", "dd", "h1", "button", "option", "select"]

    def page():
        out = []
        for i in range(rng.randrange(3, 90)):
            x = rng.random()
            out.append(f"<{rng.choice(names)}>" if x < 0.3 else f"</{rng.choice(names)}>" if x < 0.5
                       else f'<img src="i{i}">' if x < 0.6 else rng.choice(["<br>", "<div/>", '<input value="a>b">', "< 3 "])
                       if x < 0.64 else rng.choice(["word ", "x" * rng.randrange(200), "\n"]))
        return "".join(out)

    rows = [(f"http://h/{i}", page(), 200, None, None, i) for i in range(150)]
    got = {}
    ctx = images.image_contexts(tables.responses(spark.createDataFrame(rows, tables.RAW_PAGES_SCHEMA)))
    assert "Python" not in ctx._jdf.queryExecution().executedPlan().toString()
    for r in sorted(ctx.collect(), key=lambda r: (r.ingest_seq, r.img_pos)):
        got.setdefault(r.ingest_seq, []).append((r.src, r.context))
    assert got == {i: w for i, (_, h, *_) in enumerate(rows) if (w := _walk(h))}


def test_unclosed_script_and_style(spark):
    rows = [("http://h/1", "<p>a1</p><script>var x = 'b1 </p>';", 200, None, None, 1),
            ("http://h/2", "<p>a2<style>p { b2 } <p>c2</p>", 200, None, None, 2),
            ("http://h/3", "<script>x</script>a3<style>y</style>b3", 200, None, None, 3)]
    parsed = pages.parse(tables.responses(spark.createDataFrame(rows, tables.RAW_PAGES_SCHEMA)))
    assert [r.text.split() for r in parsed.orderBy("ingest_seq").collect()] == [["a1"], ["a2"], ["a3b3"]]
