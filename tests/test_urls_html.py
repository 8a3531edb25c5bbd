"""URL normaliser, link resolution and HTML extraction (FIXTURES.md)."""

from spindex.functions import html, urls
from spindex.operators import pages
from spindex.sources import tables


def test_format_url_and_fragments(spark):
    rows = [("http://a/",), ("http://a// ",), ("http://a/ ",), (" http://a/x/#f",)]
    df = spark.createDataFrame(rows, "u string")
    got = [(r.f, r.r) for r in df.select(urls.format_url("u").alias("f"),
                                         urls.remove_fragments("u").alias("r")).collect()]
    assert got == [("http://a", "http://a"), ("http://a//", "http://a//"),
                   ("http://a/", "http://a/"), ("http://a/x/#f", "http://a/x")]


def _parse(spark, url, body):
    raw = spark.createDataFrame([(url, body, 200, None, None, 1)], tables.RAW_PAGES_SCHEMA)
    return pages.parse(tables.responses(raw))


def test_links_resolution(spark):
    hrefs = ["/x", "y/", "//k.example/z", "https://m.example/", "https://m.example/", "mailto:a@b",
             "#top", "?q=1"]
    body = "<html><body>" + "".join(f'<a href="{h}">l</a>' for h in hrefs) + "</body></html>"
    got = list(_parse(spark, "https://h.example/d/p", body).first().urls)
    assert got == ["https://h.example/x", "https://h.example/d/y", "https://k.example/z",
                   "https://m.example", "https://h.example/d/p#top", "https://h.example/d/p?q=1"]


def test_dot_segments(spark):
    df = spark.createDataFrame([("http://a/b/c/d;p?q", "../../g"), ("http://a/b/c/d", "./g/."),
                                ("http://a/b/c/d", "g?y#s")], "b string, h string")
    got = [r.r for r in df.select(urls.resolve("b", "h").alias("r")).collect()]
    assert got == ["http://a/g", "http://a/b/c/g/", "http://a/b/c/g?y#s"]


def test_html_cases(spark):
    p = _parse(spark, "http://h/p", "<title>T1</title><title>T2</title><p>a1</p><p>b1</p>"
               "<div>a1<br>b1</div><script>var s='</p>zz';</script>&lt;b&gt; &amp;amp;"
               '<meta content="D" name="description">').first()
    assert p.title == "T1"
    assert p.description == "D"
    assert "zz" not in p.text
    assert "a1b1" in p.text and "<b> &amp;" in p.text


def test_title_format_and_missing(spark):
    p = _parse(spark, "http://h/p", "<title> A\n  B  </title>").first()
    assert p.title == "A B"
    q = _parse(spark, "http://h/q", "<p>no head</p>").first()
    assert (q.title, q.description) == ("", "")
    m = _parse(spark, "http://h/m", '<meta name="description"><p>x</p>').first()
    assert m.description == ""


def test_empty_html_rejected(spark):
    raw = spark.createDataFrame([("http://h/e", "", 200, None, None, 1)], tables.RAW_PAGES_SCHEMA)
    r = tables.responses(raw)
    assert pages.parse(r).count() == 0
    assert pages.rejects(r).count() == 1


def test_images(spark):
    p = _parse(spark, "http://h/p", '<img><img src="a.png" alt="Alt">').first()
    assert [(i.src, i.alt) for i in p.images] == [("", ""), ("a.png", "Alt")]


def test_host_and_scope(spark):
    df = spark.createDataFrame([("http://a.b.example.com/x", 1), ("http://other.org", 2)], "u string, k int")
    doms = spark.createDataFrame([("example.com",), ("b.example.com",)], "domain string")
    got = [r.k for r in urls.in_scope(df, "u", doms, ("k",)).collect()]
    assert got == [1]
    assert html is not None


def test_numeric_character_references(spark):
    s = "&#65;&#x42;&#0;&#xZZ; &amp;#67; &#38;lt; x&#233;y &#128512; &copy;&#"
    df = spark.createDataFrame([(s,)], "t string")
    got = df.select(html.decode_entities("t").alias("d")).first().d
    assert got == "AB�&#xZZ; &#67; &lt; xéy \U0001F600 ©&#"


def test_break_on_any_tag(spark):
    body = "<html><body><p>ab<b>cd</b>ef<br>gh</p></body></html>"
    raw = spark.createDataFrame([("http://a/", body, 200, None, None, 1)], tables.RAW_PAGES_SCHEMA)
    default = pages.parse(tables.responses(raw)).first().text.split()
    any_tag = pages.parse(tables.responses(raw), break_on="any_tag").first().text.split()
    assert default == ["abcd", "efgh"]
    assert any_tag == ["ab", "cd", "ef", "gh"]


def test_comments_and_scripts_leftmost_first(spark):
    p = _parse(spark, "http://h/p", "<!-- <script> --><p>kept words</p><script>v=1</script><p>tail</p>").first()
    assert p.text.split() == ["kept", "words", "tail"]


def test_greater_than_inside_attribute(spark):
    p = _parse(spark, "http://h/p", "<img alt=\"x > y\" src=\"z.png\"><p title=don't>a < b</p><i class=\"x>c</i>").first()
    assert [(i.src, i.alt) for i in p.images] == [("z.png", "x > y")]
    assert p.text.split() == ["a", "<", "b", "c"]


def test_long_tag_does_not_recurse(spark):
    long = "".join(f" a{i}='{i}'" for i in range(20000)) + f' data="{"y" * 200000}"'
    p = _parse(spark, "http://h/p", f"<p{long}>one</p><a{long} href='/z'>two</a>").first()
    assert p.text.split() == ["one", "two"] and list(p.urls) == ["http://h/z"]


def test_meta_description_attributes(spark):
    def described(tags):
        return _parse(spark, "http://h/p", tags + "<p>x</p>").first().description
    assert described('<meta data-name="description" content="X"><meta name="description" content="Y">') == "Y"
    assert described('<meta NAME="description" data-content="X" CONTENT="Y">') == "Y"
    assert described('<meta name="Description" content="X">') == ""


def test_element_names_are_whole(spark):
    p = _parse(spark, "http://h/p", '<a-card href="/bad">b</a-card><a href="/good">g</a><imgx src="n">').first()
    assert list(p.urls) == ["http://h/good"] and list(p.images) == []


def test_character_references(spark):
    s = "caf&eacute; &copy B &#000000065; &notit; &unknown; &amp;lt; &#x110000; &#123456789012; A&T"
    df = spark.createDataFrame([(s, "?a=1&copy=2&copyright&lt;")], "t string, u string")
    got = df.select(html.decode_entities("t").alias("d"), html.decode_entities("u", attribute=True).alias("a")).first()
    assert got.d == "café © B A ¬it; &unknown; &lt; � � A&T"
    assert got.a == "?a=1&copy=2&copyright<"


def test_white_space_page_is_rejected(spark):
    raw = spark.createDataFrame([("http://h/e", "\n \t", 200, None, None, 1)], tables.RAW_PAGES_SCHEMA)
    assert pages.parse(tables.responses(raw)).count() == 0
    assert pages.rejects(tables.responses(raw)).count() == 1
