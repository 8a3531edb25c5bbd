"""Seed and domain lists, built-in crawl definitions, status filter (SRC2-SRC5)."""

from spindex.functions import urls
from spindex.sources import tables


def test_seed_and_domain_files(spark, tmp_path):
    seeds = tmp_path / "seeds.txt"
    seeds.write_text("https://a.example\nhttps://b.example/x\n")
    doms = tmp_path / "domains.txt"
    doms.write_text("a.example\n")
    s = tables.seeds(spark, str(seeds))
    d = tables.allowed_domains(spark, str(doms))
    assert sorted(r.url for r in s.collect()) == ["https://a.example", "https://b.example/x"]
    kept = urls.in_scope(s, "url", d, ("url",))
    assert [r.url for r in kept.collect()] == ["https://a.example"]


def test_crawl_defs(spark):
    defs = tables.crawl_defs(spark)
    rows = {r.name: r for r in defs.collect()}
    assert set(rows) == {"ent", "misc", "misc2", "news", "news2", "quotes", "test", "from_file"}
    assert rows["misc2"].allowed_domains is None
    assert list(rows["test"].start_urls) == ["https://www.nytimes.com"]
    assert tables.crawl_seeds(defs).count() == 20


def test_only_ok(spark):
    raw = spark.createDataFrame([("http://h/a", "<p>x</p>", 200, None, None, 1),
                                 ("http://h/b", "<p>y</p>", 404, None, None, 2)], tables.RAW_PAGES_SCHEMA)
    assert [r.url for r in tables.only_ok(tables.responses(raw)).collect()] == ["http://h/a"]
