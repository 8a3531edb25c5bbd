"""Seen set and depths across crawls."""

import random

from spindex.operators import links
from spindex.operators.crawl_depth import DepthStore
from spindex.operators.seen import SeenSet


def _urls(spark, rows):
    return spark.createDataFrame([(u,) for u in rows], "url string")


def test_seen_set_is_exact(spark, tmp_path):
    links.checkpoint_dir(spark)
    seen = SeenSet.create(spark, str(tmp_path / "s"), buckets=8)
    assert seen.probe(_urls(spark, ["http://a"])).first().seen is False
    first = [f"http://h/{i}?b=1&a={i}" for i in range(2000)]
    assert seen.add("1", _urls(spark, first + first[:10] + [None]))
    assert not seen.add("1", _urls(spark, ["http://h/other"]))
    assert seen.add("2", _urls(spark, [f"http://h/{i}" for i in range(300)] + first[:50]))
    assert seen.manifest()["runs"][1]["blocks"] == -(-300 * 16 // 64)     # the known keys are not written again
    probes = ([(f"http://h/{i}?a={i}&b=1#frag", i < 2000) for i in range(1500, 4000)]        # same identity, other order
              + [(f"http://h/{i}", i < 300) for i in range(200, 900)] + [(None, False), ("http://h/5", True)])
    df = spark.createDataFrame(probes, "url string, seen boolean")
    for _ in range(2):
        want = sorted(((u, s) for u, s in probes), key=str)
        assert sorted(((r.url, r.seen) for r in seen.probe(df).collect()), key=str) == want
        assert seen.unseen(df.select("url")).count() == sum(not s for _, s in probes)
        report = seen.filter_report(df)
        new = len({u for u, s in probes if u and not s})
        assert report["probes"] == len({u for u, _ in probes if u})
        assert report["answered"] + report["false_hits"] == new and report["false_hits"] < 0.05 * new
        assert seen.compact() or len(seen.manifest()["runs"]) == 1


def _bfs(edges, seeds, limit):
    depth, level = {s: 0 for s in seeds}, set(seeds)
    d = 0
    while level and (limit is None or d < limit):
        d += 1
        level = {b for a, b in edges if a in level} - set(depth)
        depth |= {n: d for n in level}
    return depth


def test_depths_after_adding_edges(spark, tmp_path):
    rng = random.Random(3)
    for limit in (None, 3):
        store = DepthStore.create(spark, str(tmp_path / f"d{limit}"), max_depth=limit)
        edges, seeds = [], []
        for step in range(4):
            new = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range([10, 8, 0, 6][step])]
            if step == 1:
                new += [(f"chain{i}", f"chain{i + 1}") for i in range(6)]
            if step == 3:
                new += [("n0", "chain3")]
            start = [["n0"], [], ["chain0"], []][step]
            edges, seeds = edges + new, seeds + start
            before = {r.node: r.depth for r in store.depths().collect()}
            e = spark.createDataFrame(new, "node string, next string")
            s = spark.createDataFrame([(x,) for x in start], "node string") if start else None
            assert store.add(f"b{step}", e, s) and not store.add(f"b{step}", e, s)
            after = {r.node: r.depth for r in store.depths().collect()}
            assert after == _bfs(edges, seeds, limit)
            run = store.manifest()["runs"][-1]
            written = {r.node: r.depth for r in store.read_run("depths", "node string, depth int", run).collect()}
            assert written == {n: d for n, d in after.items() if before.get(n) != d}      # nothing else is written
            if step == 2:
                assert store.compact()
                assert {r.node: r.depth for r in store.depths().collect()} == after


def test_referrers_are_backlinks(spark):
    raw = spark.createDataFrame([("http://h/a#x", "http://h/"), ("http://h/b", None), ("http://h/c", "")],
                                "url string, referrer string")
    assert [tuple(r) for r in links.referrer_backlinks(raw).collect()] == [("http://h/a", "http://h")]
