"""Streaming sink: replayed micro-batches are idempotent; stream == batch."""

from spindex.operators import pages, postings
from spindex.sources import tables
from spindex.streaming import ingest


def _raw(spark, rows, start=0):
    data = [(u, h, 200, None, None, start + i) for i, (u, h) in enumerate(rows)]
    return tables.responses(spark.createDataFrame(data, tables.RAW_PAGES_SCHEMA))


def _counts(df):
    return sorted((r.token, r.url, r["count"]) for r in df.collect())


def test_replay_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "out")
    run = ingest.fan_out(out, stem=False)
    b0 = _raw(spark, [("http://h/a", "<title>Cats</title><p>cats purr <a href='/b'>b</a></p>")])
    b1 = _raw(spark, [("http://h/b", "<p>dogs bark at cats</p>")], start=10)
    run(b0, 0)
    run(b1, 1)
    first = _counts(ingest.read_postings(spark, out))
    run(b1, 1)                       # replay after a failure
    assert _counts(ingest.read_postings(spark, out)) == first
    both = b0.unionByName(b1)
    batch = postings.term_counts(pages.parse(both).select("url", "text"), stem=False)
    assert first == _counts(batch)
    bl = {(r.url, r.backlink) for r in ingest.read_backlinks(spark, out).collect()}
    assert bl == {("http://h/b", "http://h/a")}
    titles = {r.url: r.title for r in ingest.read_pages(spark, out).collect()}
    assert titles == {"http://h/a": "Cats", "http://h/b": ""}


def test_stream_run_summary(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(1, "http://h/a", "<p>alpha beta</p>"), (2, "http://h/b", "<p>gamma</p>")]
    spark.createDataFrame(rows, ingest.DRIVER_PAGES_SCHEMA).coalesce(1).write.parquet(str(src / "part"))
    out = str(tmp_path / "out")
    summary = ingest.ingest(ingest.raw_page_stream(spark, str(src / "part")), out, stem=False)
    assert summary["pages_read"] == 2 and summary["batches"] >= 1
    assert _counts(ingest.read_postings(spark, out)) == [("alpha", "http://h/a", 1), ("beta", "http://h/a", 1),
                                                         ("gamma", "http://h/b", 1)]


def test_images_and_earlier_batch_wins(spark, tmp_path):
    out = str(tmp_path / "out")
    run = ingest.fan_out(out, stem=False)
    run(_raw(spark, [("http://h/a", "<title>First</title><p>kitten <img src='i.png' alt='one'></p>")], start=9), 0)
    later = _raw(spark, [("http://h/a", "<title>Second</title><p>puppy <img src='i.png' alt='two'></p>")], start=3)
    run(later, 1)
    run(later, 1)
    assert [r.title for r in ingest.read_pages(spark, out).collect()] == ["First"]
    assert [(r.url, r.alt) for r in ingest.read_images(spark, out).collect()] == [("i.png", "one")]
    got = {(t, n) for t, _, n in _counts(ingest.read_image_postings(spark, out))}
    assert got == {("first", 1), ("kitten", 1), ("one", 1), ("second", 1), ("puppy", 1), ("two", 1)}


def test_summary_counts_every_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for i in range(4):
            (spark.createDataFrame([(i, f"http://h/{i}", "<p>word</p>")], ingest.DRIVER_PAGES_SCHEMA).coalesce(1)
             .write.mode("append").parquet(str(tmp_path / "in")))
        got = ingest.ingest(ingest.raw_page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), stem=False)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert (got["batches"], got["pages_read"]) == (4, 4)


def test_page_table_as_file_or_folder(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>word{i} <a href='/{i + 1}'>x</a></p>") for i in range(6)]
    df = spark.createDataFrame(rows, ingest.DRIVER_PAGES_SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "file" / "pages.parquet")
    got = []
    for kind in ("folder", "file"):
        out = str(tmp_path / f"out-{kind}")
        ingest.ingest(ingest.page_table_stream(spark, str(tmp_path / kind)), out, stem=False)
        got.append((_counts(ingest.read_postings(spark, out)),
                    sorted(r.url for r in ingest.read_pages(spark, out).collect()),
                    sorted((r.url, r.backlink) for r in ingest.read_backlinks(spark, out).collect())))
    assert got[0] == got[1] and len(got[0][0]) == 12


def test_nothing_arrived(spark, tmp_path):
    out = str(tmp_path / "out")
    for read in (ingest.read_postings, ingest.read_pages, ingest.read_backlinks, ingest.read_images,
                 ingest.read_image_postings, ingest.read_running_counts):
        assert read(spark, out).count() == 0


def test_runs_are_compacted(spark, tmp_path):
    out = str(tmp_path / "out")
    run = ingest.fan_out(out, stem=False, compact_after=2)
    for i in range(3):
        run(_raw(spark, [(f"http://h/{i}", f"<p>shared word{i}</p>")], start=i), i)
    run(_raw(spark, [("http://h/1", "<p>shared word1</p>")], start=1), 1)   # replay of a batch that was merged
    assert len(ingest.posting_store(spark, out).manifest()["runs"]) <= 2
    assert [(t, n) for t, _, n in _counts(ingest.read_postings(spark, out))] == [("shared", 1)] * 3 + [
        ("word0", 1), ("word1", 1), ("word2", 1)]
