"""Time-clustered tables and first-wins state in a stream."""

import datetime as dt
import random

from spindex.operators import merge, pages, scans
from spindex.operators.timeline import TimeTable
from spindex.sources import tables
from spindex.streaming import first_wins, ingest

T0 = dt.datetime(2024, 1, 1)


def test_ranges_read_fewer_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp")
    store = TimeTable.create(spark, str(tmp_path / "t"), df, "ts", per_file=100)
    for i in range(2):
        part = df.where(f"id % 2 = {i}")
        assert store.add(str(i), part) and not store.add(str(i), part)
    ranges = [("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-15"), ("2023-01-01", "2025-01-01"), ("2025-01-01", "2026-01-01"),
              ("2024-01-03 00:30:00", "2024-01-03 00:30:00")]
    for compacted in (False, True):
        assert store.compact() == compacted or not compacted or len(store.manifest()["runs"]) == 1
        assert store.rows().count() == 3000 and store.files().agg({"n": "sum"}).first()[0] == 3000
        read = []
        for a, b in ranges:
            got = store.between(a, b)
            read.append(len(got.inputFiles()))
            want = sorted(r.id for r in scans.time_range(df, "ts", a, b).collect())
            assert sorted(r.id for r in got.collect()) == want
        assert read[0] < read[1] < read[2] and read[3] == 0
        assert read[2] <= store.files().where("low IS NOT NULL").count()


def _feed(spark, path, rows):
    data = [(u, f"<title>{t}</title><p>x</p>", 200, None, when, seq) for u, t, when, seq in rows]
    spark.createDataFrame(data, tables.RAW_PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _titles(spark, out):
    return sorted((r.url, r.title) for r in spark.read.parquet(f"{out}/first").collect())


def test_first_wins_over_batches_and_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], tables.RAW_PAGES_SCHEMA).write.parquet(src)
    stream = lambda: pages.parse(tables.only_ok(ingest.response_stream(spark, src)))
    _feed(spark, src, [("http://h/a", "A9", T0, 9), ("http://h/a#x", "A5", T0, 5), ("http://h/b", "B1", T0, 1)])
    first_wins.run(stream(), out)
    assert _titles(spark, out) == [("http://h/a#x", "A5"), ("http://h/b", "B1")]
    _feed(spark, src, [("http://h/a", "A1", T0, 1), ("http://h/c", "C7", None, 7)])
    _feed(spark, src, [("http://h/c", "C2", T0, 2), ("http://h/d", "D", T0, 3)])
    first_wins.run(stream(), out)                  # goes on from its checkpoint
    first_wins.run(stream(), out)                  # nothing new
    got = _titles(spark, out)
    assert ("http://h/a#x", "A5") in got and len(got) == 4 and {u.split("#")[0] for u, _ in got} == {f"http://h/{x}" for x in "abcd"}
    first = merge.first_full_rows(pages.parse(tables.responses(spark.createDataFrame(
        [("http://h/a", "<title>A9</title>", 200, None, None, 9), ("http://h/a#x", "<title>A5</title>", 200, None, None, 5)],
        tables.RAW_PAGES_SCHEMA)))).first()
    assert first.title == "A5"                     # the same choice as the batch operator within one batch


def test_state_expires(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    hour = dt.timedelta(hours=1)
    spark.createDataFrame([], tables.RAW_PAGES_SCHEMA).write.parquet(src)
    stream = lambda: pages.parse(tables.only_ok(ingest.response_stream(spark, src)))
    for rows in ([("http://h/a", "one", T0, 1)], [("http://h/a", "soon", T0 + hour, 2), ("http://h/z", "z", T0 + 9 * hour, 3)],
                 [("http://h/y", "y", T0 + 9.5 * hour, 4)], [("http://h/a", "late", T0 + 10 * hour, 5)]):
        _feed(spark, src, rows)
        first_wins.run(stream(), out, expire_after="2h")
    assert _titles(spark, out) == [("http://h/a", "late"), ("http://h/a", "one"), ("http://h/y", "y"), ("http://h/z", "z")]
