"""WARC, nearest neighbours, deduplication and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindex.llm import ann, exact, jaccard, lines, queries, shingles, warc
from spindex.llm.common import shared_path

# ----------------------------------------------------------------- 3 WARC


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    return df.withColumn("payload", F.lit(1)).withColumn("sha1", F.lit("x")).withColumn("page", F.lit(2))


def test_round_trip(spark):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
    long = "".join(random.Random(3).choice("abcé\n\r ") for _ in range(300_000))
    htmls = ["<p>a</p>", None, "", "<p>a</p>", nasty, nasty, "WARC/1.1\r\n" * 9000, long, long, "\r\n\r\n", "0\r\n\r\n", "<p>a</p>"]
    rows = [(i * 3 - 4, f"http://x/{i}" if i % 2 else None, h) for i, h in enumerate(htmls)]
    rows += [(50, "http://a\r\nb", "twice"), (50, None, "twice"), (None, "u", "twice"), (None, "u", "alone")]
    path = shared_path(spark, "warc")
    warc.write(pages(spark, rows), path, segment=1000, chunk_size=300)
    back = warc.read(spark, path)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()),
                 key=str)
    keep = {}
    for k, _, h in rows:
        keep.setdefault(h or "", []).append(k)
    top = {h: max(ks, key=lambda k: (k is not None, k or 0)) for h, ks in keep.items()}
    want, used = [], set()
    for k, _, h in rows:
        data = (h or "").encode()
        first = k == top[h or ""] and (k, data) not in used
        used.add((k, data))
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if first else "revisit", None if first else top[h or ""]))
    assert got == sorted(want, key=str)
    assert back.where("NOT intact").count() == 0
    bodies = {bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()}
    assert bodies == {(h or "").encode() for _, _, h in rows}
    files = [x for x in spark.read.option("lineSep", "\r\n").text(path).collect()]
    assert any("WARC-Type: continuation" in r["value"] for r in files)


def test_broken_archive(spark):
    """A lost continuation and a changed byte are told."""
    path = shared_path(spark, "warc")
    warc.write(pages(spark, [(1, None, "a" * 5000), (2, None, "fine"), (3, None, "changed")]), path, segment=1000)
    raw = spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(path)
    kept = raw.where("NOT (value LIKE '%WARC-Segment-Number: 3%')").select(
        F.regexp_replace(F.regexp_replace("value", r"(\r\n)+$", ""), "\r\nchanged", "\r\nchANGED").alias("value"))
    kept = kept.select(F.concat(F.when(F.col("value").startswith("WARC/1.1"), "").otherwise("WARC/1.1\r\n"), "value").alias("value"))
    # cut line ends are part of the last chunk's framing: put them back
    kept = kept.select(F.when(F.col("value").endswith("\r\n0"), F.concat("value", F.lit("\r\n\r\n"))).otherwise(F.col("value")).alias("value"))
    other = shared_path(spark, "warc")
    kept.coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(other)
    got = {r["page_id"]: r["intact"] for r in warc.read(spark, other).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_records_in_any_pieces():
    """Whatever separators the line reader sees or misses, the records are the same."""
    rng = random.Random(2)
    body = b"\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\nx"
    want = [body * rng.randrange(3) + b"y" * rng.randrange(50) for _ in range(30)]
    data = b"".join(warc._record([("WARC-Type", "response")], w) + b"\r\n\r\n" for w in want)
    parts = data.split(b"\r\n\r\n" + warc.VERSION)
    for keep in (0.0, 0.3, 0.8, 1.0):
        pieces = [parts[0]]
        for p in parts[1:]:
            if rng.random() < keep:
                pieces[-1] += b"\r\n\r\n" + warc.VERSION + p
            else:
                pieces.append(p)
        batches = [pa.RecordBatch.from_arrays([pa.array([p], pa.binary())], names=["value"]) for p in pieces]
        assert [block for _, block in warc._whole(batches)] == want


def test_warc_empty_and_small_payloads(spark):
    assert warc.round_trip(pages(spark, [(1, None, "a")]).limit(0)).count() == 0
    got = warc.round_trip(pages(spark, [(1, None, "a"), (2, None, "a")]), min_bytes=2).collect()
    assert {r["record_type"] for r in got} == {"response"}


# ----------------------------------------------------------- 4 neighbours

def brute(x, ids, q, qid, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != qid][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int, dim int, n int, cell long").repartition(3)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x = (x + rng.standard_normal((10, 64))[rng.integers(0, 10, 3000)]).astype(np.float32)
    df = vectors(spark, [(i, v.tolist(), "a", 1, 2, 3, 4) for i, v in enumerate(x)])
    got = ann.search(df, df.where("vec_id % 100 = 0"), slice_rows=150).collect()
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute(x.astype(float), np.arange(3000), x[q].astype(float), q, 10)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & {w[0] for w in want})
        for _, v, s in mine:
            assert s == pytest.approx(float(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())), abs=1e-12)
    assert hits >= 0.9 * 300


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, -2.0, 0.0]
    rows = [(i, same) for i in range(0, 40)] + [(100, [1.0, -2.0, -0.0]), (101, [5.0, 5.0, 5.0]), (200, None), (300, [0.0, 0.0, 0.0]),
            (400, [nan, 1.0, 1.0]), (500, [inf, 1.0, 1.0]), (600, [1.0, None, 1.0]), (700, []), (800, [1.0, 1.0]), (None, same)]
    df = vectors(spark, [(i, v, "a", 1, 2, 3, 4) for i, v in rows])
    got = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in got} == {0, 100}  # 800 has no vector of its dimension
    first = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert first == list(range(1, 11))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == list(range(10))
    few = df.where("vec_id IN (0, 100, 101)")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0")).collect())
    assert got == [(0, 1, 100), (0, 2, 101)]
    assert ann.search(df.limit(0), df.limit(0)).collect() == []


def test_probe_order_is_by_score():
    rng = np.random.default_rng(1)
    frac = rng.random(4)
    got = ann.probe_order(frac, 81)
    score = lambda moves: sum((frac[j] if s < 0 else 1 - frac[j]) ** 2 for j, s in moves)
    assert len({tuple(sorted(m)) for m in got}) == 81 and got[0] == []
    assert [score(m) for m in got] == sorted(score(m) for m in got)


# ---------------------------------------------------------- 6 exact dedup

def plain_dedup(rows):
    groups = {}
    for at, (k, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), k is None, k or 0, at, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[4], best[4], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), {n: min(m)[:3] for n, m in groups.items()}


TEXTS = [(5, "a b"), (2, "ab"), (9, "a  b"), (3, "A b"), (4, None), (6, ""), (7, " \n"), (8, " "), (1, "é x"), (0, "éx"),
         (None, "ab"), (2, "ab"), (11, "w " * 60_000), (12, "w" * 60_000)]


def test_exact(docs_of):
    got = exact.dedup(docs_of(TEXTS)).collect()
    want, _ = plain_dedup(TEXTS)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.dedup(docs_of(TEXTS).limit(0)).count() == 0


def test_exact_over_batches(spark, docs_of):
    """The index gives the same groups however the rows are dealt over batches."""
    index = exact.DigestIndex(spark, shared_path(spark, "index"), buckets=4)
    prints = [exact.fingerprints(docs_of(part)) for part in (TEXTS[:5], TEXTS[5:9], TEXTS[9:])]
    new = [index.add(p) for p in prints]
    assert [n.where("is_new").count() for n in new] == [3, 2, 2] or sum(n.where("is_new").count() for n in new) == len(
        {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS})
    every = [r for p in prints for r in index.decide(p).collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in every), key=str) == plain_dedup(TEXTS)[0]
    assert sum(r["kept"] for r in every) == len({r["text_sha256"] for r in every})
    plan = index.spark.table(index.name).where("is_new")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()


def test_index_is_reopened_with_its_own_buckets(spark, docs_of):
    """Another session's shuffle partitions don't change where stored digests are looked for."""
    path = shared_path(spark, "index")
    prints = exact.fingerprints(docs_of(TEXTS))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 7, 2):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            index = exact.DigestIndex(spark, path)
            assert index.buckets == 4 and index.key_type == "bigint"
            assert index.add(prints).where("is_new").count() == (len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS})
                                                                 if n == 4 else 0)
            index.close()
            assert index.name not in {t.name for t in spark.catalog.listTables()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for wrong in ({"buckets": 7}, {"key_type": "string"}):
        with pytest.raises(ValueError):
            exact.DigestIndex(spark, path, **wrong)


def test_anti_join_decides(spark, docs_of):
    """Fed in batches, later ones meet an index that holds something."""
    index = exact.DigestIndex(spark, shared_path(spark, "index"))
    got = exact.dedup(docs_of(TEXTS), index=index, batches=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain_dedup(TEXTS)[0]
    rows = spark.table(index.name).groupBy("is_new").count().collect()
    assert {r["is_new"] for r in rows} == {True, False}
    index.close()


CLASHES = ("lang_pred", "lang_score", "foreign", "__foreign", "__found", "found", "found_", "row", "t", "k", "s", "of", "from",
           "copies", "__copies", "__k", "__digest", "__len", "digest", "n_chars", "n_same", "kept", "of_digest", "same", "text_sha256",
           "a.b", "node")


def test_stages_keep_user_columns(spark, data):
    """Columns with the names that stages work with come out as they went in."""
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit("mine").alias("n_chars"))
    docs = docs.withColumns({c: F.lit("mine") for c in CLASHES if c != "n_chars"})
    for name, stage in p.STAGES[:-1]:
        left = stage(spark, docs, data)
        assert left.columns == docs.columns, name
        row = left.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(CLASHES)],
                       *[F.min(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(CLASHES)]).first()
        assert set(row) == {1, "mine"}, name


def test_survivors_keep_columns(docs_of):
    docs = docs_of(TEXTS)
    left = exact.survivors(docs, exact.dedup(docs))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted(
        [(9, "a  b"), (3, "A b"), (7, " \n"), (8, " "), (1, "é x"), (0, "éx"), (11, "w " * 60_000)])


# -------------------------------------------------------- 7 Jaccard join

def plain_sets(rows, n):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def plain_components(rows, n, num, den):
    s = plain_sets(rows, n)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            x = len(s[i] & s[j])
            if s[i] and s[j] and den * x >= num * (len(s[i]) + len(s[j]) - x):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((k, len(s[i]), min(groups[find(i)]) if s[i] else k) for i, (k, _) in enumerate(rows))


def corpus(seed, n=130):
    """Chains and families of near copies at all distances around the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 90, 300]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            rows.append((len(rows) * 7 % 1009, " ".join(base)))
            base = list(base)
            for _ in range(max(1, len(base) // 60 + rng.randrange(3))):
                base[rng.randrange(len(base))] = rng.choice(words)
    return rows


@pytest.mark.parametrize("seed,n,num,den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 1, 70, 100)])
def test_components(docs_of, seed, n, num, den):
    rows = corpus(seed) + [(2000, ""), (2001, None), (2002, " \n"), (2003, "One two"), (2004, "one TWO "), (2005, "one two three"),
                           (2006, "É a b c d"), (2007, "é a b c d"), (2008, "x " * 30_000), (2009, "x " * 40_000)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(
        docs_of(rows), n=n, num=num, den=den).collect())
    assert got == plain_components(rows, n, num, den)


def test_blocks_of_a_large_region(docs_of):
    """A region split into pairs of blocks finds the same links."""
    rows = corpus(5, 160)
    found, _, labels = jaccard.join(docs_of(rows), n=1, num=70, den=100, region_rows=3)
    got = found.join(labels, "node", "left").collect()
    parts = {}
    for r in got:
        parts.setdefault(r["label"] if r["label"] is not None else r["node"], []).append(r["doc_id"])
    want = {}
    for k, _, c in plain_components(rows, 1, 70, 100):
        want.setdefault(c, []).append(k)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_recursive_region_equals_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
        for _ in range(15):
            sets.append(np.unique(base))
            base = base.copy()
            base[rng.integers(0, len(base), rng.integers(0, 12))] = rng.integers(0, 1 << 40, 1).astype(np.uint64)
    sketches = np.stack([jaccard.fold(jaccard.sketch_of(s), jaccard.SKETCH // 64) for s in sets])
    region = jaccard.Region(sets, sketches, np.arange(len(sets)), 80, 100)
    region.join(np.arange(len(sets)))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            x = len(np.intersect1d(sets[i], sets[j]))
            if jaccard.linked(x, len(sets[i]), len(sets[j]), 80, 100):
                label = [label[j] if v == label[i] else v for v in label]
    same = lambda m: {tuple(i for i in range(len(m)) if m[i] == v) for v in set(m)}
    assert same(list(region.label)) == same(label)


def test_classes_lose_no_link():
    """Linked sets always share a key."""
    rng = np.random.default_rng(9)
    for num, den in ((85, 100), (80, 100)):
        bands = jaccard.Bands(num, den)
        for _ in range(400):
            n = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, max(1, n // 5) + 1))
            y = np.unique(np.concatenate((x[rng.permutation(len(x))[drop:]], rng.integers(0, 1 << 63, drop // 3).astype(np.uint64))))
            inter = len(np.intersect1d(x, y))
            if len(y) and jaccard.linked(inter, len(x), len(y), num, den):
                assert len(np.intersect1d(bands.keys(x), bands.keys(y)))


def test_shingles():
    texts = [b"", b"A b  c\nd", b"a b c d e", b"a b", b"B a", b"\xc3\x89 x"]
    s = shingles.sets(texts, 4)
    assert [len(x) for x in s] == [0, 1, 2, 1, 1, 1] and s[1][0] in s[2]
    assert all((np.diff(x.astype(object)) > 0).all() for x in shingles.sets([b"q w e r t y " * 40], 2))


def test_repeated_keys_and_empty(docs_of):
    rows = [(1, "a b c d e"), (1, "z z z z z"), (3, "z z z z z"), (None, "lone text of its own")]
    found = jaccard.near_duplicates(docs_of(rows), n=4, num=85, den=100)
    got = sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (3, 1), (None, None)], key=str)
    docs = docs_of(rows)
    left = sorted((r["doc_id"], r["text"]) for r in jaccard.survivors(docs.where("doc_id IS NOT NULL")).collect())
    assert left == [(1, "a b c d e"), (1, "z z z z z")]
    assert jaccard.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [3, 512])
def test_all_links(docs_of, block):
    """Every linked pair is found and counted, copies included, in whole components and in blocks."""
    rows = corpus(7, 90)
    rows += [(3000 + i, rows[i][1]) for i in range(0, 90, 9)] + [(4000, ""), (4001, None), (None, "z y x w v"), (None, "Z y x w v")]
    rows += [(5000 + i, " ".join(f"v{w}" if w != 16 * i + 5 else f"other{i}" for w in range(200))) for i in range(12)]
    sets = plain_sets(rows, 4)
    pairs = {(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * (x := len(sets[i] & sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - x)}
    want = sorted(((k, sum(i in p for p in pairs)) for i, (k, _) in enumerate(rows)), key=str)
    got = jaccard.link_counts(docs_of(rows), n=4, num=85, den=100, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(((r["doc_id"], r["n_links"]) for r in got.collect()), key=str) == want
    if block == 512:
        found, links = jaccard.all_links(docs_of(rows), n=4, num=85, den=100)
        mine = {frozenset((r["a"], r["b"])) for r in links.collect()}
        names = {r["doc_id"]: r["node"] for r in found.collect()}
        assert mine == {frozenset((names[rows[i][0]], names[rows[j][0]])) for i, j in pairs if sets[i] != sets[j]}
        assert links.count() == len(mine)
        _, few, _ = jaccard.join(docs_of(rows), n=4, num=85, den=100)
        assert few.count() < len(mine)  # a spanning set


def test_one_survivor_per_component(spark, docs_of):
    """Null and repeated keys: the pipeline's stage keeps one row of every component, and all rows without words."""
    import corpus_pipeline as p

    lone, near = "a text that nothing else is like", " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c d e"), (1, "z z z z z"), (3, "z z z z z"), (None, lone), (None, "quite another text on its own here"),
            (4, near), (None, near + " more"), (None, near), (5, "q r s t u v"), (5, "q r s t u v"), (5, "Q R s t u v"),
            (None, "two null keys alike"), (None, "two null keys alike"), (6, ""), (6, None), (None, " \n")]
    docs = docs_of(rows)
    left = p.jaccard_join(spark, docs, "")
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    five = [x for x in got if x[0] == 5]
    want = [(1, "a b c d e"), (1, "z z z z z"), (None, lone), (None, "quite another text on its own here"), (4, near),
            (None, "two null keys alike"), (6, ""), (6, None), (None, " \n")]
    assert len(five) == 1 and sorted([x for x in got if x[0] != 5], key=str) == sorted(want, key=str)
    # a null-key component of one row doesn't bring other null-key rows along
    one = docs_of([(4, near), (None, near), (None, lone)])
    assert sorted(((r["doc_id"], r["text"]) for r in p.jaccard_join(spark, one, "").collect()), key=str) == sorted(
        [(4, near), (None, lone)], key=str)
    assert p.jaccard_join(spark, docs.limit(0), "").count() == 0


# ----------------------------------------------------------- 8 line dedup

def plain_chunks(rows):
    """(key, first line, lines) of every later occurrence of a chunk of two lines or more, by (key, position)."""
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: r[0]):
        held, before = [], 0
        parts = t.split("\n") if t is not None else []
        for i, line in enumerate(parts):
            h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
            held.append(line)
            if (h + 31 * before) % lines.DIVISOR == 0 or i == len(parts) - 1:
                body = tuple(held)
                if len(body) >= 2 and re.search(r"[^\x20\x09-\x0D]", "".join(body)):
                    if body in seen:
                        out.append((k, i + 1 - len(body), len(body)))
                    seen.add(body)
                held = []
            before = h
    return sorted(out)


def test_repeated_chunks(docs_of):
    """Chunks are found, compared byte by byte (with any hash, however poor), and most repeated pairs lie inside them."""
    rng = random.Random(12)
    shared = [[f"shared {i} {j}" for j in range(30)] for i in range(4)]
    rows = []
    for k in range(60):
        body = [f"own {k} {i}" for i in range(rng.randrange(6))]
        for s in rng.sample(shared, rng.randrange(3)):
            body[rng.randrange(len(body) + 1):0] = s
        rows.append((k, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "a\nb\na\nb\na\nb\na\nb"), (105, "line\n" * 20_000)]
    want = plain_chunks(rows)
    for hashed in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5)), lambda c: F.lit(0).cast("long")):
        got = lines.repeated_chunks(docs_of(rows), hashed=hashed)
        assert sorted((r["k"], r["start"], r["n"]) for r in got.collect()) == want
    inside = sum(n - 1 for k, _, n in want if k < 100)
    removed = sum(n for k, _, n, _ in plain_passages(rows) if k < 100)
    assert 0.4 * removed < inside < removed
    got = sorted((r["doc_id"], r["n_lines"], r["removed_lines"], r["text"]) for r in lines.dedup_passages(
        docs_of(rows), hashed=lambda c: F.pmod(F.xxhash64(c), F.lit(5))).collect())
    assert got == plain_passages(rows)


def plain_passages(rows):
    """By (key, position): later occurrences of two neighbouring lines or of a line of 50 words or more go."""
    seen, out = set(), []
    for k, t in sorted(rows):
        if t is None:
            out.append((k, 0, 0, None))
            continue
        parts, gone = t.split("\n"), set()
        for i in range(len(parts)):
            for n in (1, 2):
                run = tuple(parts[i:i + n])
                if len(run) < n or not "".join(run).strip(" \t\n\v\f\r") or n == 1 and len(run[0].split()) < 50:
                    continue
                if run in seen:
                    gone |= set(range(i, i + n))
                seen.add(run)
        out.append((k, len(parts), len(gone), "\n".join(x for i, x in enumerate(parts) if i not in gone)))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_planted_passages_go_whole(spark, docs_of, tmp_path, size):
    """Passages of over 50 words in 1 to 4 lines, anywhere in a text: all lines but the first occurrence's go."""
    rng = random.Random(size)
    planted = [[" ".join(f"p{size}x{i}y{j}w{w}" for w in range(60 // size + 1)) for j in range(size)] for i in range(8)]
    rows, held = [], {}
    for k in range(40):
        own = [f"own {k} {i}" for i in range(rng.randrange(7))]
        at = rng.randrange(len(own) + 1)
        rows.append((k, "\n".join(own[:at] + planted[k % 8] + own[at:])))
        held[k] = own
    rows += [(50, "short\nalone"), (51, "short"), (52, "x\nshort\ny")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert all(got[k]["text"] == "\n".join(held[k]) and got[k]["removed_lines"] == size for k in range(8, 40))
    assert all(got[k]["removed_lines"] == 0 for k in [*range(8), 50, 51, 52])


def test_passages(docs_of):
    rng = random.Random(12)
    shared = [[f"shared {i} {j}" for j in range(9)] for i in range(4)]
    long = " ".join(f"w{i}" for i in range(50))
    rows = []
    for k in range(60):
        body = [f"own {k} {i}" for i in range(rng.randrange(6))]
        for s in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(8)
            body[rng.randrange(len(body) + 1):0] = s[a:a + rng.randrange(1, 5)]
        rows.append((k, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "a\nb\na\nb\na\nb\na\nb"), (105, "line\n" * 20_000),
             (106, long), (107, f" {long}"), (108, f"q\n{long}\nr"), (109, long[:-4]), (110, long[:-4]), (111, "w" * 60_000)]
    got = sorted((r["doc_id"], r["n_lines"], r["removed_lines"], r["text"]) for r in lines.dedup_passages(docs_of(rows)).collect())
    assert got == plain_passages(rows)
    assert {k: n for k, _, n, _ in got if k >= 106} == {106: 0, 107: 0, 108: 1, 109: 0, 110: 0, 111: 0}
    same = [(1, "x y\nz z\nq"), (1, "x y\nz z\nq"), (None, "u\nv")]
    assert {(r["doc_id"], r["removed_lines"]) for r in lines.dedup_passages(docs_of(same)).collect()} == {(1, 0), (None, 0)}
    assert lines.dedup_passages(docs_of(rows).limit(0)).count() == 0
    plan = lines.dedup_passages(docs_of([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --------------------------------------------------------------- pipeline

def test_pipeline(spark, data, tmp_path):
    """Stage by stage against brute force on the smallest tables, with planted rows."""
    import corpus_pipeline as p

    base = spark.read.parquet(f"{data}/documents.parquet")
    junk = spark.createDataFrame([(9001, "123 ... 456", "en", "src0", 11), (9002, None, "en", "src0", 0)], base.schema)
    docs = base.unionByName(junk)
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "language_id":
            assert docs.count() == base.count()
        elif name == "exact_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            _, best = plain_dedup(rows)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(b[2] for b in best.values())
        elif name == "jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = sorted({c for _, _, c in plain_components(rows, 5, 80, 100)})
            assert sorted(r["doc_id"] for r in docs.collect()) == want
        elif name == "mix_sources":
            from test_text_operators import plain_mix
            rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
            taken = {x[0]: x[5] for x in plain_mix(rows)}
            size = {x[0]: x[2] for x in plain_mix(rows)}
            got = {}
            for r in docs.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + size[r["doc_id"]]
            assert {k: v for k, v in taken.items() if v} == got
        else:
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in before.collect())
    again = p.run(spark, data)
    assert again.count() == docs.count() and again.columns == docs.columns
