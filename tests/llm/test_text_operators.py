"""BPE, token counts, mixing, language and quality."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindex.llm import bpe, langid, mixing, quality, wordpiece
from spindex.llm.queries import PIECES, WORD_BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD_BPE)


# ------------------------------------------------------------------ 1 BPE

HARD = ["", " ", "Hello, World's  best\tday!\n", "café café Ångström İstanbul",
        "a<|endoftext|>b<|startoftext|> x", "  wide　spaces\x1c\x85", "12345 x9y", "don't I'LL we've 'S'",
        "\U0001f600\U0001f468‍\U0001f469 emoji", "中文字符" * 30, "=" * 999, "ab" * 500, "a" * 777,
        "́́ é", "x" * 64 + "'s" * 70, "loooo" * 40 + "<|endoftext|>" + "ooo" * 90]


def test_encode_equals_the_library(tokenizer):
    tree = bpe.TreeBPE(WORD_BPE, leaf=8)
    for text in HARD:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        packed, shown = tree.encode(text.encode())
        assert np.frombuffer(packed, "<u4").tolist() == ids, text[:40]
        assert shown == tokenizer.decode(ids, skip_special_tokens=False) == tree.decode(packed)


_TREE = {}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abeinortsthé-!.'1中"), min_size=1, max_size=400), st.integers(1, 20))
def test_tree_of_long_runs_equals_the_library(text, leaf):
    from tokenizers import Tokenizer
    lib = _TREE.get("lib") or _TREE.setdefault("lib", Tokenizer.from_file(WORD_BPE))
    tree = _TREE.get("tree") or _TREE.setdefault("tree", bpe.TreeBPE(WORD_BPE))
    tree.leaf = leaf
    assert tree.run(text) == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abteinors AEÉéÀßŒœſŸıİŉ×÷'’.,!?<|>/-#*10²\n\t\u0301\u00a0"), max_size=120))
def test_short_pieces_equal_the_library(text):
    from tokenizers import Tokenizer
    lib = _TREE.get("lib") or _TREE.setdefault("lib", Tokenizer.from_file(WORD_BPE))
    tree = _TREE.get("tree") or _TREE.setdefault("tree", bpe.TreeBPE(WORD_BPE))
    tree.leaf = bpe.LEAF
    ids = lib.encode(text, add_special_tokens=False).ids
    packed, shown = tree.encode(text.encode())
    assert np.frombuffer(packed, "<u4").tolist() == ids and shown == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abteinorsÉéß中'.,!<|>1²\u0301\U0001f600"), max_size=90), max_size=25),
       st.sampled_from([" ", "\n\n", "\u00a0", "<|endoftext|>"]))
def test_tree_of_texts_equals_the_library(words, between):
    from tokenizers import Tokenizer
    lib = _TREE.get("lib") or _TREE.setdefault("lib", Tokenizer.from_file(WORD_BPE))
    small = _TREE.get("small") or _TREE.setdefault("small", bpe.TreeBPE(WORD_BPE, leaf=1))
    text = between.join(words)
    ids = lib.encode(text, add_special_tokens=False).ids
    before = small.joins
    packed, shown = small.encode(text.encode())
    assert np.frombuffer(packed, "<u4").tolist() == ids and shown == lib.decode(ids, skip_special_tokens=False)
    assert small.joins > before or len(text.encode()) <= bpe.STRETCH or not text.strip()


def test_tree_is_reached_by_the_tables(spark, data, tokenizer):
    """Stretches of the given documents are joined, within a task and dealt out."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    tree = bpe.TreeBPE(WORD_BPE)
    for text in texts.values():
        tree.encode(text.encode())
    assert tree.joins > 30 and tree.grown > 10
    assert sum(len(t) >= 10_000 for t in texts.values()) > 1
    for row in bpe.encode(docs, WORD_BPE, deal_out=10_000).collect():
        ids = tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, docs_of, tokenizer):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(9000))
    words = ["".join(rng.choice("abcdeéß中'.1 \t") for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    texts = [*HARD, None, long, "x " + long + "!!" * 3000 + "\n<|endoftext|>" + long, "same", "same",
             " ".join(words), " " * 5000, "\n" * 3000 + "end" + " " * 1500, ("y" * 1023 + " ") * 9, "<|endoftext|> 中" * 900]
    rows = [(i if t != "same" else None, t) for i, t in enumerate(texts)]
    coded = bpe.encode(docs_of(rows), WORD_BPE, leaf=16, deal_out=2000)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in bpe.digests(coded).collect())
    want = []
    for k, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        shown = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((-1 if k is None else k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want)
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded.where("doc_id < 5"), WORD_BPE).collect()}
    assert again[2] == tokenizer.decode(tokenizer.encode(HARD[2], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode(docs_of([(1, "a")]).limit(0), WORD_BPE).collect() == []


# --------------------------------------------------------- 2 token counts

def greedy(word, pieces):
    n = 0
    while word:
        for k in range(len(word), 0, -1):
            if word[:k] in pieces:
                word, n = word[k:], n + 1
                break
        else:
            return 0
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=14), max_size=8))
def test_automaton_equals_greedy(pieces, words):
    automaton = wordpiece.Automaton(pieces)
    for w in words:
        assert automaton.count(w) == greedy(w, pieces)


def test_automaton_equals_the_library():
    from tokenizers.models import WordPiece
    automaton = wordpiece.from_sentencepiece(PIECES)
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = {sp.id_to_piece(i): i for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)}
    model = WordPiece(vocab | {"<unk>": 0}, unk_token="<unk>", max_input_chars_per_word=10 ** 6, continuing_subword_prefix="")
    for word in ["Hello", "thththeaoure", "éèê", "x" * 500, "a中b", "\U0001f9ff", "don't!!!", "ẞༀ"]:
        found = model.tokenize("▁" + word)
        unknown = any(t.value == "<unk>" for t in found)
        assert automaton.count("▁" + word) == (0 if unknown else len(found)), word


def test_token_count_rows(docs_of):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {sp.id_to_piece(i) for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)}
    rows = [(1, "a\nb"), (2, None), (3, ""), (4, "\U0001f9ff ok"), (4, "\U0001f9ff ok"), (None, "x " * 50_000),
            (5, "Unbelievably, the électricité  doesn't\tre-establish straßenbahn" * 3), (6, "z" * 3000 + " \u00a0 q")]
    want = set()
    for key, text in rows:  # a word that can't be cut is one token
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        n = {w: greedy("▁" + w, pieces) for w in set(words)}
        want.add((key, len(words), sum(n[w] or 1 for w in words), sum(n[w] == 0 for w in words)))
    got = {(r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in wordpiece.token_counts(docs_of(rows), PIECES).collect()}
    assert got == want and {(1, 2, 0), (4, 2, 1)} <= {(k, w, u) for k, w, _, u in got}
    assert wordpiece.token_counts(docs_of(rows).limit(0), PIECES).count() == 0


# --------------------------------------------------------------- 5 mixing

def plain_mix(rows, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by filling, decisions by sorting."""
    size = {i: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    budget, free, target = share * sum(total.values()), set(sources), {}
    while free:
        level = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * total[s] + 1e-9}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: float(most * total[s]) for s in over}
        free -= over
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    h = {i: int(md5(f"{'' if k is None else k}:{md5(t or '')}")[:15], 16) for i, (k, t, _) in enumerate(rows)}
    out = []
    for s in sources:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, below = target[s] - whole * total[s], 0
        extra = set()
        for x in sorted({h[i] for i in mine}):
            words = sum(size[i] for i in mine if h[i] == x)
            if below + words > rest:
                if below + words - rest < rest - below:
                    extra |= {i for i in mine if h[i] == x}
                break
            extra |= {i for i in mine if h[i] == x}
            below += words
        else:
            extra = set() if not total[s] else extra
        out += [(rows[i][0], s, size[i], total[s], round(target[s], 6), size[i] * min(2, whole + (i in extra))) for i in mine]
    return sorted(out, key=str)


def test_mix_equals_sorting(docs_of):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 60), f"s{min(rng.randrange(9), 4)}") for i in range(400)]
    rows += [(i, "x " * 40, None) for i in range(400, 420)] + [(7, "w w w", "s0")] * 3 + [(None, None, "empty"), (421, "", "empty")]
    got = sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
                  for r in mixing.mix(docs_of([(a, b, "en", c) for a, b, c in rows])).collect()), key=str)
    assert got == plain_mix(rows)
    by = {}
    for _, s, _, total, target, taken in got:
        by.setdefault(s, [target, 0])[1] += taken
    assert all(abs(t - x) <= 60 for t, x in by.values())


def test_mix_splits_rows_without_a_key(docs_of):
    """Rows of a null or repeated key are decided by their texts: the source comes within one document of its target."""
    rows = [(None if i < 300 else 9, f"word{i} " * (20 + i % 20), "a") for i in range(500)]
    rows += [(1000 + i, f"other{i} " * 30, "b") for i in range(100)]
    docs = docs_of([(a, b, "en", c) for a, b, c in rows])
    plan = mixing.mix(docs)
    got = plan.groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert len(got) == 2 and all(abs(taken - target) <= 40 for _, target, taken in got)
    assert 0 < plan.where("doc_id IS NULL AND copies = 1").count() < 300
    assert mixing.apply(docs, plan).count() == sum(r["copies"] for r in plan.collect())


def test_mix_applied_and_empty(docs_of):
    docs = docs_of([(i, "a b c", "en", "x" if i % 2 else "y") for i in range(40)])
    plan = mixing.mix(docs)
    assert mixing.apply(docs, plan).columns == docs.columns
    assert mixing.apply(docs, plan).count() == sum(r["copies"] for r in plan.collect())
    assert mixing.mix(docs.limit(0)).collect() == []


# ------------------------------------------------------------- 9 language

def test_language(spark, data, docs_of):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_language_edges(docs_of):
    texts = ["the cat sat on the mat", "der hund ist im haus", None, "", "123 !!", "ß", "le " * 60_000]
    rows = [(i, texts[i % len(texts)], ["en", "de", None][i % 3]) for i in range(70)] + [(None, "the", "en")] * 2
    got = langid.identify(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "the" if r["doc_id"] is None else texts[r["doc_id"] % len(texts)]
        letters = bool(text) and any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = docs_of([(i, "abc", None) for i in range(8)])
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(none.limit(0)).count() == 0


def test_foreign_texts_are_rejected(spark, data):
    """Foreign script and random letters go in the pipeline's first stage, even if labelled; all clean documents stay."""
    import corpus_pipeline as p

    rng = random.Random(5)
    base = spark.read.parquet(f"{data}/documents.parquet")
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 10)))
    scripts = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x4F00))),
               "abcdefghijklmnopqrstuvwxyz"]
    planted = [(9000 + i, " ".join(word(scripts[i % 4]) for _ in range([12, 60, 400][i % 3])), ["en", "de", None][i // 4 % 3], "src0", 1)
               for i in range(24)]
    planted += [(9100, "Это обычный русский текст о погоде и природе", "en", "src0", 1), (9101, "今日は天気がいいですね", "fr", "src0", 1)]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema))
    left = p.language_id(spark, docs, data)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in base.collect())
    found = langid.annotate(docs, langid.train(docs)).where("doc_id >= 9000").collect()
    assert all(r["lang_pred"] != "und" and r["lang_score"] >= p.MIN_SCORE for r in found)  # the score alone keeps them


def test_kernel_is_presence_of_distinct_grams():
    got = set(langid.grams(b"AbabA").tolist())
    text = b"ababa"
    want = {text[i] for i in range(5)} | {256 + (text[i] << 8 | text[i + 1]) for i in range(4)} | {
        256 + 65536 + (text[i] << 16 | text[i + 1] << 8 | text[i + 2]) for i in range(3)}
    assert got == want and len(langid.grams(b"")) == 0 and len(langid.grams(b"a")) == 1


def test_scores_are_those_of_the_kernel():
    """Ridge regression on explicit kernel values, with no n-gram matrix."""
    rng = random.Random(8)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(5, 80))).encode()
    texts = [make("abcde ") for _ in range(25)] + [make("defgh ") for _ in range(25)] + [make("hijab ") for _ in range(25)]
    langs = ["x"] * 25 + ["y"] * 25 + ["z"] * 25
    tests = [make("abcdefghij ") for _ in range(20)] + [b"a", b"qqq"]

    def spectrum(t):
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    sets = [spectrum(t) for t in texts]
    marks = [i for n in range(3) for i in range(25 * n, 25 * n + 4)]  # 12 landmarks, the first of each language
    known = set().union(*(sets[i] for i in marks))

    def k(s, z):
        return len(s & z) / np.sqrt(len(s) * len(z))
    kzz = np.array([[k(sets[i], sets[j]) for j in marks] for i in marks])
    kxz = np.array([[k(s, sets[j]) for j in marks] for s in sets])
    # Nystroem features up to a rotation, which ridge regression doesn't see
    low = np.linalg.cholesky(kzz)
    x = np.hstack([np.linalg.solve(low, kxz.T).T, np.ones((len(sets), 1))])
    target = np.array([[1.0 if lang == name else -1.0 for name in "xyz"] for lang in langs])
    penalty = langid.RIDGE * len(sets) / x.shape[1] * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(x.T @ x + penalty, x.T @ target)
    want = [np.append(np.linalg.solve(low, [k(spectrum(t), sets[j]) for j in marks]), 1) @ beta for t in tests]
    model = langid.fit([langid.grams(t) for t in texts], langs, landmarks=12)
    assert len(model.vocab) == len(known)
    assert model.scores([langid.grams(t) for t in tests]) == pytest.approx(np.array(want), abs=1e-4)


# ------------------------------------------------------------- 10 quality

def test_quality(spark, data):
    sf = f"{data}/../sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in found) / len(found)
    assert len(found) > 50 and right >= 0.85


def test_quality_edges(spark, docs_of):
    docs = docs_of([(1, "good text here"), (2, None), (3, ""), (4, "!!" * 50_000), (4, "x"), (None, "y")])
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, text string")
    got = quality.classify(docs, label([(1, 1, "z"), (3, 0, "z"), (4, 0, "z"), (None, 1, "z"), (2, None, "z")])).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in quality.classify(docs, label([(1, 1, "z")])).collect()} == {1.0}
    assert {r["score"] for r in quality.classify(docs, label([])).collect()} == {0.5}
    assert quality.classify(docs.limit(0), label([(1, 1, "z"), (3, 0, "z")])).count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, 448, 449, 512, 513, 5000):
        text = bytes(i % 256 for i in range(n))
        x, w = quality.chunks(text)
        seen = b"".join(bytes(row[:quality.STEP].astype(int).tolist()[:int(k)]) for row, k in zip(x, w)) if n else b""
        assert len(x) == len(w) and w.sum() == max(1, n)
        assert seen[:n] == text[:len(seen)] and (n == 0 or len(seen) >= n - (quality.CHUNK - quality.STEP))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = quality.Net()
    for i, p in enumerate(net.params()):
        assert p.dtype == np.float32
    parts = [quality.chunks(bytes(rng.integers(97, 110, n).astype(np.uint8))) for n in (30, 700)]
    x, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner, y = np.repeat([0, 1], [len(p[1]) for p in parts]), np.array([1.0, 0.0])

    def loss():
        logit = np.bincount(owner, net.logits(x) * w, 2) / np.bincount(owner, w, 2)
        p = 1 / (1 + np.exp(-logit))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, g in zip(net.params(), net.gradients(x, owner, w, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = float(p[at]), 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.2, abs=2e-3)


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    net = quality.Net(seed=4)
    parts = [quality.chunks(bytes(rng.integers(32, 127, n).astype(np.uint8))) for n in (40, 30_000, 900)]
    x, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner, y = np.repeat([0, 1, 2], [len(p[1]) for p in parts]), np.array([1.0, 0.0, 1.0])
    whole = net.gradients(x, owner, w, y)
    monkeypatch.setattr(quality, "BLOCK", 7)
    for a, b in zip(whole, net.gradients(x, owner, w, y)):
        assert a == pytest.approx(b, rel=1e-3, abs=1e-5)


def test_pooled_filters_and_scores_equal_a_plain_loop():
    net = quality.Net(seed=11)
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(32, 127, 1300).astype(np.uint8))
    parts = [text[at:at + quality.CHUNK] for at in range(0, len(text) - (quality.CHUNK - quality.STEP), quality.STEP)]
    logits = []
    for part in parts:
        symbols = list(part) + [quality.PAD] * (quality.CHUNK - len(part))
        pooled = []
        for f in range(quality.FILTERS):
            best = max(sum(float(net.emb[symbols[p + j]] @ net.w[j * quality.DIM:(j + 1) * quality.DIM, f])
                           for j in range(quality.WIDTH))
                       for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE))
            pooled.append(max(0.0, best + float(net.b[f])))
        features = np.array([*pooled, np.log2(len(part) + 1) / 9])
        logits.append(np.maximum(features @ net.u + net.a, 0) @ net.v + net.c[0])
    weight = [quality.STEP] * (len(parts) - 1) + [len(text) - quality.STEP * (len(parts) - 1)]
    want = 1 / (1 + np.exp(-np.average(logits, weights=weight)))
    assert net.score([b"", text])[1] == pytest.approx(want, abs=1e-5)
