"""Chat formatting: round trips, loss mask, parts, odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindex.llm import chat

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[TEXT]", "[/ROLE]", "<\\s>", "[\\\\INST]", "[\\/INST]", "\\", "[", "<", "]",
        ">", "ok", " ", "\n", "é", "𝄞", "INST", "/s>", "s>"]
texts = st.lists(st.sampled_from(BITS), max_size=12).map("".join)
roles = st.sampled_from(["user", "assistant", "system", "tool", "", "a [TEXT] b", "x\ny</s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, texts), min_size=1, max_size=8), st.integers(1, 40))
def test_assembly_reads_back(turns, step):
    chat.STEP, before = step, chat.STEP
    try:
        first = np.array([0, len(turns) // 2]) if len(turns) > 1 else np.array([0])
        formatted, lo, hi = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), first)
    finally:
        chat.STEP = before
    back = [list(chat.turns_of(f)) for f in formatted.to_pylist()]
    assert sum(back, []) == turns
    said = [chat.unescape(f[a:b]) for f, s, e in zip(formatted.to_pylist(), lo.to_pylist(), hi.to_pylist()) for a, b in zip(s, e)]
    assert said == [t for r, t in turns if r == "assistant"]
    for text in (t for _, t in turns):
        escaped = chat.escape(pa.array([text]))[0].as_py()
        assert not chat._MARK.search(escaped) and chat.unescape(escaped) == text


def test_scatter_copies_every_segment():
    rng = np.random.default_rng(1)
    source = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 200)
    length = rng.integers(0, 900, 200) * (rng.random(200) < 0.7)
    want = np.concatenate([source[a:a + n] for a, n in zip(start, length)])
    for step in (1, 64, 700, 10_000, 1 << 20):
        out = np.zeros(len(want), np.uint8)
        chat.scatter(source, start, length, out, step)
        assert (out == want).all()


def expected(rows):
    """conv -> (n_turns, turns digest, loss chars, loss digest) by a plain loop."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        said = "".join(t for r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(),
                     len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("conv", "place", "part", "whole", "formatted", "loss_start"):
        df = df.withColumn(name, F.lit("extra"))
    made = chat.format_chats(df, **kw)
    found = chat.digests(made).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return made, {r["conv_id"]: tuple(r)[1:5] for r in found}, {r["conv_id"]: r["formatted_chars"] for r in found}


@pytest.mark.parametrize("part_bytes", [1, 2000, chat.PART])
def test_conversations_of_all_kinds(spark, part_bytes):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 10 ** 12, -1, None]), rng.choice([None, *range(6)]),
             rng.choice(["user", "assistant", "system", "tool", None, ""]),
             rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(rng.randrange(30)))])) for _ in range(300)]
    rows += [(7, 0, "user", "same")] * 5 + [(8, 0, "assistant", "é𝄞</s>" * 50_000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(400)]  # a hot conversation
    made, found, chars = got(spark, rows, part_bytes=part_bytes)
    assert found == expected(rows)
    total = made.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()
    assert chars == {r["conv_id"]: r["n"] for r in total}
    if part_bytes == 1:
        assert made.where("conv_id = 9").count() > 1
    whole = made.where("whole").groupBy("conv_id").count().where("count > 1")
    assert whole.count() == 0


def test_empty_table_and_settings(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    made, found, _ = got(spark, [])
    assert found == {} and made.count() == 0
    assert spark.conf.get(name) == before


def test_no_control_string_is_left_in_a_text(spark):
    made, _, _ = got(spark, [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")])
    text = "".join(r["formatted"] for r in made.orderBy("place", "part").collect())
    assert text == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST] <\\/s>[\\INST] ok [\\/INST]</s>"
