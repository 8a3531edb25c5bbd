"""Chat formatting by columnar byte assembly.

Turns are dealt by ranges of (conversation, turn) and sorted, so that a
conversation lies in one task as a rule and a very long one in several.  Each
task takes its sorted Arrow batches as columns: the lengths of all segments
(header, role, text, end mark of every turn) form a matrix, whose running sum
gives every segment's place in the output; scatter indices made from both then
copy headers and contents into one preallocated Arrow buffer.  No string is
built per turn.  The loss mask is a list of code point spans, read off the same
running sums: the texts of the assistant, nothing else.

The template, turn after turn (a begin mark ``<s>`` is left to the tokenizer)::

    user        [INST] text [/INST]
    assistant    text</s>
    system      [SYS] text [/SYS]
    any other   [ROLE] role [TEXT] text [/ROLE]

Inside texts and roles each control string gets a backslash behind its first
character (``<s>`` becomes ``<\\s>``, ``<\\s>`` becomes ``<\\\\s>``), so that none
is left and the way back is exact; other text is unchanged.

Output of :func:`format_chats`: one row per conversation, or per *part* of
``PART`` bytes or more of a long one; ``place, part`` order a conversation's
parts, ``whole`` says that the row surely is its only one.

Null texts and roles count as empty.  Turns of equal number are ordered by
role, then by text; null turns come first.  Repeated rows are turns of their
own.  Rows with a null conversation id form one conversation.  Empty tables
give empty results; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, freeing, partitions, stored

#: header and end of a turn by role; the last pair is for any other role
ROLES = ("user", "assistant", "system")
HEADS = ("[INST] ", " ", "[SYS] ", "[ROLE] ")
TAILS = (" [/INST]", "</s>", " [/SYS]", " [/ROLE]")
MID = " [TEXT] "

_CONTROL = r"(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:INST|SYS|ROLE|TEXT)\])"
_ESCAPED = re.compile(r"(<\\*)\\(/?s>)|(\[\\*)\\(/?(?:INST|SYS|ROLE|TEXT)\])")
_MARK = re.compile(r"</s>|\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]")

#: A conversation's rows are cut into parts at turns once they have this many bytes.
PART = 32 << 20
#: Bytes that are scattered in one step (their indices take eight times as much).
STEP = 1 << 20


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, _CONTROL, r"\1\4\2\5\\\3\6")


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), s) if "\\" in s else s


def scatter(source: np.ndarray, start: np.ndarray, length: np.ndarray, out: np.ndarray, step: int = STEP) -> None:
    """Copies ``source[start[i]:start[i] + length[i]]``, one after the other, into ``out``."""
    place = np.concatenate([[0], np.cumsum(length)])
    i, n = 0, len(length)
    while i < n:
        j = int(np.searchsorted(place, place[i] + step, side="right")) - 1
        if j <= i:  # a long segment
            out[place[i]:place[i + 1]] = source[start[i]:start[i] + length[i]]
            i += 1
            continue
        index = np.repeat(start[i:j] - place[i:j], length[i:j]) + np.arange(place[i], place[j])
        out[place[i]:place[j]] = source[index]
        i = j


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and byte lengths of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


_CONST = (*HEADS, MID, *TAILS)
_CONST_BYTES = np.frombuffer("".join(_CONST).encode(), np.uint8)
_CONST_LEN = np.array([len(c) for c in _CONST])
_CONST_AT = np.concatenate([[0], np.cumsum(_CONST_LEN)[:-1]])


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
    """Formats turns.  ``first`` holds the rows at which a conversation (or
    part) starts.  Returns the formatted strings and the starts and ends of
    their loss spans."""
    n = len(text)
    kind = pc.fill_null(pc.index_in(role, value_set=pa.array(ROLES)), len(ROLES)).to_numpy(zero_copy_only=False).astype(np.int64)
    other = kind == len(ROLES)
    named = pc.if_else(pa.array(other), role, "")
    texts, roles = escape(text), escape(named)
    (tdata, tat, tlen), (rdata, rat, rlen) = _bytes(texts), _bytes(roles)
    source = np.concatenate([_CONST_BYTES, rdata, tdata])

    def const(which: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _CONST_AT[which], np.where(used, _CONST_LEN[which], 0)

    always = np.ones(n, bool)
    columns = [const(kind, always), (rat + len(_CONST_BYTES), rlen), const(np.full(n, len(HEADS)), other),
               (tat + len(_CONST_BYTES) + len(rdata), tlen), const(1 + len(HEADS) + kind, always)]
    start = np.stack([c[0] for c in columns], 1).ravel()
    length = np.stack([c[1] for c in columns], 1)
    ends = np.cumsum(length.sum(1))
    buffer = pa.allocate_buffer(int(ends[-1]))
    scatter(source, start, length.ravel(), np.frombuffer(buffer, np.uint8))
    bounds = np.append(first, n)
    offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
    # the same running sum over code points gives the spans of the mask
    chars = length.copy()
    chars[:, 1] = pc.utf8_length(roles).to_numpy(zero_copy_only=False)
    chars[:, 3] = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    char_end = np.cumsum(chars.ravel()).reshape(n, -1)
    zero = np.concatenate([[0], char_end[:, -1]])[first]  # where each output string starts
    own = np.repeat(zero, np.diff(bounds))
    loss = kind == 1
    spans = np.concatenate([[0], np.cumsum(loss)])[bounds].astype(np.int32)
    lists = lambda v: pa.ListArray.from_arrays(pa.array(spans), pa.array(v))
    return formatted, lists((char_end[:, 2] - own)[loss]), lists((char_end[:, 3] - own)[loss])


def _changes(key: pa.Array) -> np.ndarray:
    """Rows at which the key differs from the row before; the first is one."""
    if len(key) < 2:
        return np.arange(len(key))
    a, b = key.slice(0, len(key) - 1), key.slice(1)
    differs = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
    return np.append(0, 1 + np.flatnonzero(differs.to_numpy(zero_copy_only=False)))


def _formatter(conv: str, part_bytes: int):
    def each(batches):
        place = TaskContext.get().partitionId()
        pending: pa.Table | None = None   # rows of the conversation that is still open
        part, opened = 0, True            # its parts so far; it may have begun in the task before

        def out(table: pa.Table, final: bool):
            nonlocal part, opened
            batch = table.combine_chunks().to_batches()[0]
            first = _changes(batch.column(0))
            formatted, lo, hi = assemble(batch.column("role"), batch.column("text"), first)
            parts = np.zeros(len(first), np.int32)
            parts[0] = part
            whole = np.ones(len(first), bool)
            whole[0] = part == 0 and not opened
            whole[-1] &= final
            part, opened = 0, False
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(first)), pa.array(np.full(len(first), place, np.int32)), pa.array(parts),
                 pa.array(whole), formatted, lo, hi], names=[conv, "place", "part", "whole", "formatted", "loss_start", "loss_end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if pending is None else pa.concat_tables([pending, table])
            last = int(_changes(table.column(0).combine_chunks())[-1])
            if last:  # all but the last conversation are complete
                done, table = table.slice(0, last), table.slice(last)
                yield out(done, True)
            if table.nbytes >= part_bytes:
                now = part
                yield out(table, False)
                part, opened, pending = now + 1, True, table.slice(0, 0)
            else:
                pending = table
        if pending is not None and pending.num_rows:
            yield out(pending, False)  # it may go on in the next task
    return each


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 part_bytes: int = PART) -> DataFrame:
    """``conv, place, part, whole, formatted, loss_start, loss_end``, written once."""
    spark = turns.sparkSession
    rows = turns.select(F.col(conv), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.toDF("conv", "turn", "role", "text")
    ordered = (rows.repartitionByRange(partitions(spark), "conv", "turn")
               .sortWithinPartitions("conv", "turn", "role", "text").drop("turn"))
    kind = turns.schema[conv].dataType.simpleString()
    made = ordered.mapInArrow(freeing(_formatter(conv, part_bytes)),
                              f"`{conv}` {kind}, place int, part int, whole boolean, formatted string, "
                              "loss_start array<long>, loss_end array<long>")
    with bounded_batches(spark, 1024):
        return stored(made, "chats", codec="zstd")


def turns_of(formatted: str):
    """The turns ``(role, text)`` of a formatted part."""
    at = 0
    while at < len(formatted):
        mark = _MARK.search(formatted, at)
        if mark.start() > at or mark[0] == TAILS[1]:  # no header: the assistant's
            yield ROLES[1], unescape(formatted[at + 1:mark.start()])
            at = mark.end()
            continue
        name, at = mark[0], mark.end() + 1
        who = {"[INST]": "user", "[SYS]": "system"}.get(name)
        if who is None:
            mark = _MARK.search(formatted, at)
            who, at = unescape(formatted[at:mark.start() - 1]), mark.end() + 1
        mark = _MARK.search(formatted, at)
        yield who, unescape(formatted[at:mark.start() - 1])
        at = mark.end()


def _digester(conv: str):
    """Digests of conversations from their parts, which come in order; only
    the running digests of one conversation are held."""
    def each(batches):
        names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None
        for batch in batches:
            cols = {k: [] for k in names}

            def close(now, cols):
                for k, v in zip(names, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])):
                    cols[k].append(v)

            for i, key in enumerate(batch.column(0).to_pylist()):
                if now is None or now[0] != key:
                    if now is not None:
                        close(now, cols)
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = batch.column("formatted")[i].as_py()
                for who, what in turns_of(formatted):
                    now[1] += 1
                    now[2].update(f"{who}\n{what}\n".encode())
                for lo, hi in zip(batch.column("loss_start")[i].as_py(), batch.column("loss_end")[i].as_py()):
                    said = unescape(formatted[lo:hi])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(formatted)
            if cols[conv]:
                yield _digests(cols, batch.schema.field(0).type)
        if now is not None:
            cols = {k: [] for k in names}
            close(now, cols)
            yield _digests(cols, batch.schema.field(0).type)
    return each


def _digests(cols: dict, key_type: pa.DataType) -> pa.RecordBatch:
    kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back, per conversation: ``conv, n_turns,
    turns_sha256`` (role, newline, text, newline per turn), ``loss_chars,
    loss_sha256`` (the unescaped text under the mask), ``formatted_chars``.
    Rows that are whole conversations stay where they are; only the parts of
    others are brought together, in order, and pass through a running digest."""
    spark = chats.sparkSession
    kind = chats.schema[conv].dataType.simpleString()
    schema = (f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    cols = [conv, "formatted", "loss_start", "loss_end"]
    read = lambda df: df.select(*cols).mapInArrow(freeing(_digester(conv)), schema)
    cut = chats.where("NOT whole").repartition(conv).sortWithinPartitions(conv, "place", "part")
    with bounded_batches(spark, 256):
        return stored(read(chats.where("whole")).unionByName(read(cut)), "chat_digests")
