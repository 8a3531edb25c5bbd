"""WARC archives: writing, and reading back with segment reassembly.

Writing: one record per row.  Of rows with equal payloads, the one with the
largest page id is written as ``response`` (its HTTP body in chunked transfer
framing) and the others as ``revisit`` records that refer to it and carry no
payload.  A block longer than ``segment`` bytes is split into a first record
and ``continuation`` records.  The files are gzip text files whose line
separator is the blank line between records, written by Spark.

Reading: Spark splits the files at record starts; a record that a payload
holding such a start cut apart is put together again by its Content-Length.
Segments are grouped by their origin's id, ordered by number and concatenated;
the total length is verified, the chunked framing is decoded, and length and
SHA-1 of the payload are compared with the header.  A record that fails comes
back with ``intact`` false.

Null html is an empty payload.  Rows that repeat page id and payload: one is
the response, the others revisit it.  A null page id ranks below all others.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, shared_path, small_batches, stored

VERSION = b"WARC/1.1\r\n"
BETWEEN = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, sha1: bytes, copy: int) -> str:
    x = f"{(page_id or 0) & (2 ** 64 - 1):016x}{sha1.hex()[:11]}{int(page_id is None)}{copy & 0xffff:04x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def page_of(rid: str) -> int | None:
    x = rid[len("<urn:uuid:"):-1].replace("-", "")
    n = int(x[:16], 16)
    return None if x[27] == "1" else n - 2 ** 64 if n >= 2 ** 63 else n


def chunk(payload: bytes, size: int) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk length")
        out.append(body[at:at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(page_id, url, payload: bytes, sha1: bytes, copy: int, refers_to: str | None, size: int,
            segment: int, chunk_size: int) -> list[bytes]:
    """The records of one row."""
    rid = record_id(page_id, sha1, copy)
    uri = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", page_id)]
    payload_fields = [("WARC-Payload-Digest", "sha1:" + base32(sha1)), ("X-Payload-Length", size)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Profile", PROFILE),
                         ("WARC-Refers-To", refers_to), *payload_fields, *kind], http)]
    block = http + chunk(payload, chunk_size)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, *payload_fields, *kind]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = f"{rid[:-5]}{n & 0xffff:04x}>" if n < 0x10000 else f"{rid[:-1]}-{n:x}>"
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
                            ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n),
                            ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          segment: int = 32 << 10, chunk_size: int = 8 << 10, min_bytes: int = 0) -> None:
    """Writes the archives of ``pages`` below ``path``.  Payloads of fewer than
    ``min_bytes`` bytes are always responses."""
    small_batches(pages.sparkSession, 512)
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    # roles from ids and digests alone; the payloads move once, by (unique) page id
    base = stored(rows.groupBy("page", "sha1").agg(F.count(F.lit(1)).alias("copies"),
                                                   F.max(F.octet_length("payload")).alias("size")), "digests")
    # only the wrapped max: a null page id sorts below the others
    best = base.groupBy("sha1").agg(F.max(F.struct("page")).alias("keep"), F.sum("copies").alias("n"))
    roles = base.where(F.col("size") >= min_bytes).join(best.where("n > 1"), "sha1").select(
        "page", "sha1", "copies", F.col("keep.page").alias("keep"))
    # one shuffle of the payloads: by the columns that the numbering needs, too
    split = lambda df: df.withColumn("p", F.coalesce("page", F.lit(0).cast("long"))).withColumn("none", F.col("page").isNull())
    joined = split(rows).join(split(roles).drop("page"), ["p", "none", "sha1"], "left").withColumn(
        "grouped", F.col("copies").isNotNull())
    # rows that repeat page id and payload are numbered; there is nothing else to tell them apart
    numbered = joined.withColumn("copy", F.row_number().over(Window.partitionBy("p", "none", "sha1").orderBy("url")))

    def build(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                response = not r["grouped"] or (r["page"] == r["keep"] and r["copy"] == 1)
                refers = None if response else record_id(r["keep"], r["sha1"], 1)
                out += records(r["page"], r["url"], r["payload"], r["sha1"], r["copy"], refers, len(r["payload"]),
                               segment, chunk_size)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (numbered.select("page", "url", "payload", "sha1", "keep", "grouped", "copy").mapInArrow(freeing(build), "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", BETWEEN).option("compression", "gzip").text(path))


def _whole(batches):
    """Records in file order.  Content-Length decides where a record ends: one
    that a payload's own record start cut apart is joined again, and records
    that the line reader left in one piece (it may miss a separator at the end
    of its buffer) are cut."""
    lost = BETWEEN.encode() + VERSION
    held: bytes | None = None
    for batch in batches:
        for piece in batch.column("value").to_pylist():
            data = piece.removeprefix(VERSION) if held is None else held + lost + piece
            held = None
            while True:
                head, _, block = data.partition(b"\r\n\r\n")
                fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n"))}
                length = int(fields["content-length"])
                if len(block) < length:
                    held = data
                    break
                yield fields, block[:length]
                if not block.startswith(lost, length):
                    break
                data = block[length + len(lost):]


_PARSED = ("id string, type string, page long, refers string, digest string, size long, origin string, "
           "number int, total long, block binary")


def _parse(batches):
    out = []
    held = 0
    schema = pa.schema([("id", pa.string()), ("type", pa.string()), ("page", pa.int64()), ("refers", pa.string()),
                        ("digest", pa.string()), ("size", pa.int64()), ("origin", pa.string()), ("number", pa.int32()),
                        ("total", pa.int64()), ("block", pa.binary())])
    number = lambda x: None if x is None else int(x)
    for f, block in _whole(batches):
        got = f.get
        out.append((got("warc-record-id"), got("warc-type"), number(got("x-page-id")), got("warc-refers-to"),
                    (got("warc-payload-digest") or "")[5:] or None, number(got("x-payload-length")),
                    got("warc-segment-origin-id"), number(got("warc-segment-number")),
                    number(got("warc-segment-total-length")), block))
        held += len(block)
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _payload(batches):
    """Decodes whole blocks; ``blocks`` are a record's segments in order."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            block = b"".join(r["blocks"])
            payload, intact = None, r["complete"]
            if r["type"] == "revisit":
                size, digest = r["size"], r["digest"]
            else:
                try:
                    payload = unchunk(block.partition(b"\r\n\r\n")[2])
                    size, digest = len(payload), base32(hashlib.sha1(payload).digest())
                    intact = intact and (size, digest) == (r["size"], r["digest"])
                except ValueError:
                    size, digest, intact = r["size"], r["digest"], False
            out.append((r["page"], size, digest, r["type"], None if r["refers"] is None else page_of(r["refers"]),
                        intact, payload))
        cols = list(zip(*out)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per response or revisit record: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, intact, payload`` (null for revisits)."""
    small_batches(spark, 512)
    raw = spark.read.option("lineSep", BETWEEN + VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    # read once: whole records go on as they are, segments are grouped
    parsed = stored(raw.mapInArrow(freeing(_parse), _PARSED), "records", "zstd")
    plain = parsed.where("number IS NULL").select("type", "page", "refers", "digest", "size",
                                                  F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    parts = parsed.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "id"))
    whole = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("s"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page", "refers", "digest", "size")])
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.octet_length(b))
    numbers = F.transform("s", lambda x: x["number"])
    whole = whole.select("type", "page", "refers", "digest", "size", "total", numbers.alias("numbers"),
                         F.transform("s", lambda x: x["block"]).alias("blocks"))
    whole = whole.where("type IS NOT NULL").select("type", "page", "refers", "digest", "size", "blocks", F.coalesce(
        (F.col("numbers") == F.sequence(F.lit(1), F.size("numbers"))) & (length == F.col("total")), F.lit(False)).alias("complete"))
    return plain.unionByName(whole).mapInArrow(freeing(_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                  "intact boolean, payload binary")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` as archives and reads them back."""
    path = path or shared_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
