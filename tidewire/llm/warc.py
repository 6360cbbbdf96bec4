"""WARC archives: a writer and a splittable reader.

A record is one gzip member. Spark's text writer stores the members: it takes raw bytes and ends each with a separator,
and a member's last byte (the high byte of its length) is zero, so that byte is the separator. Output is committed by
task like any table, in any store that Spark writes.

Tasks read byte ranges of the archives: Spark cuts files at any byte and hands each task what lies between one gzip
magic and the next, starting in its range and reading on past its end where needed. A magic may also turn up inside
compressed data. So a candidate is validated by decoding: its member must end and hold a WARC header. A piece that
doesn't end is joined with what follows; where that lies in the next range, the pieces meet in a second, small pass.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._shared import lookup, materialize, new_path, small_batches, table, text_of

MAGIC = b"\x1f\x8b\x08"
#: Equal payloads of this many bytes or more are stored once.
LEAST_REVISIT = 1000
#: The records' date where none is given: pages have none, and archives must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"
#: gzip level of the records.
LEVEL = 6
#: A member ends in a zero byte if what it holds is shorter than this; else an empty member follows it.
ZERO_END = 1 << 24
EMPTY_MEMBER = zlib.compress(b"", 9, 31)

FIELDS = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "record_id"]
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_id", T.StringType())])
PART = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("tail", T.BooleanType()), T.StructField("piece", T.BinaryType())])
ANY = T.StructType([*RECORD.fields, T.StructField("payload", T.BinaryType()), *PART.fields])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record's gzip member. A revisit has no payload; its length stands in a field of its own."""
    kind = "response" if refers_to is None else "revisit"
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + http + b"\r\n\r\n"
    member = zlib.compress(data, LEVEL, 31)
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``.

    Of payloads that agree and have LEAST_REVISIT bytes or more, the row with the largest page_id is the response and
    the others revisit it. Payloads are told apart by SHA-1 and length. A null html is an empty payload, a null page_id
    an empty id (never the largest); rows that repeat the largest page_id are responses too. Very long html is one
    record, whole. Other columns are not read. An empty table makes archives without records.

    Which rows revisit which is found on ids and digests alone; html is joined with it once, on a key that isn't hot.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8")))).withColumn("size", F.octet_length("html"))
    narrow = materialize(rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("page_id", "digest", "size").agg(F.count(F.lit(1)).alias("own")), "warc-digests")
    equal = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("main"), F.sum("own").alias("n"), F.count(F.lit(1)).alias("ids")).filter("ids > 1")
    key = F.struct("digest", "size").alias("payload")
    of = lookup(narrow.select("page_id", "digest", "size", key), materialize(equal.select(key, "main", "n"), "warc-equal"), "payload", "n", narrow.count())
    of = of.filter(F.col("main").isNotNull() & ~F.col("main").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("size").alias("__size"), F.col("main").alias("refers_to"))
    rows = rows.join(materialize(of, "warc-revisits"), F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size")), "left")
    rows = rows.withColumn("digest", F.lower(F.hex("digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([record(p, u, h.encode(), d, r, date)[:-1] for p, u, h, d, r in own], pa.binary())], names=["value"])

    members = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> tuple | None:
    """A record's FIELDS and payload from its decompressed bytes; None if it is no record.

    Foreign records are taken as they are: without a usable length the body ends with the member, ids that don't end in
    a number have no page_id, a digest in hexadecimal counts like one in base 32, and what is missing is null.
    """
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    got = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = _count(got.get("content-length"))
    body = body[:length] if length is not None else body.removesuffix(b"\r\n\r\n")
    payload = body.partition(b"\r\n\r\n")[2] if "application/http" in got.get("content-type", "").lower() else body
    name, kind, url = got.get("warc-record-id"), got.get("warc-type"), got.get("warc-target-uri")
    if kind == "revisit":
        return _number(name), kind, _count(got.get("x-payload-length")), _hex(got.get("warc-payload-digest", "")), _number(got.get("warc-refers-to")), url, name, None
    return _number(name), kind, len(payload), hashlib.sha1(payload).hexdigest(), None, url, name, payload


def _count(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _number(name: str | None) -> int | None:
    """The number that ends a record's id, if it is one of 64 bits."""
    last = (name or "").strip("<>").rpartition(":")[2]
    digits = last.removeprefix("-")
    if not (digits.isascii() and digits.isdigit() and len(digits.lstrip("0")) < 20):
        return None
    number = int(last)
    return number if -(1 << 63) <= number < 1 << 63 else None


def _hex(digest: str) -> str | None:
    """A SHA-1 in base 32 or hexadecimal, as bare lower-case hexadecimal; null if it is neither."""
    kind, _, text = digest.rpartition(":")
    if kind.lower() not in ("", "sha1", "sha-1"):
        return None
    try:
        return bytes.fromhex(text).hex() if len(text) == 40 else base64.b32decode(text.upper()).hex() if len(text) == 32 else None
    except ValueError:
        return None


def members(piece: bytes) -> tuple[list[bytes], bytes | None, bool]:
    """What the gzip members at the start of ``piece`` hold; what is left, if it may go on later; whether it is no member."""
    out = []
    while piece:
        engine = zlib.decompressobj(31)
        try:
            data = engine.decompress(piece)
        except zlib.error:
            return out, None, True
        if not engine.eof:
            return out, piece, False
        out.append(data)
        piece = engine.unused_data
    return out, None, False


def _walk(pieces: Iterator[bytes], first: bool) -> Iterator[tuple[tuple | None, bytes | None, bool]]:
    """(record, None, False) for each record; (None, rest, tail) for what needs another range: heads, then one tail.

    ``first``: the range starts a file, so there is nothing that its first pieces could belong to.
    """
    open_, begun = None, first
    for piece in pieces:
        joined = MAGIC + piece if open_ is None else open_ + MAGIC + piece
        found, rest, broken = members(joined)
        if broken and open_ is not None and not found:  # what was open never ends: start anew here
            found, rest, broken = members(MAGIC + piece)
        records = [r for r in map(parse, found) if r is not None]
        valid = bool(records) or rest is not None and _is_record(rest)
        if not begun and not valid:
            yield None, MAGIC + piece, False  # a head: the end of a member that starts in the range before
            continue
        begun = True
        for r in records:
            yield r, None, False
        open_ = rest
    if open_ is not None:
        yield None, open_, True


def _is_record(start: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(start, 5) == b"WARC/"
    except zlib.error:
        return False


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives at ``path``: FIELDS, and the payload if asked for.

    Files are split at spark.sql.files.maxPartitionBytes. Their names must not end in ``.gz``, as Spark would then
    decompress them as a whole. Bytes between members and members without a WARC header are passed over. Repeated
    records are repeated rows; archives without records give none.
    """
    small_batches(spark)
    raw = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    )
    names = ANY.fieldNames()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition may hold several ranges, one after another, each in the order of its file
        rows, held = [], 0

        def each() -> Iterator[tuple[tuple[str, int], bytes]]:
            for batch in batches:
                for file, block, piece in zip(*(batch.column(c) for c in ("file", "block", "piece")), strict=True):
                    yield (file.as_py(), block.as_py()), piece.as_py()

        source = each()
        ahead = next(source, None)
        while ahead is not None:
            at = ahead[0]

            def own(at=at) -> Iterator[bytes]:
                nonlocal ahead
                skip = at[1] == 0  # what stands before the first magic of a file
                while ahead is not None and ahead[0] == at:
                    piece, ahead = ahead[1], next(source, None)
                    if not skip:
                        yield piece
                    skip = False

            for r, piece, tail in _walk(own(), at[1] == 0):
                rows.append((*(r[:7] if r else [None] * 7), r[7] if r and payload else None, *((None, None, None, None) if r else (*at, tail, piece))))
                held += len(piece or b"") + (len(r[7] or b"") if r and payload else 0)
                if len(rows) >= 2000 or held > 1 << 24:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    read = materialize(raw.mapInArrow(ranges, ANY), "warc-read")
    whole = read.filter(F.col("file").isNull())
    parts = read.filter(F.col("file").isNotNull()).select(*PART.fieldNames())
    # a tail goes on with the heads of the ranges behind it, up to the next tail: one small group for each tail
    follows = F.sum(F.when(F.col("tail"), 1).otherwise(0)).over(_order())

    def stitch(group: pa.Table) -> pa.Table:
        pieces = sorted(zip(group.column("block").to_pylist(), group.column("tail").to_pylist(), range(group.num_rows), group.column("piece").to_pylist(), strict=True))
        found = members(b"".join(p for *_, p in pieces))[0]
        return pa.Table.from_batches([batch_of([(*r[:7], r[7] if payload else None, None, None, None, None) for r in map(parse, found) if r is not None])])

    joined = parts.withColumn("tail_no", follows).groupBy("file", "tail_no").applyInArrow(stitch, ANY)
    columns = [*FIELDS, "payload"] if payload else FIELDS
    return whole.select(*columns).unionByName(joined.select(*columns))


def _order():
    from pyspark.sql.window import Window as W

    # within a range heads (tail false) come before the tail
    return W.partitionBy("file").orderBy("block", "tail").rowsBetween(W.unboundedPreceding, 0)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all ``pages``, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, repeated rows are repeated records, an empty table gives no rows (see write_warc).
    """
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS main FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND main <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND main <> page_id THEN main END AS refers_to
FROM m
"""
