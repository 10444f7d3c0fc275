"""WARC archives: records written by Spark's text sink, read back by a salvage reader.

Writing.  A record is its header, an empty line, its block and two line ends.
The text sink with those line ends as its separator writes just that, on any
file system Spark knows, with Spark's commit of whole tasks.

With one gzip member per record the records are packed in the tasks, before
they are shuffled.  The sink writes a member but for its last byte, which is
the top byte of a length below 16 MiB and so the zero that serves as separator.

Reading.  Files are read whole, as they are written in bounded sizes, plain or
as gzip members.  A record counts only if its version line, header, length,
line ends and digests hold.  After a failed check the reader searches for the
next place where all of them hold again, goes on there, and logs the bytes in
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import long_id

VERSION = b"WARC/1.1\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields that a record may repeat.
_REPEATED = {"warc-concurrent-to"}
#: Bytes of payload per archive file.
FILE_BYTES = 16 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hex string."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    return F.concat(*[F.substring(alphabet, F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)])


def header(fields: dict[str, Column]) -> Column:
    """Version line and the fields that are not null, as text."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in fields.items()]
    return F.concat(F.lit(VERSION.decode()), F.concat_ws("", *lines), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = FILE_BYTES,
                   compression: str = "none") -> None:
    """Write one record per row of ``pages`` below ``path``.

    Of rows with equal payloads of at least ``least`` bytes that with the
    largest id is the response, the others are revisits that refer to it; of
    rows that repeat that id with that payload all are responses.  A null
    payload is empty, a null url is left out of the header, rows with a null id
    are responses, as nothing can refer to them.  With ``compression="records"``
    every record is a gzip member, as archives prescribe; with ``"gzip"`` a file
    is one gzip member of many records.
    """
    body = F.coalesce(pages[f"`{html}`"].cast("string"), F.lit(""))
    rows = pages.select(long_id(pages, page_id).alias("id"), pages[f"`{url}`"].cast("string").alias("url"), body.alias("body"))
    facts = rows.select("id", F.sha1("body").alias("sha1"), F.octet_length("body").cast("bigint").alias("size"))
    winners = facts.where(f"id is not null and size >= {int(least)}").groupBy("sha1", "size").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    volume = winners.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    files = max(1, -(-volume // file_bytes), pages.sparkSession.sparkContext.defaultParallelism)
    # narrow rows only: which ids revisit which; an id that repeats may do both
    referring = facts.join(winners.where("n > 1").select("sha1", "size", "first"), ["sha1", "size"]).where("id < first").select("id", "sha1", "first").distinct()
    name = lambda c: F.concat(F.lit("<urn:barloom:page:"), c.cast("string"), F.lit(">"))

    def record(size, first=None):
        """The record of a row: a response, or a revisit that refers to ``first``."""
        kind, block = ("response", F.concat(F.lit(_HTTP.decode()), F.col("body"))) if first is None else ("revisit", F.lit(_HTTP.decode()))
        revisit = {} if first is None else {"WARC-Refers-To": name(first), "WARC-Profile": F.lit(_PROFILE)}
        return F.concat(header({
            "WARC-Type": F.lit(kind),
            "WARC-Record-ID": F.coalesce(name(F.col("id")), F.lit("<urn:barloom:page:>")),
            # an url is one line, whatever the table holds
            "WARC-Target-URI": F.regexp_replace("url", r"\s+", "%20"),
            "WARC-Date": F.lit("1970-01-01T00:00:00Z"),
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32(F.col("sha1"))),
            "WARC-Block-Digest": F.concat(F.lit("sha1:"), base32(F.sha1(block))),
            **revisit,
            "X-Payload-Length": size.cast("string"),
            "Content-Type": F.lit("application/http;msgtype=response"),
            "Content-Length": F.octet_length(block).cast("string"),
        }), block)

    placed, size = rows.withColumn("sha1", F.sha1("body")), F.octet_length("body")
    if compression == "records":
        placed = placed.select("id", "sha1", "url", size.alias("size"), record(size).alias("record")).mapInArrow(_pack, "id bigint, sha1 string, url string, size int, packed binary")
    told = placed.repartition(int(files), "id", "sha1").join(referring.repartition(int(files), "id", "sha1"), ["id", "sha1"], "left")
    first = F.col("first")
    if compression == "records":
        packed = told.select("packed", F.when(first.isNotNull(), record(F.col("size"), first)).alias("record")).mapInArrow(_repack, "packed binary")
        packed.select(F.col("packed").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
        return
    value = F.when(first.isNull(), record(size)).otherwise(record(size, first))
    told.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def member(record: bytes) -> bytes:
    """A record and its line ends as gzip, but for the last byte, which is zero."""
    data = gzip.compress(record + b"\r\n\r\n", 6, mtime=0)
    # of a record of 16 MiB or more the length ends otherwise: an empty member follows
    return (data + gzip.compress(b"", mtime=0) if data[-1] else data)[:-1]


def _pack(batches):
    for batch in batches:
        # ids, digests and urls go on beside the packed record
        packed = [member(r.as_buffer().to_pybytes()) for r in batch.column("record")]
        names = ["id", "sha1", "url", "size"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(packed, pa.binary())], names=[*names, "packed"])


def _repack(batches):
    for batch in batches:
        packed = [p.as_py() if not r.is_valid else member(r.as_buffer().to_pybytes()) for p, r in zip(batch.column("packed"), batch.column("record"))]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["packed"])


class BadRecord(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the plain record at ``at``, with every check made."""
    version = _VERSION.match(data, at)
    if not version:
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise BadRecord("header without end")
    # a record that was cut off inside its header is followed by the next one
    if _VERSION.search(data, version.end(), end + 2):
        raise BadRecord("version line inside a header")
    fields: dict[str, str] = {}
    for line in data[version.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if line and not colon:
            raise BadRecord("header line without colon")
        if b"\r" in line or b"\n" in line:
            raise BadRecord("header line with a broken end")
        name = key.decode("latin-1").strip().lower()
        if name in fields and name not in _REPEATED:
            raise BadRecord(f"{name} given twice")
        fields[name] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
        raise BadRecord("header without length, type or id")
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("block without end")
    block = data[start:stop]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", payload_of(fields, block))):
        kind, _, said = fields.get(name, "").partition(":")
        if kind.lower() == "sha1" and part is not None and said.upper() != sha1_base32(part):
            raise BadRecord(f"{name} differs")
    return fields, block, stop + 4


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """Payload of a record; None if the record does not carry it."""
    if fields.get("warc-type") == "revisit":
        return None
    if fields.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        if head < 0:
            raise BadRecord("no http header")
        return block[head + 4 :]
    return block


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, its end, and why it breaks off, if it does."""
    inflate, parts, end, step = zlib.decompressobj(31), [], at, 1 << 16
    try:
        while end < len(data) and not inflate.eof:
            parts.append(inflate.decompress(data[end : end + step]))
            end = min(end + step, len(data))
    except zlib.error as e:
        return b"".join(parts), at, f"member: {e}"
    if not inflate.eof:
        return b"".join(parts), at, "member without end"
    return b"".join(parts), end - len(inflate.unused_data), ""


def _items_at(data: bytes, at: int) -> tuple[list[tuple[str, dict[str, str], bytes]], int, str]:
    """Records and gaps of the member at ``at``, or the plain record there, the end, and why it breaks off.

    A member is salvaged like a file: a bad record inside it, or a damaged rest,
    costs none of the records before or behind it that can be read.
    """
    if data[at : at + 3] != _MEMBER:
        fields, block, end = parse_record(data, at)
        return [("record", fields, block)], end, ""
    plain, end, broken = _member(data, at)
    found = [(kind, fields, block) for kind, _, _, fields, block in salvage(plain)]
    if broken:
        # the cut-off last record is part of the gap that the file gets
        found = [x for x in found if x[0] == "record"]
        if not found:
            raise BadRecord(broken)
    return found, end, broken


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """``("record", offset, length, header, block)`` and ``("gap", offset, length, {"reason": ...}, b"")`` in order.

    Plain records, members and gaps cover the file without overlap; all records
    of a member, and gaps inside it, have the member's offset and length.  The
    records before the damage in a member have the length 0, what follows it is
    a gap from the member's start on.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        found, broken = [], ""
        try:
            found, end, broken = _items_at(data, at)
        except BadRecord as e:
            broken = str(e)
        if found and gap is not None:
            yield "gap", gap, at - gap, {"reason": why}, b""
            gap = None
        for kind, fields, block in found:
            yield kind, at, 0 if broken else end - at, fields, block
        if broken:
            if gap is None:
                gap, why = at, broken
            version, member = _VERSION.search(data, at + 1), data.find(_MEMBER, at + 1)
            at = min(version.start() if version else len(data), member if member >= 0 else len(data))
        else:
            at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, {"reason": why}, b""


def read_archives(spark: SparkSession, path: str, *, blocks: bool = True, pattern: str = "*") -> DataFrame:
    """``(kind, file, offset, length, reason, type, record_id, refers_to, digest, payload_bytes[, payload])``.

    ``kind`` is "record" or "gap".  Digest and length of a response are those
    of the payload read, which the reader has held against the header; a
    revisit has those its header gives.  A file of no bytes gives no rows.  All
    files below ``path`` whose names fit ``pattern`` are read, but those that
    Spark takes as hidden (a leading "_" or ".").
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["kind", "file", "offset", "length", "reason", "type", "record_id", "refers_to", "digest", "payload_bytes"] + ["payload"] * blocks

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, held = [], 0
                for kind, at, n, fields, block in salvage(content.as_py()):
                    if kind == "gap":
                        row = (kind, file, at, n, fields["reason"], None, None, None, None, None)
                        body = None
                    else:
                        body = payload_of(fields, block)
                        said = fields.get("x-payload-length", "")
                        size = len(body) if body is not None else int(said) if said.isdigit() else None
                        digest = sha1_base32(body) if body is not None else fields.get("warc-payload-digest", "").partition(":")[2] or None
                        row = (kind, file, at, n, None, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), digest, size)
                    out.append((*row, body) if blocks else row)
                    held += len(body or b"") if blocks else 0
                    if len(out) >= 4096 or held >= 8 << 20:
                        yield _batch(out, names)
                        out, held = [], 0
                if out:
                    yield _batch(out, names)

    return files.mapInArrow(run, "kind string, file string, offset bigint, length bigint, reason string, type string, record_id string, refers_to string, digest string, payload_bytes bigint" + ", payload binary" * blocks)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)


def page_of(record_id: Column) -> Column:
    """The page id in a record's name; null if it has none."""
    return F.nullif(F.regexp_extract(record_id, r"page:(-?\d*)>", 1), F.lit("")).cast("bigint")
