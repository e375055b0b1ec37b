"""WARC archives of pages: a writer that stores equal payloads once, and a reader that salvages what damage leaves.

Archives are gzip members, one for each record, written by Spark's text sink: every member ends in a zero byte (the high
byte of its length), which is the sink's line separator. So they are committed as any table is, on any file system."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, _hadoop, durable, for_python, lookup, shared_dir, slices, table
from .exact_dedup import key_filter, maybe_repeated

#: Names of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records (a parameter: the tables have none), and records in one archive file at most.
DATE, RECORDS = "2024-01-01T00:00:00Z", 20_000
#: Prefix of record ids; the id follows, percent-encoded.
URN = "urn:page:"
_MAGIC, _LINE = b"\x1f\x8b\x08", b"WARC/1."
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str) -> str:
    """Text fit for a header: what is not printable ASCII is percent-encoded."""
    return quote(text, safe="".join(chr(c) for c in range(33, 127)))


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record; fields without value are left out."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero; from 16 MB on, where that byte of the length isn't, an empty member follows."""
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    found = packed.compress(data) + packed.flush()
    return found if found[-1] == 0 else found + member(b"", level)


def _page(id_: object, url: str | None, payload: bytes | None, payload_digest: str, size: int, refers: object, refers_url: str | None) -> bytes:
    """The record of one page: a response, or a revisit (without payload) of the record `refers`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda x: f"<{URN}{quote(str(x), safe='') if x is not None else ''}>"
    target = lambda x: _header_value(x) if x else None
    fields = {"WARC-Record-ID": name(id_), "WARC-Target-URI": target(url), "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{payload_digest}"}
    if payload is not None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers), "WARC-Refers-To-Target-URI": target(refers_url)}, http)


def _members(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
    first = [member(info, level)]
    for batch in slices(batches):
        out = first
        first = []
        for r in batch.to_pylist():
            payload = None if r["revisit"] else (r["html"] or "").encode()
            sha = base64.b32encode(r["h"]).decode()
            out.append(member(_page(r["id"], r["url"], payload, sha, r["size"], r["refers"], r["refers_url"]), level))
        yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["value"])


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 6) -> None:
    """Writes one record for each row of `pages` into archives in `folder`, which must not exist.

    The payload is the text in UTF-8; a null one is empty. Of rows with equal payloads of at least `min_bytes` bytes that
    with the largest id (then url) is the response, the others are revisits that refer to it; other rows are responses.
    Rows that repeat id, url and payload are revisits but for one. Rows without id are responses of their own, as nothing
    could refer to them. Characters of a url that a header can't hold are percent-encoded; a null or empty url is left
    out. An empty table makes a folder without archives. Only the three columns are read.

    Payloads meet by digest: 28 bytes a row are counted (a partial sum in each task). Only digests that occur twice set
    bits of a Bloom filter, and rows that it clears go straight to the archives. Of the others one payload for each task
    and digest is shuffled to find the response; revisits need no payload, only the id of their response."""
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("html")]
    rows = pages.select(*cols).withColumns({"h": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html").cast("long")})
    able = F.col("id").isNotNull() & (F.col("size") >= min_bytes)
    repeated = durable(rows.where(able).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("h").alias("h")))
    marked = maybe_repeated(rows.withColumn("_h", F.when(able, F.xxhash64("h"))), "_maybe", key_filter(repeated)).withColumn("_maybe", F.coalesce("_maybe", F.lit(False)) & able)
    alone, maybe = marked.where("NOT _maybe"), marked.where("_maybe")
    responses = maybe.groupBy("h").agg(F.max(F.struct("id", "url", "html", "size")).alias("r"), F.count("*").alias("n")).select("r.id", "r.url", "r.html", "h", "r.size", "n")
    narrow = maybe.select("id", "url", "h", "size")
    tops = durable(narrow.groupBy("h").agg(F.max(F.struct("id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1"))
    floor = max(1000, int(tops.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    known = lookup(narrow, tops, "h", F.col("n") >= floor).withColumn("own", F.struct("id", "url") == F.col("top"))
    # Of rows that are the response, all but one are copies of it.
    copies = known.where("own").groupBy("id", "url", "h", "size").agg(F.count("*").alias("n")).where("n > 1").withColumn("_", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    none = F.lit(None)
    as_response = [F.col(c) for c in ("id", "url", "html", "h", "size")] + [F.lit(False).alias("revisit"), none.cast("string").alias("refers"), none.cast("string").alias("refers_url")]
    as_revisit = lambda refers, url: [F.col("id"), F.col("url"), none.cast("string").alias("html"), "h", "size", F.lit(True).alias("revisit"), refers.cast("string").alias("refers"), url.alias("refers_url")]
    out = alone.select(*as_response).unionByName(responses.select(*as_response))
    out = out.unionByName(known.where("NOT own").select(*as_revisit(F.col("top.id"), F.col("top.url")))).unionByName(copies.select(*as_revisit(F.col("id"), F.col("url"))))
    members = for_python(out.withColumn("id", F.col("id").cast("string"))).mapInArrow(lambda x: _members(x, level), "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS).text(folder)


class Damaged(ValueError):
    """A check has failed."""


@dataclass
class Record:
    """A record between two places of an archive; `block` is what follows its headers."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    def payload(self) -> bytes:
        """The block without the headers of its protocol."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    """Bytes that no record could be read from, and the check that failed at their start."""

    start: int
    end: int
    reason: str


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at a place, and where it ends; its checksum and length are checked."""
    packed, out, place = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not packed.eof:
            if place >= len(data):
                raise Damaged("member cut short")
            out.append(packed.decompress(view[place : place + (1 << 18)]))
            place += 1 << 18
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return b"".join(out), min(place, len(data)) - len(packed.unused_data)


def _declared(headers: dict[str, str], name: str, data: bytes) -> None:
    kind, _, value = headers.get(name, "").partition(":")
    if kind.lower() == "sha1" and value and value.upper() not in (digest(data), hashlib.sha1(data).hexdigest().upper()):
        raise Damaged(f"{name} differs")


def _record_at(data: bytes, at: int) -> Record:
    """The record at a place; version line, headers, length, end and digests are checked."""
    start = _START.match(data, at)
    if not start:
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("headers cut short")
    headers = {}
    for line in data[start.end() : head].split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header without name")
        headers[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no Content-Length")
    end = head + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record doesn't end where its length says")
    found = Record(at, end + 4, headers, data[head + 4 : end])
    _declared(headers, "warc-block-digest", found.block)
    if headers.get("warc-type") in ("response", "resource"):
        _declared(headers, "warc-payload-digest", found.payload())
    return found


def _read_at(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the gzip member, or the plain record, at a place, and where it ends."""
    if data[at : at + 3] != _MAGIC:
        found = _record_at(data, at)
        return [found], found.end
    content, end = _inflated(data, at)
    found, place = [], 0
    while place < len(content):
        one = _record_at(content, place)
        place = one.end
        found.append(Record(at, end, one.headers, one.block))
    return found, end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, and the gaps between them.

    After a failed check the next gzip member, or version line, that itself passes is looked for, from one byte behind the
    start of what failed; what lies between is one gap. Zero bytes and line ends between records are no damage."""
    at, size = 0, len(data)
    while at < size:
        if data[at] in b"\x00\r\n":
            at += 1
            continue
        try:
            found, end = _read_at(data, at)
        except Damaged as e:
            reason, found, end, next_ = str(e), [], size, size
            for m in _CANDIDATE.finditer(data, at + 1):
                try:
                    found, end = _read_at(data, m.start())
                except Damaged:
                    continue
                next_ = m.start()
                break
            yield Gap(at, next_, reason)
        yield from found
        at = end


_SCHEMA = "path string, start long, end long, gap string, record_type string, record_id string, target string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _salvaged(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in _SCHEMA.split(", ")]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            if isinstance(x, Gap):
                yield (path, x.start, x.end, x.reason, *[None] * 7)
                continue
            h, payload = x.headers, x.payload()
            of = lambda name, h=h: h[name].strip("<>") if name in h else None
            declared = h.get("warc-payload-digest", "").partition(":")[2] or None
            revisit = h.get("warc-type") == "revisit"
            size, sha = (None, declared) if revisit else (len(payload), digest(payload))
            yield path, x.start, x.end, None, h.get("warc-type"), of("warc-record-id"), h.get("warc-target-uri"), of("warc-refers-to"), size, sha, payload if with_payload and not revisit else None

    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            held, size = [], 0
            for row in rows(path.as_py(), data.as_py()):
                held.append(row)
                size += len(row[-1] or b"") + 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of WARC archives (files or a folder; plain or gzip members, any mix): one row each.

    path, start and end (the bytes of the file it stands in), gap (the failed check; null for records), record_type,
    record_id, target, refers_to, payload_bytes, payload_digest (bare base32 SHA-1), payload. Size and digest are those of the
    payload read; a revisit has none, and the digest it declares. An empty file has no row. An archive is one row of
    Spark's binary source, so a task needs some three times the largest archive; the writer cuts them at RECORDS records."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return for_python(files).mapInArrow(lambda x: _salvaged(x, with_payload), _SCHEMA)


def records(read: DataFrame) -> DataFrame:
    return read.where("gap IS NULL").drop("gap")


def quarantined(read: DataFrame) -> DataFrame:
    """(path, start, end, gap): the log of bytes that were passed over."""
    return read.where("gap IS NOT NULL").select("path", "start", "end", "gap")


def resolved(found: DataFrame) -> DataFrame:
    """Records (without payloads) whose revisits have size and digest of the response they refer to, where it was read.

    `found` is durable. A response that many revisits share is broadcast, the others meet them in a shuffled join."""
    found = found.select("record_type", "record_id", "target", "refers_to", "payload_bytes", "payload_digest")
    revisits, others = found.where("record_type = 'revisit'"), found.where("record_type <> 'revisit'")
    sought = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    known = others.groupBy("record_id").agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("of"))
    answers = durable(sought.join(known, F.col("refers_to") == F.col("record_id"), "left").select("refers_to", "of", "n"))
    floor = max(1000, int(answers.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    joined = lookup(revisits, answers.where("refers_to IS NOT NULL"), "refers_to", F.col("n") >= floor)
    joined = joined.withColumns({"payload_bytes": F.col("of.payload_bytes"), "payload_digest": F.coalesce("of.payload_digest", "payload_digest")})
    return others.unionByName(joined.select(others.columns)).unionByName(revisits.where("refers_to IS NULL"))




def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    folder = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    files, at = _hadoop(spark, folder)
    files.deleteOnExit(at)
    return folder


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    found = durable(records(read_warc(spark, folder, with_payload=False)).where("record_type IN ('response', 'revisit')").drop("payload"))
    number = lambda c: F.regexp_extract(c, f"^{URN}(-?[0-9]+)$", 1).try_cast("long")
    return resolved(found).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


QUERIES = {"op13_warc": op13_warc}
#: One pass of SHA-1 in bytes has no DuckDB function; tests compare with a brute-force version.
ORACLES: dict[str, str] = {}
