"""Operator 10: WARC archives written and read back, with segmented records and chunked payloads.

Writing: a page becomes one record whose block is an HTTP response in chunked transfer framing; blocks longer than
``segment_bytes`` are cut into a first record and continuation records.  Of equal payloads of at least ``least`` bytes one is
stored (the largest page_id), the others as revisit records that refer to it.  Records are written by Spark's text writer
with the record separator as line separator (CR LF CR LF), so the archives are plain gzip WARC files in any file system
that Spark knows, and task commits make retries safe.  A block is at most ``segment_bytes`` long and a file holds at most ``file_records`` records,
continuations counted, so a reader's row is at most ``file_records * (segment_bytes + headers)``, 66 MB by default.

Identifiers: a record that revisits refer to is named by page_id, digest and url, so WARC-Refers-To names a record of the archive;
a page that occurs more than once with url and payload is the same record written again, under one name.  Other names end in task and row.

Reading: files are parsed as byte streams by Content-Length; continuation records are grouped by their origin's identifier,
ordered by segment number, checked against the total length and joined; chunked framing is decoded; payload digests are
checked.  A missing segment, a wrong length or a wrong digest raises.  Archives of other writers are read, too: one gzip member a record, folded
header lines, records of other kinds (skipped), payload digests that are missing, base32, of another algorithm, or taken
before the framing is decoded.  Files are read in one task each, so foreign archives need files that fit one row (2 GB).

Edge cases: null html is an empty payload; null ids are written as such, and are never the one that others refer to while one has an
id; rows that repeat the largest id are all stored; an empty table gives an empty one; urls are
percent-escaped where they hold control characters; other columns of the input, whatever their names, are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import heavy, split_join

LEAST, SEGMENT, CHUNK, FILE_RECORDS = 1000, 65_536, 16_384, 1000
CRLF = b"\r\n"
#: Most bytes of blocks in one file; it is read as one row.
FILE_BYTES = 1 << 28
PARSED = "page_id long, kind string, record_id string, origin string, uri string, seg int, total long, refers_to long, refers_to_record string, label string, http boolean, digest string, block binary, payload binary"
#: Record types that hold or name a payload; others are skipped (fixed values).
KINDS = ("response", "resource", "revisit", "continuation")
COLUMNS = ("page_id", "record_type", "record_id", "uri", "digest", "refers_to", "refers_to_record")


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; extensions and trailers are allowed, a short body raises."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if at + n + 2 > len(body) or body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk framing is broken")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block


def records(segment: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            for page, url, html, digest, name, main, target in zip(*(c if k == 2 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                n += 1
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                name = name or f"<urn:page:{page}:{digest}:{task}-{n}>"
                uri = ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"))
                # the separator must not occur by itself at a record's end only; it may occur inside blocks, which are read by length
                common = [("WARC-Record-ID", name), uri, ("WARC-Date", "1970-01-01T00:00:00Z"), ("Page-ID", "" if page is None else str(page)), ("WARC-Payload-Digest", f"sha1:{digest}")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                kind = ("Content-Type", "application/http; msgtype=response")
                if target:
                    fields = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", target), ("Refers-To-Page-ID", str(main)), kind]
                    out.append(header(fields, head))
                    continue
                block = head + chunked(payload, chunk)
                cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
                first = [("WARC-Type", "response"), *common, kind]
                if len(cuts) > 1:
                    first.append(("WARC-Segment-Number", "1"))
                out.append(header(first, cuts[0]))
                for k, part in enumerate(cuts[1:], 2):
                    more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), uri, ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
                    out.append(header([*more, ("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else more, part))
                if sum(map(len, out)) > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_warc(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK, file_records: int = FILE_RECORDS, scratch: Scratch | None = None) -> None:
    if file_records * segment > FILE_BYTES:
        raise ValueError(f"a file of {file_records} records of {segment} bytes is more than {FILE_BYTES} bytes")
    scratch = scratch or Scratch(pages.sparkSession)
    body, url = F.coalesce("html", F.lit("")).cast("binary"), F.col("url").cast("string")
    place = F.substring(F.sha1(F.coalesce(url, F.lit("")).cast("binary")), 1, 16)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"), place.alias("place"))
    stored = base.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "place")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1 and m.page_id is not null")
    stored = scratch.keep(stored, "stored")
    told = split_join(base, stored, ["digest"], heavy(stored, "digest", "c"), "left")
    name = lambda page, at: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(":"), F.col("digest"), F.lit(":"), at, F.lit(">"))
    main = F.col("m.page_id")
    revisit = main.isNotNull() & ~main.eqNullSafe(F.col("page_id"))
    told = told.select("page_id", "url", "html", "digest", F.when(main == F.col("page_id"), name(main, F.col("place"))).alias("name"), main.alias("main"), F.when(revisit, name(main, F.col("m.place"))).alias("target"))
    out = told.mapInArrow(records(segment, chunk), "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        for i in range(len(lines) - 1, 1, -1):
            if lines[i][:1] in (" ", "\t"):  # a folded line belongs to the one before
                lines[i - 1 : i + 1] = [f"{lines[i - 1]} {lines[i].strip()}"]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != CRLF + CRLF:
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, block
        at = end + 8 + n


def inflate(data: bytes) -> bytes:
    """All members of a gzip file, or the data themselves."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def expected(label: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of a digest header, base16 or base32; None if there is none or its algorithm is unknown."""
    kind, _, value = (label or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if not value or kind not in hashlib.algorithms_guaranteed or not (size := hashlib.new(kind).digest_size):
        return None
    if len(value) == 2 * size:
        return kind, bytes.fromhex(value)
    return kind, base64.b32decode(value.upper() + "=" * (-len(value) % 8))


def checked(block: bytes, http: bool, label: str | None) -> bytes:
    """The payload of a whole block; its digest may have been taken of the decoded payload or of the body as it was sent."""
    payload = http_payload(block) if http else block
    if want := expected(label):
        sent = block.partition(CRLF + CRLF)[2] if http else block
        if want[1] not in (hashlib.new(want[0], payload).digest(), hashlib.new(want[0], sent).digest()):
            raise ValueError("payload digest does not match")
    return payload


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in PARSED.split(", "))])
    number = lambda f, k: int(f[k]) if f.get(k) else None
    for batch in batches:
        for file in batch.column(0):
            rows, held = [], 0
            for f, block in parse(inflate(file.as_buffer().to_pybytes())):
                kind, seg, label = f["warc-type"], number(f, "warc-segment-number"), f.get("warc-payload-digest")
                if kind not in KINDS:
                    continue
                http = f.get("content-type", "").startswith("application/http")
                payload = checked(block, http, label) if kind != "revisit" and seg is None else None
                told = expected(label) if payload is None else ("sha1", hashlib.sha1(payload).digest())
                rows.append({
                    "page_id": number(f, "page-id"), "kind": kind, "record_id": f["warc-record-id"], "origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "uri": f.get("warc-target-uri"), "seg": seg,
                    "total": number(f, "warc-segment-total-length"), "refers_to": number(f, "refers-to-page-id"), "refers_to_record": f.get("warc-refers-to"), "label": label, "http": http,
                    "digest": told[1].hex() if told and told[0] == "sha1" else None, "block": block if seg else None, "payload": payload,
                })
                held += len(block)
                if len(rows) == 256 or held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, payload = [], []
        for r in batch.select(["origin", "parts", "http", "label", "copies"]).to_pylist():
            parts = sorted(r["parts"], key=lambda x: x["seg"])
            block = b"".join(x["block"] for x in parts)
            total = [x["total"] for x in parts if x["total"] is not None]
            if [x["seg"] for x in parts] != list(range(1, len(parts) + 1)) or total != [len(block)] or {x["c"] for x in parts} != {r["copies"]}:
                raise ValueError(f"segments of {r['origin']} are incomplete")
            payload.append(checked(block, r["http"], r["label"]))
            digest.append(hashlib.sha1(payload[-1]).hexdigest())
        kept = [batch.column(n) for n in ("page_id", "kind", "origin", "uri", "copies")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digest, pa.string()), pa.array(payload, pa.binary())], names=["page_id", "record_type", "record_id", "uri", "copies", "digest", "payload"])


def parsed(spark, path: str, pattern: str = "part-*") -> DataFrame:
    """A row for each record (see ``PARSED``); of segments the block, of whole records the payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    return files.mapInArrow(read_files, PARSED)


def reassembled(rows: DataFrame) -> DataFrame:
    """The segmented records among ``parsed`` rows as ``COLUMNS`` and ``payload``; a record that was written more than once comes as often, assembled once."""
    first = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c)
    parts = rows.where("seg is not null").groupBy("origin", "seg").agg(*map(first, ("page_id", "kind", "uri", "label", "http")), F.max("total").alias("total"), F.first("block").alias("block"), F.count(F.lit(1)).alias("c"))
    cut = parts.groupBy("origin").agg(*[F.max(c).alias(c) for c in ("page_id", "kind", "uri", "label", "http")], F.max("c").alias("copies"), F.collect_list(F.struct("seg", "total", "block", "c")).alias("parts"))
    out = cut.mapInArrow(assemble, "page_id long, record_type string, record_id string, uri string, copies long, digest string, payload binary")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS[:5], none("long", "refers_to"), none("string", "refers_to_record"), "payload")


def whole(rows: DataFrame, *more: str) -> DataFrame:
    return rows.where("seg is null").withColumnRenamed("kind", "record_type").select(*COLUMNS, *more)


def read_warc(spark, path: str, pattern: str = "part-*") -> DataFrame:
    """``COLUMNS`` and ``payload`` of each record; the payload is null for revisits.  Both branches parse the archives; ``round_trip`` keeps the rows instead."""
    rows = parsed(spark, path, pattern)
    return whole(rows, "payload").union(reassembled(rows))


def round_trip(pages: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """Write all pages, read the archives back, and give each record's digest columns; a revisit's are those of the record it refers to."""
    path = scratch.path("warc")
    with scratch.writing():
        write_warc(pages, path, scratch=scratch, **options)
    scratch.release()
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    rows = scratch.keep(parsed(pages.sparkSession, path).withColumn("payload_bytes", size).drop("payload"), "records")
    slim = scratch.keep(whole(rows, "payload_bytes").union(reassembled(rows).select(*COLUMNS, size)), "whole-records")
    scratch.drop(rows)
    names = slim.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("refers_to_record").alias("record_id"))
    stored = slim.where("record_type = 'response'").groupBy("record_id").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("digest").alias("digest"))
    asked = names.groupBy("record_id").agg(F.count(F.lit(1)).alias("c"))
    revisits = split_join(names, stored, ["record_id"], heavy(asked, "record_id", "c"), "left")
    columns = ("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return slim.where("record_type = 'response'").select(*columns).union(revisits.select(*columns))
