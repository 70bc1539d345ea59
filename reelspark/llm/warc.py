"""Operator 1: legacy ARC archives converted to WARC.

An ARC file starts with a version block (`filedesc://...`) that says which
version its record lines follow: version 1 lines have five fields (URL, IP,
date, type, length), version 2 lines ten (with result code, checksum, location,
offset and filename before the length). Each record is its line, as many bytes
as it declares, and a newline. From that the converter makes WARC/1.1 records:
a warcinfo for each file, and for each ARC record an identifier (a UUID of the
archive's name, record's place and line), an ISO timestamp, a type, block and
payload digests. Of records with equal payloads of at least `revisit_bytes`
bytes, the one with the largest order key stays a response; the others become
revisits that refer to it and carry no payload.

Files are written by tasks into a folder that all share, one gzip member for
each record; the manifest, a Parquet table committed by Spark, names those that
count, so what a failed or repeated attempt left is never read.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, filesystem, materialize, scratch_path, table

REVISIT_BYTES = 1000
#: A file is closed and the next begun beyond so many bytes.
FILE_BYTES = 64 << 20
#: Bytes of an archive that are read at once. Small, as each gzip member copies what of them lies behind it.
READ_BYTES = 1 << 16
#: Fixed values of the formats.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class ArcRecord:
    """A record of an ARC file; block has as many bytes as were there of those declared."""

    archive: str
    offset: int
    line: str
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    length: int
    block: bytes
    result: str = "-"
    truncated: bool = False

    @property
    def record_id(self) -> str:
        return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{self.archive}:{self.offset}:{self.line}')}>"

    @property
    def timestamp(self) -> str:
        return iso_date(self.date)


def iso_date(stamp: str) -> str:
    """A 14-digit ARC date, or its first 4 to 12 digits, as an ISO timestamp; the epoch if it is no date."""
    digits = stamp.strip()
    if re.fullmatch(r"\d{4,14}", digits):
        full = digits + "00000101000000"[len(digits) :]
        try:
            t = time.strptime(full, "%Y%m%d%H%M%S")
            return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(calendar.timegm(t)))
        except ValueError:
            pass
    return "1970-01-01T00:00:00Z"


class ArcReader:
    """Streams the records of one ARC file, plain or gzip (any members), in bounded memory.

    A line without a number at its end, or with too few fields, is skipped up to
    the next line; a declared length that reaches past the end gives a record
    marked truncated. Fields are taken from the right, as URLs may hold spaces.
    """

    def __init__(self, stream, archive: str):
        self.stream, self.archive, self.version, self.at = stream, archive, 1, 0
        self.buffer, self.pos, self.inflate, self.ended = b"", 0, None, False
        head = stream.read(READ_BYTES)
        if head[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
        self._feed(head)

    def _feed(self, data: bytes) -> None:
        """Put what data holds behind the bytes not yet taken, copying these once."""
        parts = [self.buffer[self.pos :]]
        if self.inflate is None:
            parts.append(data)
        while self.inflate is not None and data:
            parts.append(self.inflate.decompress(data))
            data = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.buffer, self.pos = b"".join(parts), 0

    def _more(self) -> bool:
        data = b"" if self.ended else self.stream.read(READ_BYTES)
        self.ended = not data
        if data:
            self._feed(data)
        return bool(data)

    def _line(self) -> bytes | None:
        searched = self.pos
        while (end := self.buffer.find(b"\n", searched)) < 0:
            behind = len(self.buffer) - self.pos
            if not self._more():
                end = len(self.buffer)
                break
            searched = self.pos + behind
        if self.pos == len(self.buffer):
            return None
        line = self.buffer[self.pos : end]
        self.pos = min(end + 1, len(self.buffer))
        self.at += len(line) + 1
        return line

    def _bytes(self, n: int) -> bytes:
        if len(self.buffer) - self.pos < n:
            parts = [self.buffer[self.pos :]]
            have = len(parts[0])
            while have < n:
                self.buffer, self.pos = b"", 0
                if not self._more():
                    break
                parts.append(self.buffer)
                have += len(self.buffer)
            # what is left over of the last part stays
            self.pos = len(self.buffer) - max(0, have - n)
            out = b"".join(parts)[:n]
        else:
            out = self.buffer[self.pos : self.pos + n]
            self.pos += n
        self.at += len(out)
        return out

    def __iter__(self) -> Iterator[ArcRecord]:
        while (line := self._line()) is not None:
            start = self.at - len(line) - 1
            text = line.decode("utf-8", "surrogateescape").rstrip("\r")
            fields = text.rsplit(" ", {1: 4, 2: 9}[self.version] if not text.startswith("filedesc:") else 4)
            if len(fields) < 5 or not fields[-1].isdigit():
                continue
            size = int(fields[-1])
            block = self._bytes(size)
            if text.startswith("filedesc:"):
                # its first line begins with the version that the record lines follow
                self.version = 2 if block[:1] == b"2" else 1
                continue
            if len(fields) < {1: 5, 2: 10}[self.version]:
                continue
            yield ArcRecord(self.archive, start, text, self.version, fields[0], fields[1], fields[2], fields[3], size, block, fields[4] if self.version == 2 else "-", len(block) < size)


def arc_header(archive: str, version: int, date: str) -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 reelspark\n{FIELDS[version]}\n".encode()
    rest = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {archive} {len(body)}"
    return f"filedesc://{archive} 0.0.0.0 {date} {rest}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, block: bytes, result: int = 200, archive: str = "-") -> bytes:
    """One ARC record; white space in the URL is percent-encoded, an empty one is a dash."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    more = "" if version == 1 else f" {result} - - 0 {archive}"
    return f"{url} {ip} {date} {content_type}{more} {len(block)}\n".encode("utf-8", "surrogateescape") + block + b"\n"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload); an empty head where the block is no HTTP response."""
    if block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def base32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def hex_digest(value: str) -> str:
    """The bare lower-case hex of a `sha1:` value in base 32."""
    return base64.b32decode(value.split(":")[-1]).hex()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc_stream(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a gzip or plain WARC stream, a record at a time."""
    reader = ArcReader(stream, "")
    while (line := reader._line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := reader._line()) not in (None, b"", b"\r"):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = reader._bytes(int(headers.get("content-length", "0")))
        yield headers, block


class _Files:
    """A task's archives, rotated by size; done() lists those that are whole."""

    def __init__(self, folder: str, suffix: str, head):
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.suffix, self.head, self.name, self.file, self.whole, self.size, self.records = suffix, head, None, None, [], 0, 0

    def add(self, data: bytes) -> None:
        if self.file is not None and self.size > FILE_BYTES:
            self.close()
        if self.file is None:
            task = TaskContext.get()
            self.name = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.{self.suffix}.gz"
            self.file, self.size, self.records = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, 0
            self._put(self.head(self.name))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        out = z.compress(data) + z.flush()
        self.file.write(out)
        self.size += len(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.whole.append((self.name, self.records, self.size))
            self.file = None

    def done(self) -> Iterator[pa.RecordBatch]:
        self.close()
        if self.whole:
            yield pa.record_batch([pa.array(x) for x in zip(*self.whole)], ["file", "records", "bytes"])


_MANIFEST = "file string, records long, bytes long"


def write_arcs(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Legacy archives of rows (url, date, content_type, head, payload, version), for tests and for tables that were never archived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {v: _Files(folder, f"v{v}.arc", lambda name, v=v: arc_header(name, v, "20000101000000")) for v in (1, 2)}
        for b in blocks(batches):
            for url, date, kind, head, payload, version in zip(*(b.column(c).to_pylist() for c in ("url", "date", "content_type", "head", "payload", "version"))):
                files[version].add(arc_record(version, url or "", "0.0.0.0", date, kind, (head or "").encode() + (payload or "").encode("utf-8", "surrogatepass"), archive=files[version].name or "-"))
        for f in files.values():
            yield from f.done()

    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")


def read_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the folder's manifest lists, a task for each file, with what the converter derives."""
    schema = "record_id string, url string, ip string, timestamp string, content_type string, version int, truncated boolean, order_key string, head binary, payload binary, payload_bytes long, sha1 string"
    arrow = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("timestamp", pa.string()), ("content_type", pa.string()), ("version", pa.int32()), ("truncated", pa.bool_()), ("order_key", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("sha1", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                out, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for r in ArcReader(f, name):
                        head, payload = split_http(r.block)
                        clean = lambda s: s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                        out.append((r.record_id, clean(r.url), r.ip, r.timestamp, clean(r.content_type), r.version, r.truncated, _order_key(head, r), head, payload, len(payload), hashlib.sha1(payload).hexdigest()))
                        size += r.length
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), arrow.types)], schema=arrow)
                            out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), arrow.types)], schema=arrow)

    return _each_file(spark, folder).mapInArrow(run, schema)


def _each_file(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _order_key(head: bytes, r: ArcRecord) -> str:
    """What decides which of equal payloads stays: the X-Page-Id of the response, or below all of these, date and place."""
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return f"1:{int(found[1]) + 2**63:020d}" if found else f"0:{r.timestamp}:{r.record_id}"


def convert(spark: SparkSession, arcs: str, warcs: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the records of the ARC folder as WARC archives.

    An empty folder gives an empty manifest. Which record of equal payloads stays
    is found from digests, sizes and keys alone, combined before the shuffle;
    only payloads that occur more than once then meet their group.
    """
    found = read_arcs(spark, arcs)
    large = F.col("payload_bytes") >= revisit_bytes
    groups = found.where(large).groupBy("sha1", "payload_bytes").agg(F.max("order_key").alias("top"), F.max_by("record_id", "order_key").alias("target"), F.count("*").alias("n")).where("n > 1")
    dated = found.join(groups.select("sha1", "payload_bytes", "top", "target"), ["sha1", "payload_bytes"], "left")
    dated = dated.withColumn("target", F.when(large & (F.col("record_id") != F.col("target")), F.col("target")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = lambda name: warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: reelspark\r\nformat: WARC File Format 1.1\r\n")
        files = _Files(warcs, "warc", info)
        for b in blocks(batches):
            for r in b.to_pylist():
                revisit, http = r["target"] is not None, bool(r["head"])
                block = r["head"] + (b"" if revisit else r["payload"])
                kind = "revisit" if revisit else "response" if http else "resource"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["timestamp"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("Content-Type", "application/http; msgtype=response" if http else r["content_type"])]
                headers += [("WARC-Payload-Digest", base32(r["sha1"])), ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest()))]
                headers += [("WARC-Refers-To", r["target"]), ("WARC-Profile", REVISIT_PROFILE)] if revisit else []
                headers += [("WARC-Truncated", "length")] if r["truncated"] else []
                files.add(warc_record(headers, block))
        yield from files.done()

    names = ["record_id", "url", "ip", "timestamp", "content_type", "truncated", "head", "payload", "sha1", "target"]
    dated.select(*names).mapInArrow(run, _MANIFEST).write.parquet(f"{warcs}/manifest")


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, type, url, timestamp, refers_to_id, http_head, payload_bytes, payload_digest, digest_ok) of each record but the warcinfos.

    payload_digest is hex, of the payload that is there, or as the record states it for a revisit; payload_bytes likewise, from its Content-Length.
    """
    schema = "record_id string, type string, url string, timestamp string, refers_to_id string, http_head string, payload_bytes long, payload_digest string, digest_ok boolean"
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_()]
    names = ["record_id", "type", "url", "timestamp", "refers_to_id", "http_head", "payload_bytes", "payload_digest", "digest_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                out = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for h, block in read_warc_stream(f):
                        if h["warc-type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        stated, sha = hex_digest(h["warc-payload-digest"]), hashlib.sha1(payload).hexdigest()
                        size = len(payload)
                        if h["warc-type"] == "revisit":
                            length = re.search(rb"\r\nContent-Length: (\d+)\r\n", head)
                            size, sha = int(length[1]) if length else None, stated
                        out.append((h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"], h.get("warc-refers-to"), head.decode("utf-8", "replace"), size, sha, sha == stated and base32(hashlib.sha1(block).hexdigest()) == h["warc-block-digest"]))
                        if len(out) == 2000:
                            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                            out = []
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return _each_file(spark, folder).mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, digest_ok) of each row of pages, through ARC and WARC archives.

    Pages become legacy ARC records (even ids in version 1, odd ids in version
    2), these are converted, and the WARC archives are read back. Null html:
    empty payload; null url: a dash. Each row is a record; rows with the same id
    and payload have equal keys, one of them stays. A null page_id isn't
    written to the head, is below all others, and comes back null. An empty table gives an empty result.
    """
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(page.isNotNull(), F.concat(F.lit("X-Page-Id: "), page.cast("string"), F.lit("\r\n"))).otherwise(""), F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    write_arcs(spark, pages.select(F.col("url").cast("string").alias("url"), F.lit("20000101000000").alias("date"), F.lit("text/html").alias("content_type"), head.alias("head"), html.alias("payload"), F.coalesce(F.pmod(page, F.lit(2)) + 1, F.lit(1)).cast("int").alias("version")), arcs)
    convert(spark, arcs, warcs, revisit_bytes)
    # what the archives say is a short row for each record; kept, so that they are read once and not for each use below
    back = materialize(spark, read_warcs(spark, warcs), "records").withColumn("page_id", F.regexp_extract("http_head", r"\r\nX-Page-Id: (-?\d+)\r\n", 1).try_cast("long"))
    targets = back.where("type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = back.where("type = 'revisit'").join(targets, "refers_to_id", "left")
    rest = back.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "digest_ok"]
    return rest.withColumn("record_type", F.lit("response")).select(names).unionAll(revisits.withColumn("record_type", F.col("type")).select(names))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as body, sha1(encode(coalesce(html, ''))) as payload_digest from pages),
q as (select page_id, octet_length(body)::bigint as payload_bytes, payload_digest, max(page_id) over (partition by payload_digest, octet_length(body)) as top from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {REVISIT_BYTES} and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and page_id <> top then top end as refers_to
from q
"""
