"""Legacy archive converter (operator 11): ARC files of versions 1 and 2 become WARC files.

An ARC file is a ``filedesc`` record, whose body names the version, and records of one header line and as
many bytes as that line declares. Version 1 declares five fields, version 2 ten. The converter reads
the archives by Spark's ``binaryFile``, walks the declared lengths, and synthesises for every record
what WARC asks for: an identifier (a name-based UUID of archive and offset), a time in ISO 8601, a
type (``warcinfo`` for filedesc, ``response`` for HTTP messages, ``resource`` for the rest), and SHA-1 digests
of block and payload. Archives may be plain or gzip, of one or many members; they are unpacked piece
by piece, so a task holds a compressed archive and its largest record.

Payloads met before become ``revisit`` records without payload: a first pass over the archives keeps
lengths and digests alone; equal payloads (by length and SHA-256) are grouped, and the one with the
largest page_id stays a response. The revisits of an archive go to it as one list, so payloads are
shuffled neither by digest nor at all if the lists are small. Payloads that a third of all records share
are a hot key of light rows, joined by ``join_by_key``.

Records go through Spark's text writer byte by byte (a binary column cast to text is not changed), so any
store that Spark writes to will do. A WARC file's records are those of whole archives.

Defined results: a null html is an empty payload; a null url is ``about:blank``; line breaks and spaces in
a url are percent-encoded; a null page_id is smaller than any other and never a ``refers_to``; of
repeated rows with the largest page_id one is the response (the last by archive and offset); an
archive that ends inside a record gives that record marked ``WARC-Truncated``; a header line
that neither version explains stops the job with archive and offset; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.hot_keys import join_by_key
from plumbline.session import new_path, written

# Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_HEADER = {
    1: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<type>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<type>.*) (?P<code>\d+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)"),
}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"

ARCHIVE_DATE = "20000101000000"  # pages carry no time of their own
PIECE = 1 << 20
BATCH_BYTES = 4 << 20
FIRST_IN_PARTITION = (1 << 33) - 1  # the bits of monotonically_increasing_id that number a partition's rows


class Unpacked:
    """Lines and runs of bytes of an archive, plain or gzip, unpacked as they are asked for."""

    def __init__(self, content: memoryview):
        self.rest, self.held, self.at = content, bytearray(), 0
        self.packed = bytes(content[:2]) == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if not self.packed:
            piece, self.rest = self.rest[:PIECE], self.rest[PIECE:]
        elif self.member.eof:  # another member, or padding after the last
            self.rest = memoryview(self.member.unused_data)
            if bytes(self.rest[:2]) != b"\x1f\x8b":
                return False
            self.member = zlib.decompressobj(31)
            return self._more()
        else:
            piece = self.member.decompress(self.rest, PIECE)
            self.rest = self.member.unconsumed_tail
            if not piece and not self.member.eof:
                return False  # cut short
            if not piece:
                return self._more()
        self.held += piece
        return len(piece) > 0

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        start = 0
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self._more():
                end = len(self.held)
                break
        if not self.held:
            return None
        out = bytes(self.held[:end])
        used = min(end + 1, len(self.held))
        del self.held[:used]
        self.at += used
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or as many as there are."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out


def arc_records(content: memoryview, archive: str = "") -> Iterator[dict]:
    """The records of an ARC file: their header fields as text, ``body``, ``at`` (the offset of the header
    line, unpacked), ``version``, ``truncated``."""
    stream, version = Unpacked(content), None
    while True:
        at = stream.at
        header = stream.line()
        if header is None:
            return
        if not header.strip():
            continue
        described = header.startswith(b"filedesc:")
        # the version stands in the body of the filedesc record, whose own line has five fields or ten
        tried = (2, 1) if described or version is None else (version,)
        parts = next((m for v in tried if (m := ARC_HEADER[v].fullmatch(header))), None)
        if parts is None:
            raise ValueError(f"{archive}: no ARC header line at byte {at}: {header[:200]!r}")
        fields = {k: v.decode("utf-8", "replace") for k, v in parts.groupdict().items()}
        body = stream.take(int(fields["length"]))
        if described:
            version = 2 if body[:1] == b"2" else 1
        yield fields | {"body": body, "at": at, "version": version, "truncated": len(body) < int(fields["length"])}


def iso_time(date: str) -> str:
    """An ARC date (8 to 17 digits) in ISO 8601; missing parts are the earliest."""
    d = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    fraction = f".{d[14:]}" if len(d) > 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}{fraction}Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, at: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP message."""
    for end in (b"\r\n\r\n", b"\n\n"):
        cut = block.find(end)
        if cut >= 0:
            return block[: cut + len(end)], block[cut + len(end) :]
    return block, b""


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def warc_equivalent(record: dict, archive: str) -> tuple[dict[str, str], bytes, bytes]:
    """(named fields, head of the block, payload) of the WARC record that an ARC record becomes."""
    body, head, payload = record["body"], b"", record["body"]
    if record["url"].startswith("filedesc:"):
        kind, media = "warcinfo", "application/warc-fields"
        lines = ["software: plumbline", "format: WARC File Format 1.1", f"description: converted from {record['url'][11:]}, ARC version {record['version']}"]
        head, payload = b"", "".join(f"{x}\r\n" for x in lines).encode()
    elif body[:5] == b"HTTP/":
        kind, media = "response", HTTP_RESPONSE
        head, payload = http_parts(body)
    else:
        kind, media = "resource", record["type"]
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(archive, record['at'])}>", "WARC-Date": iso_time(record["date"])}
    if kind == "warcinfo":
        fields["WARC-Filename"] = archive.rsplit("/", 1)[-1]
    else:
        fields |= {"WARC-Target-URI": record["url"], "WARC-IP-Address": record["ip"], "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"}
    if record["truncated"]:
        fields["WARC-Truncated"] = "unspecified"
    return fields | {"Content-Type": media}, head, payload


def as_revisit(fields: dict[str, str], refers_to: str, uri: str, date: str) -> dict[str, str]:
    return fields | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>", "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date}


def warc_bytes(fields: dict[str, str], block: bytes) -> bytes:
    fields = fields | {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    named = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return WARC_VERSION + b"\r\n" + named.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(content: memoryview, archive: str = "") -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, named fields, block) of the records of a WARC file."""
    stream = Unpacked(content)
    while True:
        at, first = stream.at, stream.line()
        if first is None:
            return
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no WARC record at byte {at}: {first[:200]!r}")
        fields = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        yield at, fields, stream.take(int(fields["Content-Length"]))


# --- the jobs ---------------------------------------------------------------------------------------


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): the files below ``path``, whatever their names."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = ARCHIVE_DATE) -> None:
    """Pages as gzip ARC files, one per partition, by turns of version 1 and 2, each with its filedesc
    record; the html is the payload of an HTTP response that names the page."""
    number = F.monotonically_increasing_id()
    page = F.col("page_id").cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), page), F.lit("")), F.lit("\r\n\r\n")
    )
    rows = pages.select(number.alias("at"), F.when(F.length(url) > 0, url).otherwise("about:blank").alias("url"), F.concat(head, html).alias("body"))
    size = F.octet_length("body").cast("string")
    second = F.pmod(F.shiftright("at", 33), F.lit(2)) == 1
    name = F.concat(F.lit("part-"), F.shiftright("at", 33).cast("string"), F.lit(".arc"))
    v1 = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), size)
    v2 = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), name, size)

    def described(version: int, more) -> F.Column:
        body = f"{version} 0 plumbline\n{ARC_FIELDS[version]}\n"
        return F.concat(F.lit("filedesc://"), name, F.lit(f" 0.0.0.0 {date} text/plain "), *more, F.lit(f"{len(body)}\n{body}\n"))

    first = F.when(second, described(2, [F.lit("200 - - 0 "), name, F.lit(" ")])).otherwise(described(1, []))
    opening = F.when(F.col("at").bitwiseAND(FIRST_IN_PARTITION) == 0, first).otherwise("")
    record = F.concat(opening, F.when(second, v2).otherwise(v1), F.lit("\n"), F.col("body"))
    rows.select(record.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


LIGHT = "archive string, at long, page_id long, uri string, date string, payload_bytes long, sha256 binary"


def payload_index(files: DataFrame) -> DataFrame:
    """One light row for each HTTP response of the ARC files: where it is and what its payload is."""
    schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("sha256", pa.binary())])

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for record in arc_records(memoryview(content.as_buffer()), archive.as_py()):
                    if record["body"][:5] == b"HTTP/":
                        head, payload = http_parts(record["body"])
                        page = http_field(head, b"X-Page-Id")
                        rows.append((archive.as_py(), record["at"], None if page is None else int(page), record["url"], iso_time(record["date"]), len(payload), hashlib.sha256(payload).digest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.mapInArrow(run, LIGHT)


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(path, again): for each archive the records that revisit another, each with its offset and what it
    refers to (archive, offset, uri, date). Payloads under ``min_bytes`` revisit nothing."""
    index = written(index, "payloads")
    keys = ["payload_bytes", "sha256"]
    last = F.max(F.struct("page_id", "archive", "at", "uri", "date")).alias("kept")
    shared = index.filter(F.col("payload_bytes") >= min_bytes).groupBy(*keys).agg(F.count("*").alias("n"), last).filter("n > 1")
    shared = written(shared, "shared")
    met = join_by_key(index.select("archive", "at", *keys), shared, keys, "n")
    again = met.filter((F.col("archive") != F.col("kept.archive")) | (F.col("at") != F.col("kept.at")))
    refers = F.struct("at", F.col("kept.archive").alias("archive"), F.col("kept.at").alias("kept_at"), F.col("kept.uri").alias("uri"), F.col("kept.date").alias("date"))
    return again.groupBy(F.col("archive").alias("path")).agg(F.collect_list(refers).alias("again"))


def convert(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """The ARC files below ``source`` as WARC files below ``target``."""
    files = archives(spark, source)
    # written, so that Spark knows its size when it picks the join
    lists = written(revisits(payload_index(files), min_bytes), "revisits")

    def run(batches):
        for batch in batches:
            for archive, content, again in zip(batch.column("path"), batch.column("content"), batch.column("again")):
                archive = archive.as_py()
                known = {x["at"]: x for x in again.as_py() or ()}
                held, size = [], 0
                for record in arc_records(memoryview(content.as_buffer()), archive):
                    fields, head, payload = warc_equivalent(record, archive)
                    if (of := known.get(record["at"])) is not None:
                        fields, payload = as_revisit(fields, record_id(of["archive"], of["kept_at"]), of["uri"], of["date"]), b""
                    # the text writer ends every row by a line feed
                    held.append(warc_bytes(fields, head + payload)[:-1])
                    size += len(held[-1])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    records = files.join(lists, "path", "left").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(target)


CAPTURES = "file string, at long, record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, intact boolean"


def captures(files: DataFrame) -> DataFrame:
    """The index of WARC files: a row for each response, resource and revisit. ``payload_bytes`` and
    ``payload_digest`` are of the full payload, for revisits as their headers tell them; ``intact``: the
    digests in the file fit what stands there."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in ("record_id", "record_type", "uri", "date")), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("intact", pa.bool_())])

    def row(file: str, at: int, fields: dict[str, str], block: bytes) -> tuple:
        http = fields["Content-Type"] == HTTP_RESPONSE
        head, payload = http_parts(block) if http else (b"", block)
        told = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        intact = fields.get("WARC-Block-Digest") == f"sha1:{base32_sha1(block)}"
        if fields["WARC-Type"] == "revisit":
            n, digest = int(http_field(head, b"Content-Length") or 0), told
        else:
            n, digest = len(payload), base32_sha1(payload)
            intact &= digest == told
        page, refers = http_field(head, b"X-Page-Id"), fields.get("WARC-Refers-To")
        return (file, at, fields["WARC-Record-ID"].strip("<>"), fields["WARC-Type"], fields.get("WARC-Target-URI"), fields["WARC-Date"], None if page is None else int(page), n, digest, refers and refers.strip("<>"), intact)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                found = [row(file.as_py(), at, fields, block) for at, fields, block in warc_records(memoryview(content.as_buffer()), file.as_py()) if fields["WARC-Type"] != "warcinfo"]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return files.mapInArrow(run, CAPTURES)


def resolved(index: DataFrame) -> DataFrame:
    """The captures with ``refers_to``: the page_id of the response that a revisit refers to."""
    index = written(index, "captures")
    asked = written(index.filter(F.col("refers_to_id").isNotNull()).groupBy("refers_to_id").agg(F.count("*").alias("n")), "asked")
    answers = index.filter(F.col("refers_to_id").isNull()).select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    keys = written(asked.join(answers, "refers_to_id"), "answers")
    again = join_by_key(index.filter(F.col("refers_to_id").isNotNull()), keys, ["refers_to_id"], "n").drop("n")
    return index.filter(F.col("refers_to_id").isNull()).withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC files, converted, and read back from the WARC files."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arcs)
    convert(spark, arcs, warcs)
    return resolved(captures(archives(spark, warcs))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date", "intact")


QUERIES = {"op11_arc_to_warc": op11_arc_to_warc}
ORACLE_SQL = {
    "op11_arc_to_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, coalesce(nullif(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), ' ', '%20'), ''), 'about:blank') AS uri FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last, sha1(payload) || '00' AS hex FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST((5 * i) // 4 + 1 AS BIGINT), 3) AS BIGINT) >> (7 - (5 * i) % 4)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to,
       uri, '{iso_time(ARCHIVE_DATE)}' AS date, TRUE AS intact
FROM k""",
}
