"""op9: legacy ARC archives to WARC.

ARC files (versions 1 and 2) have one header line and a declared length for
each record. The converter parses them and synthesises what WARC wants: record
identifiers, timestamps, types and digests. WARC shards are written by Spark's
text writer (its line end is the last byte of a record's closing CRLF CRLF),
gzip-compressed as whole files, and read back as binary files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import scratch_path

from .common import small_batches, stash

#: The header fields of each ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SHARD_BYTES = 16 << 20
_ID_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")


def base32_sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


# ---------------------------------------------------------------- ARC
def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 shelf\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, 0, name)


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    """Header line, block and the closing line end."""
    head = [quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "-", ip, date, kind]
    if version == 2:
        head += ["200", base64.b32encode(zlib.crc32(block).to_bytes(4, "big")).decode().rstrip("="), "-", str(offset), name]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block + b"\n"


def iter_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record but the version blocks, whose
    first line says how many fields the lines after it have. Line ends
    between records are optional; a length beyond the data is an error."""
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without an end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        size = int(line.rsplit(" ", 1)[-1])
        block = data[end + 1:end + 1 + size]
        if len(block) < size:
            raise ValueError(f"ARC record of {size} bytes is cut at {len(block)}")
        at = end + 1 + size
        if line.startswith("filedesc://"):
            fields = ARC_FIELDS[2 if block[:1] == b"2" else 1]
            continue
        values = line.rsplit(" ", len(fields) - 1)  # an unescaped blank belongs to the URL
        if len(values) != len(fields):
            raise ValueError(f"ARC header with {len(values)} fields")
        yield dict(zip(fields, values)), block


# ---------------------------------------------------------------- WARC
def warc_date(arc_date: str) -> str:
    """ARC dates have 14 digits, early ones 12 or 8."""
    d = (re.sub("[^0-9]", "", arc_date) + "00000101000000"[len(re.sub("[^0-9]", "", arc_date)):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, sep, body = block.partition(b"\r\n\r\n")
    return (head + sep, body) if sep else (b"", block)


def record_id(url: str, date: str, digest: str, kind: str = "", place: str = "") -> str:
    """``place`` tells records apart that are equal in the rest: page, file and offset, ..."""
    return f"<urn:uuid:{uuid.uuid5(_ID_SPACE, f'{url} {date} {digest} {kind} {place}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "", "")), ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("Content-Type", "application/warc-fields")], b"software: shelfcast\r\nformat: WARC File Format 1.1\r\n")


def convert(head: dict[str, str], block: bytes, place: str = "", refers_to: dict[str, str] | None = None) -> bytes:
    """One ARC record as a WARC record: ``response`` for HTTP, ``resource``
    for other content, ``revisit`` (HTTP header kept, payload left out) where
    ``refers_to`` gives the headers that name the record with the payload."""
    http, payload = split_http(block) if block.startswith(b"HTTP/") else (b"", block)
    digest, date = base32_sha1(payload), warc_date(head["Archive-date"])
    kind = "revisit" if refers_to else "response" if http else "resource"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(head["URL"], date, digest, kind, place)), ("WARC-Date", date),
               ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http;msgtype=response" if http else head["Content-type"])]
    if refers_to:
        headers += [("WARC-Profile", REVISIT_PROFILE), *refers_to.items()]
        block = http
    return warc_record([*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], block)


def iter_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of bytes."""
    it, buf = iter(chunks), b""

    def need(n: int) -> bool:
        nonlocal buf
        parts, have = [buf], len(buf)
        while have < n and (c := next(it, None)) is not None:
            parts.append(c)
            have += len(c)
        buf = b"".join(parts) if len(parts) > 1 else buf
        return have >= n

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not need(len(buf) + 1):
                if buf.strip():
                    raise ValueError("WARC record without an end")
                return
        version, *lines = buf[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(head["content-length"])
        if not need(end + 4 + size + 4) or buf[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError("WARC record with a wrong length")
        yield head, buf[end + 4:end + 4 + size]
        buf = buf[end + 8 + size:]


def gunzip(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        for lo in range(0, len(data), step):
            if out := d.decompress(data[lo:lo + step]):
                yield out
            if d.eof:
                data = d.unused_data + data[lo + step:]
                break
        else:
            if not d.eof:
                raise ValueError("cut gzip file")


# ---------------------------------------------------------------- Spark
def write_warc(records: DataFrame, path: str) -> None:
    """``records(shard binary)``: one file a row."""
    (records.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1)
     .option("compression", "gzip").text(path))


def _shards(records: Iterator[bytes], name: str) -> Iterator[pa.RecordBatch]:
    held, size, k = [], 0, 0

    def flush() -> pa.RecordBatch:  # the writer adds the last line feed
        return pa.RecordBatch.from_arrays([pa.array([b"".join([warcinfo(f"{name}-{k}"), *held])[:-1]], pa.binary())], ["shard"])

    for r in records:
        held.append(r)
        size += len(r)
        if size >= SHARD_BYTES:
            yield flush()
            held, size, k = [], 0, k + 1
    if held:
        yield flush()


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert ARC files (plain or gzip) under ``arc_path`` to WARC shards."""
    small_batches(spark)

    def run(batches):
        from pyspark import TaskContext
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        return _shards((convert(h, x, f"{name} {k}") for name, d in rows for k, (h, x) in enumerate(iter_arc(b"".join(gunzip(d))))), f"arc-{TaskContext.get().partitionId()}")

    write_warc(spark.read.format("binaryFile").load(arc_path).select("path", "content").mapInArrow(run, "shard binary"), warc_path)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, arc_version: int = 2, date: str = "19700101000000") -> None:
    """Pages -> ARC records -> WARC shards under ``path``. Of equal payloads of
    at least ``min_bytes`` bytes the one with the smallest page_id is written
    whole, the others as revisits that name its URI, date and record. Null html
    is an empty payload; a null page_id never is the smallest while others
    exist; rows that share page_id and payload are all written whole or all
    revisits, and a revisit then names them by URI and date alone."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    # page_id, url and digest only: no payload is shuffled to find equal ones
    ids = stash(p.groupBy("sha", "page_id").agg(F.min("url").alias("url"), F.count("*").alias("rows"), F.max(F.length("html")).alias("bytes")), "payload-pages")
    first = stash(ids.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(
        F.min_by(F.struct("page_id", "url", "rows"), "page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first.page_id is not null").drop("n"), "payloads")
    key = F.coalesce(F.col("page_id"), F.lit(-(1 << 63) + 1))
    marks = (ids.join(first, "sha", "left").where("first is null or page_id is null or page_id <> first.page_id")
             .where("rows > 1 or first is not null").select("sha", key.alias("k"), "first", (F.col("rows") > 1).alias("equal"))
             .unionByName(ids.join(first, "sha").where("page_id = first.page_id and rows > 1").select("sha", key.alias("k"), F.lit(None).cast("struct<page_id: bigint, url: string, rows: bigint>").alias("first"), F.lit(True).alias("equal"))))
    j = (p.withColumn("k", key).join(marks, ["sha", "k"], "left")
         .select("page_id", "url", "html", "first", F.coalesce("equal", F.lit(False)).alias("equal")))

    def run(batches):
        from pyspark import TaskContext
        name, seen = f"pages-{TaskContext.get().partitionId()}", 0

        def records():
            nonlocal seen
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    rows = b.slice(lo, 64).to_pylist()
                    arc, at = [arc_version_block(arc_version, name, date)], 0
                    for r in rows:
                        page = "" if r["page_id"] is None else r["page_id"]
                        at += len(arc[-1])
                        arc.append(arc_record(arc_version, r["url"] or f"page:{page}", "0.0.0.0", date, "text/html",
                                              b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\nContent-Length: %d\r\n\r\n"
                                              % (str(page).encode(), len(r["html"])) + r["html"], at, name))
                    for r, (head, block) in zip(rows, iter_arc(b"".join(arc)), strict=True):
                        to, said = r["first"], None
                        if to is not None:
                            uri, day = to["url"] or f"page:{to['page_id']}", warc_date(date)
                            said = {"WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": day, "X-Refers-To-Page": str(to["page_id"])}
                            if to["rows"] == 1:
                                said["WARC-Refers-To"] = record_id(uri, day, base32_sha1(split_http(block)[1]), "response", f"page {to['page_id']}")
                        seen += 1
                        page = f"page {'' if r['page_id'] is None else r['page_id']}"
                        yield convert(head, block, f"{page} {name} {seen}" if r["equal"] else page, said)
        return _shards(records(), name)

    write_warc(j.mapInArrow(run, "shard binary"), path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC shards with digests checked: payload_bytes and
    payload_digest are of the full payload, for revisits as the record says."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("record_id", pa.string()),
                        ("record_date", pa.string()), ("refers_to_record", pa.string()), ("refers_to_uri", pa.string()), ("refers_to_date", pa.string())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for head, block in iter_warc(gunzip(b.column(0)[i].as_py())):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    http, payload = split_http(block) if head["content-type"].startswith("application/http") else (b"", block)
                    fields = dict(x.split(": ", 1) for x in http.decode("utf-8", "replace").strip().split("\r\n")[1:])
                    if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or kind != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"wrong digest in the record of {head['warc-target-uri']}")
                    rows.append({"page_id": int(x) if (x := fields.get("X-Page-Id")) else None,
                                 "payload_bytes": int(fields["Content-Length"]) if kind == "revisit" else len(payload),
                                 "payload_digest": digest, "record_type": kind, "target_uri": head["warc-target-uri"],
                                 "refers_to": int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None,
                                 "record_id": head["warc-record-id"], "record_date": head["warc-date"], "refers_to_record": head.get("warc-refers-to"),
                                 "refers_to_uri": head.get("warc-refers-to-target-uri"), "refers_to_date": head.get("warc-refers-to-date")})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, "
                             "record_id string, record_date string, refers_to_record string, refers_to_uri string, refers_to_date string"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page as a WARC record, read back."""
    path = scratch_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH h AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h),
b AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(x, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER)) AS twenty FROM f)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((twenty[CAST(k // 4 AS INTEGER) + 1] >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM b
"""
