"""Legacy ARC archives converted to WARC, with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm.tables import quoted, saved, shared_path
from tracegraph.operators.shared import salted_join

# Fixed values of the formats: header fields by ARC version, and the names WARC uses.
ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Bytes after which the next archive begins.
ARCHIVE_BYTES = 4 << 20
DATE = "20200101000000"
NAMESPACE = uuid.UUID(int=0)
# Repeated payloads are broadcast to the writers only below this many digests.
BROADCAST_DIGESTS = 100_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, bytes]], date: str = DATE) -> bytes:
    """An ARC file: version block, then (url, ip, date, mime, block) records."""

    def header(url, ip, when, mime, at, length):
        extra = ["200", "-", "-", str(at), name] if version == 2 else []
        return " ".join([url, ip, when, mime, *extra, str(length)]).encode() + b"\n"

    block = f"{version} 0 tracegraph\n{ARC_TITLES[version]}\n".encode()
    out = bytearray(header(f"filedesc://{name}", "0.0.0.0", date, "text/plain", 0, len(block)) + block + b"\n")
    for url, ip, when, mime, body in records:
        out += header(url, ip, when, mime, len(out), len(body)) + body + b"\n"
    return bytes(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, plain or gzipped member by member or whole.

    The version line of the first block says which fields a header line has. A URL may
    hold spaces: the fields after it are counted from the right. Bodies are taken by
    declared length, whatever they contain. At the first header that cannot be read, or
    a body shorter than declared, a last record with ``error`` is given.
    """
    if data[:2] == b"\x1f\x8b":
        plain, rest = bytearray(), data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                plain += member.decompress(rest)
            except zlib.error:
                break
            rest = member.unused_data
        data = bytes(plain)
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        if line.startswith("filedesc://") and stop >= 0:
            fields = ARC_FIELDS.get(2 if data[stop + 1 : stop + 2] == b"2" else 1)
        parts = line.rsplit(" ", len(fields) - 1)
        if stop < 0 or len(parts) != len(fields) or not parts[-1].isascii() or not parts[-1].isdigit():
            yield {"offset": at, "error": "header", "block": b""}
            return
        record = dict(zip(fields, parts)) | {"offset": at}
        length = int(record["length"])
        record["block"] = data[stop + 1 : stop + 1 + length]
        if len(record["block"]) < length:
            yield record | {"error": "truncated"}
            return
        if not line.startswith("filedesc://"):
            yield record | {"error": None}
        at = stop + 1 + length


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, header bytes, payload) of an HTTP response; without a status line all is payload."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return {}, b"", block
    lines = block[:cut].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, block[: cut + 4], block[cut + 4 :]


def warc_date(arc_date: str) -> str:
    """Fourteen or fewer digits as an ISO time; missing parts are the smallest."""
    digits = "".join(c for c in arc_date if c.isdigit())[:14]
    if len(digits) < 4:
        digits = "1970"
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def pages_to_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, content): gzipped ARC files with one record per page, versions 1 and 2 in turn.

    The identifier travels in the response's X-Page-Id field. Null html is an empty body, a
    null url ``unknown:``; line breaks in a url are percent-encoded.
    """
    source = pages.select(quoted(page_id).cast("long"), quoted(url).cast("string"), quoted(html).cast("string"))

    def run(batches):
        part, number, records, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"pages-{part:06d}-{number:06d}.arc.gz"
            content = zlib.compressobj(1, zlib.DEFLATED, 31)
            data = content.compress(arc_file(name, 1 + number % 2, records)) + content.flush()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], type=pa.binary())], ["archive", "content"])

        for batch in batches:
            for i, where, text in zip(*(c.to_pylist() for c in batch.columns)):
                body = (text or "").encode("utf-8")
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\n"
                head += "" if i is None else f"X-Page-Id: {i}\r\n"
                target = "unknown:" if where is None else where.replace("\n", "%0A").replace("\r", "%0D")
                records.append((target, "0.0.0.0", DATE, "text/html", (head + "\r\n").encode() + body))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, records, size = number + 1, [], 0
        if records:
            yield close()

    return source.mapInArrow(run, "archive string, content binary")


FIELDS = "record_id string, uri string, ip string, date string, mime string, error string, page_id long, payload_bytes long, payload_digest string"


def convert(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """WARC identities of all records of ARC files given as (archive, content).

    record_id is made from archive and offset, date from the ARC date, the digest is the
    SHA-1 of the payload. With ``blocks``, http_head and payload come along.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for r in read_arc(content or b""):
                    fields, head, payload = http_parts(r["block"])
                    number = fields.get("x-page-id", "")
                    rows.append((
                        f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}:{r["offset"]}')}>", r.get("url"), r.get("ip"), warc_date(r.get("date", "")),
                        r.get("mime"), r["error"], int(number) if number.lstrip("-").isdigit() else None, len(payload), sha1_base32(payload),
                        *([head, payload] if blocks else []),
                    ))
                columns = list(zip(*rows)) or [[]] * (len(names) + 2 * blocks)
                types = [pa.int64() if n in ("page_id", "payload_bytes") else pa.string() for n in names] + [pa.binary()] * 2 * blocks
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names + ["http_head", "payload"] * blocks)

    return archives.select("archive", "content").mapInArrow(run, FIELDS + (", http_head binary, payload binary" if blocks else ""))


def first_payloads(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(payload_digest, first_id, first_uri, first_date) of payloads that occur more than once.

    The first is the record with the smallest page_id; ties go by record_id.
    """
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)), F.col("record_id"))
    grouped = records.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("record_id", "uri", "date"), order).alias("f")
    )
    return grouped.filter("n > 1").select("payload_digest", F.col("f.record_id").alias("first_id"), F.col("f.uri").alias("first_uri"), F.col("f.date").alias("first_date"))


def warc_record(row: dict) -> str:
    """A record as text, up to the last line feed. Bodies that are not UTF-8 are written in base64 and say so."""
    revisit = row["first_id"] is not None and row["first_id"] != row["record_id"]
    block = row["http_head"] + (b"" if revisit else row["payload"])
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]), ("WARC-Payload-Digest", "sha1:" + row["payload_digest"]),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("WARC-Truncated", "length" if row["error"] else None),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["first_id"]),
            ("WARC-Refers-To-Target-URI", row["first_uri"]), ("WARC-Refers-To-Date", row["first_date"]),
        ]
    http = row["http_head"] or revisit
    fields.append(("Content-Type", "application/http; msgtype=response" if http else row["mime"] or "application/octet-stream"))
    try:
        body = block.decode("utf-8")
    except UnicodeDecodeError:
        block = base64.b64encode(block)
        body = block.decode()
        fields.append(("X-Block-Encoding", "base64"))
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{WARC_VERSION}\r\n{head}\r\n{body}\r\n\r"


def write_warc(archives: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Converts ARC files to gzipped WARC files below ``path``.

    Payloads of at least ``min_bytes`` that repeat become revisits of the record with the
    smallest page_id. The table of repeated digests is broadcast while it is small, and
    joined by shuffle beyond.
    """
    firsts = saved(first_payloads(convert(archives, blocks=False), min_bytes), "payloads")
    records = convert(archives)
    few = firsts.count() <= BROADCAST_DIGESTS
    joined = records.join(F.broadcast(firsts) if few else firsts, "payload_digest", "left")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in batch.slice(at, 200).to_pylist()], type=pa.string())], ["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def warc_stream(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of a WARC file, by declared lengths."""
    buffer, rest, member = bytearray(), data, zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(size: int) -> bool:
        nonlocal rest, member
        before = len(buffer)
        if member is None:
            buffer.extend(rest)
            rest = b""
        while member is not None and len(buffer) < size + before:
            if member.eof:
                rest = member.unused_data.lstrip(b"\0")
                if not rest:
                    break
                member = zlib.decompressobj(31)
            chunk = member.decompress(rest, 1 << 20)
            rest = member.unconsumed_tail
            buffer.extend(chunk)
            if not chunk and not member.eof:
                break
        return len(buffer) > before

    while True:
        while (cut := buffer.find(b"\r\n\r\n")) < 0 or not buffer.lstrip(b"\r\n"):
            if not more(1):
                return
        skipped = len(buffer) - len(buffer.lstrip(b"\r\n"))
        if skipped:
            del buffer[:skipped]
            continue
        lines = bytes(buffer[:cut]).decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields.get("content-length", "0"))
        while len(buffer) < cut + 4 + length:
            if not more(length):
                break
        block = bytes(buffer[cut + 4 : cut + 4 + length])
        del buffer[: cut + 4 + length]
        yield fields, base64.b64decode(block) if fields.get("x-block-encoding") == "base64" else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``.

    page_id, payload_bytes (of the full payload, also for revisits), payload_digest,
    record_type, record_id, refers_to_id, uri, date, intact: whether what is stored agrees
    with its digest.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, uri string, date string, intact boolean"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64()] * 2 + [pa.string()] * 6 + [pa.bool_()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_stream(content.as_py()):
                    http, _, payload = http_parts(block)
                    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    number, size = http.get("x-page-id", ""), http.get("content-length", "")
                    rows.append((
                        int(number) if number.lstrip("-").isdigit() else None, int(size) if kind == "revisit" and size.isdigit() else len(payload), digest, kind,
                        fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
                        fields.get("warc-block-digest") == "sha1:" + sha1_base32(block) and (kind == "revisit" or sha1_base32(payload) == digest),
                    ))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC files, and what those files hold.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, uri,
    date, record_id, intact. Of equal payloads the smallest page_id is the response (of rows
    that repeat it, one), a missing page_id comes last. Null html is an empty payload. An
    empty table gives no records. Other columns are ignored.
    """
    spark = pages.sparkSession
    archives = saved(pages_to_arc(pages, page_id, url, html), "arc")
    path = shared_path(spark, "warc")
    write_warc(archives, path, min_bytes)
    found = saved(read_warc(spark, path), "records")
    responses = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = salted_join(found.filter("record_type = 'revisit'"), responses, ["refers_to_id"], "left")
    plain = found.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date", "record_id", "intact"]
    return plain.select(columns).unionByName(revisits.select(columns))
