"""Legacy archive conversion: ARC (versions 1 and 2) to WARC, and WARC reading.

An ARC file opens with a version block that names the fields of every header
line; each record is such a line, and then as many bytes as its last field
declares.  Records are found by these lengths alone.  Each becomes a WARC
record with an identifier, timestamp, type and digests made from it alone, so a
task that runs again writes the same bytes.  Archives are written with Spark's
own text sink, a whole archive to a row and a row to a file, gzipped; so any
file system that Spark reaches will do.  An archive holds about ``ARCHIVE_BYTES``
and one record at most beyond that.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm.common import stored

ARCHIVE_BYTES = 16 << 20
#: Digests of repeated payloads (some 200 bytes each with the first record's address) that may be sent to every task.
SENT_DIGESTS = 50_000
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "url string, ip string, date string, content_type string, head binary, payload_z binary, payload_bytes long, digest string, page_id long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, date string, url string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(records: Iterable[tuple[str, str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, body) records."""
    block = f"{version} 0 probelake\n{ARC_FIELDS[version]}\n\n".encode()
    extra = lambda at: f" 200 - - {at} {name}" if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 20010101000000 text/plain{extra(0)} {len(block)}\n".encode() + block]
    at = len(out[0])
    for url, ip, date, kind, body in records:
        out.append(f"{url} {ip} {date} {kind}{extra(at)} {len(body)}\n".encode() + body + b"\n")
        at += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record but the version block."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    block = data[end + 1 : end + 1 + length]
    version, names = block.split(b"\n")[:2]
    fields = names.decode().split(" ")
    if int(version.split(b" ")[0]) not in ARC_FIELDS or fields[-1] != "Archive-length":
        raise ValueError("not an ARC version block")
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        head = dict(zip(fields, data[at:end].decode("utf-8").rsplit(" ", len(fields) - 1), strict=True))
        length = int(head["Archive-length"])
        if end + 1 + length > len(data):
            raise ValueError("an ARC record is cut short")
        yield head, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(name, content): ARC files that hold ``pages`` (page_id, url, html), as legacy input; versions alternate.

    A null html is an empty payload, a null url ``unknown:``; repeated rows are records of their own.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, n = [], 0, 0

        def flush() -> pd.DataFrame:
            name = f"pages-{n}.arc"
            return pd.DataFrame({"name": [name], "content": [arc_file(held, n % 2 + 1, name)]})

        for batch in batches:
            for page_id, url, html in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], strict=True):
                payload = (html or "").encode("utf-8")
                own = "" if page_id is pd.NA else str(page_id)
                date = datetime(2001, 1, 1) + timedelta(seconds=0 if not own else int(own) % 10**8)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {own}\r\nContent-Length: {len(payload)}\r\n\r\n"
                held.append(((url or "unknown:").replace(" ", "%20").replace("\n", "%0A"), "0.0.0.0", date.strftime("%Y%m%d%H%M%S"), "text/html", head.encode() + payload))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    return pages.select("page_id", "url", "html").mapInPandas(write, "name string, content binary")


def arc_records(archives: DataFrame) -> DataFrame:
    """The records of ARC files (name, content); gzipped content is unpacked.  payload_z is the deflated payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                rows = []
                for head, body in parse_arc(data):
                    http, _, payload = body.partition(b"\r\n\r\n")
                    own = next((x[11:].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), b"")
                    rows.append((head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], http, zlib.compress(payload, 1), len(payload), base32_sha1(payload), int(own) if own else None))
                    if len(rows) == 2000:
                        yield _frame(rows, RECORD)
                        rows = []
                yield _frame(rows, RECORD)

    return archives.select("name", "content").mapInPandas(read, RECORD)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith(" long")})


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_date(arc_date: str) -> str:
    """ISO 8601 time of an ARC date of 12 or 14 digits."""
    return datetime.strptime(arc_date.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert(archives: DataFrame, min_revisit: int = 0) -> DataFrame:
    """The records of ARC files with their WARC type: record_type, refers_to, first_url and first_date join the columns of ``arc_records``.

    Of records with equal payloads of at least ``min_revisit`` bytes the one with
    the largest page_id is the response and the others are revisits of it.  Records
    that share that page_id are all responses, as are those of a group without ids.
    """
    records = arc_records(archives)
    first = records.where(F.col("payload_bytes") >= min_revisit).where("page_id is not null").groupBy("digest", "payload_bytes")
    first = stored(first.agg(F.max(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # Payloads stay where they are if the digests of repeated ones are few enough to send.
    joined = records.join(F.broadcast(first) if first.count() <= SENT_DIGESTS else first, ["digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    old = lambda c, name: F.when(again, F.col(f"first.{c}")).alias(name)
    return joined.select("*", F.when(again, "revisit").otherwise("response").alias("record_type"), old("page_id", "refers_to"), old("url", "first_url"), old("date", "first_date")).drop("first")


def write_warc(records: DataFrame, path: str) -> None:
    """Write what ``convert`` gives as gzipped WARC files under ``path``; no records, no files.

    Records that are equal in page, address, date and payload have one identifier.
    """

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            body = b"".join(held)
            info = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(zlib.crc32(body)), "WARC-Date": "2001-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"software: probelake\r\nformat: WARC File Format 1.0\r\n")
            return pd.DataFrame({"value": [(info + body)[:-1]]})  # the sink adds the last line feed

        for batch in batches:
            for r in batch.itertuples(index=False):
                payload = zlib.decompress(r.payload_z)
                ref = None if pd.isna(r.refers_to) else int(r.refers_to)
                own = "" if pd.isna(r.page_id) else int(r.page_id)
                block = r.head + b"\r\n\r\n" + (payload if ref is None else b"")
                headers = {"WARC-Type": r.record_type, "WARC-Record-ID": record_id(r.url, r.date, own, r.digest), "WARC-Date": warc_date(r.date), "WARC-Target-URI": r.url, "WARC-IP-Address": r.ip}
                headers |= {"WARC-Payload-Digest": f"sha1:{r.digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "X-Payload-Length": str(len(payload)), "X-Page-Id": str(own)}
                if ref is not None:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(r.first_url, r.first_date, ref, r.digest)}
                    headers |= {"WARC-Refers-To-Target-URI": r.first_url, "WARC-Refers-To-Date": warc_date(r.first_date), "X-Refers-To-Page": str(ref)}
                held.append(warc_record(headers | {"Content-Type": "application/http; msgtype=response"}, block))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    out = records.mapInPandas(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; a wrong length, end or block digest is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        length = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if not version.startswith("WARC/") or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        if "WARC-Block-Digest" in head and head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("a WARC block does not have its digest")
        yield head, block
        at = end + 8 + length


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the WARC files under ``path``; a response's payload digest is verified."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for head, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)):
                    kind = head["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and base32_sha1(payload) != digest:
                        raise ValueError("a payload does not have its digest")
                    number = lambda k, head=head: int(head[k]) if head.get(k) else None
                    rows.append((number("X-Page-Id"), number("X-Payload-Length") if payload is None else len(payload), digest, kind, number("X-Refers-To-Page"), head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Date"], head["WARC-Target-URI"], payload if payloads else None))
                    if len(rows) == 2000:
                        yield _frame(rows, READ)
                        rows = []
                yield _frame(rows, READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(read, READ)
