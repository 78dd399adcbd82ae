"""WARC 1.1 archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own. The reader decompresses incrementally, cuts records by
Content-Length and verifies their digests. Archives are rows (archive, data), which Spark's writers
and readers bring to and from any store; `read_files` takes ordinary .warc.gz files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_BYTES, READ_BYTES, BATCH_ROWS, BATCH_BYTES = 4 << 20, 64 << 10, 1000, 8 << 20
PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, data binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, url: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A record as one gzip member. A revisit keeps the HTTP head, whose Content-Length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{PREFIX}{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PREFIX}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(text.encode() + block + b"\r\n\r\n") + press.flush()


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, html, refers_to, for each row. Of equal payloads of at least `min_bytes`, the smallest id isn't a revisit.

    A null payload is empty. Rows that repeat an id and a payload are alike: all of them responses if
    that id is the smallest. A null id is never the smallest unless it is the only one, and then a
    response. No rows give no rows; other columns are not read.
    Only digests are grouped, after being combined in each task; the join back can split a hot digest.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload"))
    same = pages.select(F.col(id_col).alias("page_id"), html.alias("html")).filter(F.octet_length("html") >= min_bytes)
    first = same.groupBy(F.sha2("html", 256).alias("payload")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first.drop("n"), "payload", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(records: DataFrame, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (archive, data) of about `archive_bytes` at most; a longer record has an archive of its own."""

    def write(batches):
        part, k, held = TaskContext.get().partitionId(), 0, bytearray()
        for batch in batches:
            for page, url, html, first in zip(*batch.columns, strict=True):
                page, first = page.as_py(), first.as_py()
                held += record("response" if first is None else "revisit", "" if page is None else str(page), url.as_py(), date, html.as_py().encode("utf-8", "surrogatepass"), None if first is None else str(first))
                if len(held) >= archive_bytes:
                    yield _archive(part, k, held)
                    k, held = k + 1, bytearray()
        if held:
            yield _archive(part, k, held)

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(write, ARCHIVES)


def _archive(part: int, k: int, held: bytearray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:04d}.warc.gz"]), pa.array([bytes(held)], pa.binary())], ["archive", "data"])


def read_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, in order, from pieces of an archive."""
    press, plain, rest = None, bytearray(), b""
    for raw in blocks:
        rest += raw
        while rest:
            press = press or zlib.decompressobj(31)
            plain += press.decompress(rest)
            rest = press.unused_data
            if not press.eof:
                rest = b""
                break
            press = None
            yield from _framed(plain)
    if press is not None:
        raise ValueError("the archive ends within a gzip member")
    if plain.strip():
        raise ValueError("the archive ends within a record")


def _framed(plain: bytearray) -> Iterator[tuple[dict[str, str], bytes]]:
    """Takes the whole records off the front of `plain`."""
    while (end := plain.find(b"\r\n\r\n")) >= 0:
        version, *lines = plain[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts with {version[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if len(plain) < end + 4 + size + 4:
            return
        block = bytes(plain[end + 4 : end + 4 + size])
        if plain[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record's block isn't as long as its Content-Length")
        del plain[: end + 8 + size]
        yield fields, block


def parse(fields: dict[str, str], block: bytes) -> dict:
    """A verified record: type, page, url, digest, payload_bytes, refers_to, payload (None in a revisit)."""
    if (told := fields.get("warc-block-digest")) and told != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"wrong block digest in {fields.get('warc-record-id')}")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and digest and digest != base32_sha1(payload):
        raise ValueError(f"wrong payload digest in {fields.get('warc-record-id')}")
    name = lambda x: x.strip("<>").removeprefix(PREFIX) or None if x else None
    return {
        "page": name(fields.get("warc-record-id")), "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "record_type": kind,
        "payload_digest": digest or base32_sha1(payload), "payload_bytes": int(http.get("content-length", len(payload))) if kind == "revisit" else len(payload),
        "refers_to": name(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else payload,
    }


READ = "page string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each response or revisit record: READ, and payload (binary) if asked for."""
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches):
        for batch in batches:
            rows, size = [], 0
            for data in batch.column(0):
                view = memoryview(data.as_buffer())
                for fields, block in read_records(bytes(view[i : i + READ_BYTES]) for i in range(0, len(view), READ_BYTES)):
                    if fields.get("warc-type") in ("response", "revisit"):
                        rows.append(parse(fields, block))
                        size += len(block) * payloads
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _rows(rows, names, kinds)
                            rows, size = [], 0
            if rows:
                yield _rows(rows, names, kinds)

    return archives.select("data").mapInArrow(read, READ + ", payload binary" * payloads)


def _rows(rows: list[dict], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives (archive, data) from .warc.gz files at `path`, in any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("archive"), F.col("content").alias("data"))


def write_files(archives: DataFrame, folder: str) -> None:
    """One file for each archive, in a folder that all executors have mounted."""

    def write(rows):
        import os

        for row in rows:
            with open(os.path.join(folder, row["archive"]), "wb") as out:
                out.write(row["data"])

    archives.foreachPartition(write)
