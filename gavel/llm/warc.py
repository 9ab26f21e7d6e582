"""WARC archives: writer and sequential reader.

The writer makes one record of every page, one gzip member of every record, and
appends members to archives of about ARCHIVE_BYTES. Of pages with equal payloads
the one with the smallest id is a response, the others are revisits that refer to
it and carry the HTTP head alone. Spark's text writer puts the archives down as
files: a member ends in the highest byte of its size, zero below 16 MB, and that
byte is the writer's line separator; a larger record is followed by an empty
member, which ends in zero too.

The reader takes an archive from front to back: it inflates members bit by bit,
frames each record by its Content-Length and verifies block and payload digests.
It is a generator, so it holds one record at a time.

Only pages of which an equal payload exists meet in a join, on digests; the
payloads themselves are not shuffled while that table is small.

Defined cases: a null payload is empty; a null id counts as the largest and is
read back as null; rows that repeat id and payload share one response, which the
others revisit; a null URL has no Target-URI, control characters in URLs are
percent-encoded; an empty table gives no archives and an empty result; extra
columns are left out. A damaged or truncated archive raises.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.llm.decontaminate import checked_broadcast
from gavel.session import scratch_dir

ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
BROADCAST_ROWS = 300_000  # digests that are shared
RECORD_COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; `digest` (SHA-1) and `size` are those of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url))
    if revisit:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_uri(refers_to)}",
        ]
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """`data` as gzip that ends in a zero byte."""
    packed = gzip.compress(data, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def members(archive: bytes) -> Iterator[bytes]:
    """The inflated gzip members of an archive that are not empty, one at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(wbits=31), []
        while not inflate.eof:
            chunk = view[at : at + CHUNK]
            if not chunk:
                raise ValueError("the archive ends inside a member")
            parts.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        if data := b"".join(parts):
            yield data


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record, framed by its length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the record is not {size} bytes long")
    return fields, rest[:size]


def read_archive(archive: bytes) -> Iterator[dict]:
    """The records of an archive with payload, size, digest, type and reference, all verified."""
    for data in members(archive):
        fields, block = parse_record(data)
        if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"wrong block digest in {fields['warc-record-id']}")
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
        revisit, digest = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (digest != sha1_base32(payload) or int(http["content-length"]) != len(payload)):
            raise ValueError(f"wrong payload in {fields['warc-record-id']}")
        yield {
            "page_id": _page_id(fields["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": _page_id(fields["warc-refers-to"]) if revisit else None,
            "url": fields.get("warc-target-uri"), "payload": None if revisit else payload,
        }


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, revisit and refers_to: what is to be written of every page."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    own = rows.groupBy("digest", "page_id").agg(F.count("*").alias("same"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "same")).alias("first")
    shared = own.groupBy("digest").agg(first, F.sum("same").alias("n")).where("n > 1")
    shared = shared.select(F.col("digest").alias("shared"), F.col("first.page_id").alias("refers_to"), F.col("first.same").alias("same"))
    marked = rows.join(checked_broadcast(shared, BROADCAST_ROWS), F.col("digest") == F.col("shared"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("refers_to"))
    fields = ["page_id", "url", "payload", "digest"]
    plain = marked.where("shared is null or same = 1 or not (page_id <=> refers_to)")
    plain = plain.select(*fields, (F.col("shared").isNotNull() & ~is_first).alias("revisit"), "refers_to")
    if shared.where("same > 1").isEmpty():
        return plain
    turn = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("url").asc_nulls_last()))
    again = marked.where("shared is not null and same > 1 and page_id <=> refers_to")
    return plain.union(again.select(*fields, (turn > 1).alias("revisit"), "refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages as WARC files below the folder `path`, without a shuffle of payloads."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, filled = 0, 0
        for part in parts:
            for at in range(0, part.num_rows, 64):
                archives, packed = [], []
                for row in part.slice(at, 64).to_pylist():
                    size = len(row["payload"])
                    data = member(record(row["page_id"], row["url"], row["payload"], row["digest"], size, row["refers_to"], row["revisit"]))
                    if filled and filled + len(data) > archive_bytes:
                        archive, filled = archive + 1, 0
                    filled += len(data)
                    archives.append(archive)
                    packed.append(data[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(archives, pa.int32()), pa.array(packed, pa.binary()).view(pa.string())], ["archive", "value"]
                )

    rows = plan_records(pages).mapInArrow(batches, "archive int, value string")
    rows.write.partitionBy("archive").option("lineSep", "\0").option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below `path`; with `payloads`, url and payload too."""
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")] + (["url", "payload"] if payloads else [])
    schema = RECORD_COLUMNS + (", url string, payload binary" if payloads else "")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in schema.split(", "))])
        for part in parts:
            for archive in part.column("content"):
                rows = []
                for found in read_archive(archive.as_py()):
                    rows.append({n: found[n] for n in names})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(batches, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
