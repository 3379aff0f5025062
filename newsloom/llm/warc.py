"""WARC archives: a writer, and a sequential reader that verifies what it reads.

Each record is a gzip member of its own. The reader goes through an archive once, in
blocks: it inflates member after member with an incremental zlib object, takes the
header up to the blank line, frames the block by Content-Length, and checks the block
and payload digests as the block goes by, so a record of any length is read and verified. The
reader holds a header, a piece of input and, where payloads are asked for, one payload; one of over
``PAYLOAD_BYTES``, which no cell of a table holds, is returned as null beside its verified digest.
What doesn't hold is told in the column ``problem`` and never fails the job: a damaged or cut
member (reading of that archive ends there, as nothing tells where the next begins), a header
that isn't WARC's or has over ``HEADER_BYTES``, lengths and digests that differ. Identifiers
of other writers are read as a null page_id.

Archives lie in the shared folder, under a name of the task attempt that wrote them;
the manifest, written when all are done, lists the archives of the attempts that count,
so a retried or doubled task leaves at most a file that nobody reads.

Defined results: a null html is an empty payload; of records with equal payloads of at
least ``min_bytes`` bytes the one with the smallest page_id (nulls last) is the
response, the others revisit it; repeated rows of that page_id are told apart by url, and of
those alike in all just one is the response; control characters of a url are written as
percent codes; an empty table gives no archives and no rows; extra columns are left out of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

BLOCK = 1 << 16
#: A new archive is begun after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: A longer payload is verified, but returned as null.
PAYLOAD_BYTES = 1 << 30
HEADER_BYTES = 1 << 20
BLANK = b"\r\n\r\n"
PREFIX = "urn:newsloom:page:"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"
INDEX = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, problem string"


def filesystem(path: str):
    """The file system of a path and the path in it; paths may be URIs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_url(url: str | None) -> str:
    """A url for a header line."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]", lambda m: quote(m[0]), url or "")


def record_bytes(page_id, url, payload: bytes | None, refers_to, revisit: bool, digest: str | None = None, size: int | None = None) -> bytes:
    """One gzip member holding one WARC/1.1 record; digest and size of the full payload may be given."""
    block = b"" if revisit else payload
    digest, size = digest or sha1_32(payload), len(payload) if size is None else size
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", plain_url(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"),
        ("WARC-Payload-Length", str(size)),
    ]
    if revisit:
        fields.append(("WARC-Refers-To", f"<{PREFIX}{'' if refers_to is None else refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields.append(("Content-Type", "text/html; charset=utf-8"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (bytes), size, refers_to and is_first, which is false for revisits; those have no payload.

    Payloads are grouped by digest with partial aggregation, so copies are shuffled at most once a task. The pages that
    share one, without it, meet its response in an equi-join of plain shuffles, of which adaptive execution splits a hot digest.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    page = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "url").alias("page")
    first = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.min(page).alias("page"), F.first("payload").alias("payload"), F.first("size").alias("size"), F.count("*").alias("n")
    )
    first = stored(first, "payloads")
    none = F.lit(None)
    responses = first.select("page.page_id", "page.url", "payload", "digest", "size", none.cast("long").alias("refers_to"), F.lit(True).alias("is_first"))
    small = rows.where(F.col("size") < min_bytes).select("page_id", "url", "payload", "digest", "size", none.cast("long").alias("refers_to"), F.lit(True).alias("is_first"))
    repeated = first.where("n > 1").select("digest", F.col("page").alias("first"))
    met = rows.select("page_id", "url", "digest", "size", page).join(repeated, "digest")
    others = met.where(~F.col("page").eqNullSafe(F.col("first"))).select("page_id", "url", "digest", "size", F.col("first.page_id").alias("refers_to"), F.lit(1).alias("n"))
    # rows that are the response's in all: one of them is it, the rest are as many revisits less one
    alike = met.where(F.col("page").eqNullSafe(F.col("first"))).groupBy("digest", "page_id", "url", "size").agg((F.count("*") - 1).cast("int").alias("n")).where("n > 0")
    alike = alike.select("page_id", "url", "digest", "size", F.col("page_id").alias("refers_to"), "n")
    revisits = others.unionByName(alike.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))))
    revisits = revisits.select("page_id", "url", none.cast("binary").alias("payload"), "digest", "size", "refers_to", F.lit(False).alias("is_first"))
    whole = responses.unionByName(small) if min_bytes else responses
    return whole.unionByName(revisits)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages under folder; returns the manifest, one row per archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        out = path = None
        records = size = 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [path], "records": [records], "bytes": [size]},
                pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
            )

        for batch in batches:
            for page_id, url, payload, digest, length, refers_to, is_first in zip(
                *(batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to", "is_first")), strict=True
            ):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records, size = f"{folder}/{name}", 0, 0
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                first = is_first.as_py()
                data = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), not first, base64.b32encode(digest.as_py()).decode(), length.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    listed = with_revisits(pages, min_bytes).mapInArrow(write, MANIFEST)
    listed.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Record:
    """A record that comes in pieces: its header is kept, its block goes through a digest and is kept up to ``keep`` bytes."""

    def __init__(self, keep: int = PAYLOAD_BYTES):
        self.keep, self.head, self.fields, self.framed = keep, b"", None, False
        self.length = self.left = None
        self.size, self.block, self.tail, self.digest = 0, [], b"", hashlib.sha1()

    def feed(self, piece: bytes) -> None:
        if self.fields is None:
            head, found, rest = (self.head + piece).partition(BLANK)
            if not found and len(head) <= HEADER_BYTES:
                self.head = head
                return
            self._begin(head, bool(found))
            piece = rest
        part, rest = piece[: self.left], piece[self.left :]
        self.left, self.size = self.left - len(part), self.size + len(part)
        self.digest.update(part)
        if self.size > self.keep:
            self.block = None
        elif part:
            self.block.append(part)
        self.tail = (self.tail + rest[:5])[:5]

    def _begin(self, head: bytes, found: bool) -> None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        self.framed = found and lines[0].startswith("WARC/")
        self.length = self._number("content-length")
        self.left, self.head = self.length or 0, b""

    def _number(self, name: str, pattern: str = r"(\d{1,18})") -> int | None:
        m = re.fullmatch(pattern, self.fields.get(name, ""))
        return int(m[1]) if m else None

    def row(self, problem: str | None = None) -> dict:
        """The fields of RECORDS; problem says what didn't hold, or is null."""
        if self.fields is None:
            self._begin(self.head, False)
        fields, found = self.fields, base64.b32encode(self.digest.digest()).decode()
        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        damaged = problem is not None
        if damaged:
            pass
        elif not self.framed:
            problem = "no record header"
        elif self.length is None or self.left or self.tail != BLANK:
            problem = "content length"
        elif fields.get("warc-block-digest", f"sha1:{found}") != f"sha1:{found}":
            problem = "block digest"
        elif kind == "response" and "warc-payload-length" in fields and digest != found:
            problem = "payload digest"
        size, page = self._number("warc-payload-length"), rf"<?{PREFIX}(-?\d{{1,18}})>?"
        payload = b"" if damaged else None if self.block is None else b"".join(self.block)
        return {
            "page_id": self._number("warc-record-id", page), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": (0 if damaged else self.size) if size is None else size, "payload_digest": digest,
            "refers_to": self._number("warc-refers-to", page), "payload": payload, "problem": problem,
        }


def records(stream, keep: int = PAYLOAD_BYTES) -> Iterator[dict]:
    """The records of a stream of gzip members, which is read and inflated piece by piece."""
    z, record, data = zlib.decompressobj(31), Record(keep), b""
    begun = False
    while True:
        data = data or stream.read(BLOCK)
        if not data:
            if begun:
                yield record.row("cut member")
            return
        begun = True
        try:
            piece = z.decompress(data, BLOCK)
        except zlib.error:
            yield record.row("damaged member")
            return
        record.feed(piece)
        if z.eof:
            yield record.row()
            data = z.unused_data
            z, record, begun = zlib.decompressobj(31), Record(keep), bool(data)
        else:
            data = z.unconsumed_tail


def read_archives(manifest: DataFrame, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives that a DataFrame with a column path lists, one task row per archive."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else []), ("problem", pa.string())
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = filesystem(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for row in records(stream, PAYLOAD_BYTES if payloads else 0):
                        payload = row["payload"] if payloads else row.pop("payload")
                        rows.append(row)
                        size += 200 + len(payload or b"")
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").mapInArrow(read, RECORDS if payloads else INDEX)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, shared_path(spark, "warc"))
    records = read_archives(manifest, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def _base32_sql(hexed: str) -> str:
    """Five hex digits are four base32 digits."""
    part = f"('0x' || substr({hexed}, 1 + 5 * (i // 4), 5))::BIGINT"
    return f"list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({part} >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '')"


SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hexed FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY hexed) AS first_id FROM p
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, {_base32_sql("hexed")} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       NULL::VARCHAR AS problem
FROM g"""
