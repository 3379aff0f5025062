import base64
import gzip
import hashlib
import io
import tracemalloc
import zlib

import pytest

from newsloom.llm import warc as W
from newsloom.llm.common import shared_path


def pages(spark, *rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def archive(spark, rows, **how):
    return W.write_archives(pages(spark, *rows), shared_path(spark, "warc"), **how)


def parsed(member):
    record = W.Record()
    record.feed(member)
    return record.row()


def test_round_trip(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, None), (8, "u8", ""), (1, "u\n1", "é😀"), (None, "n", "same"), (7, "a", "twin"), (7, "a", "twin"), (7, "b", "twin"), (2, "big", "x" * 300_000)]
    got = W.read_archives(archive(spark, rows)).collect()
    assert len(got) == len(rows) and not any(r.problem for r in got)
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() and len(r.payload) == r.payload_bytes and r.refers_to is None
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert {r.url for r in got if r.page_id == 1} == {"u%0A1"}
    assert kinds == sorted([("5", "revisit", 3, 4), ("3", "response", None, 4), ("9", "revisit", 8, 0), ("8", "response", None, 0), ("1", "response", None, 6), ("None", "revisit", 3, 4), ("7", "response", None, 4), ("7", "revisit", 7, 4), ("7", "revisit", 7, 4), ("2", "response", None, 300_000)])


def test_smaller_payloads_are_all_responses(spark):
    got = W.read_archives(archive(spark, [(1, "", "ab"), (2, "", "ab"), (3, "", "abcd"), (4, "", "abcd")], min_bytes=3), payloads=False).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_and_rolled_over(spark):
    assert W.read_archives(archive(spark, [])).count() == 0
    manifest = archive(spark, [(i, "", f"page {i}" * 50) for i in range(40)], archive_bytes=500)
    assert manifest.count() > 4 and W.read_archives(manifest).count() == 40


def test_each_record_is_a_member():
    data = b"".join(W.record_bytes(i, "u", b"payload %d" % i, None, False) for i in range(3))
    assert [r["problem"] for r in W.records(io.BytesIO(data))] == [None] * 3 and gzip.decompress(data).count(b"WARC/1.1") == 3


def test_damaged_archives_are_told_not_raised():
    data = b"".join(W.record_bytes(i, "u", b"payload %d" % i, None, False) for i in range(3))
    one = len(W.record_bytes(0, "u", b"payload 0", None, False))
    problems = lambda d: [r["problem"] for r in W.records(io.BytesIO(d))]
    assert problems(data[:-5]) == [None, None, "cut member"]
    assert problems(data[:one] + b"junk" * 9) == [None, "damaged member"]
    assert problems(b"") == [] and problems(b"no archive at all") == ["damaged member"]
    assert problems(gzip.compress(b"WARC/1.1\r\n" + b"a" * (W.HEADER_BYTES + 5)) + data) == ["no record header", None, None, None]


class Zeros:
    """A record of very many zeros as a file that makes its pieces when they are read."""

    def __init__(self, n, piece=1 << 20):
        z, digest, zeros = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), bytes(piece)
        for _ in range(n // piece):
            digest.update(zeros)
        self.digest = base64.b32encode(digest.digest()).decode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{W.PREFIX}7>\r\nWARC-Payload-Digest: sha1:{self.digest}\r\nWARC-Payload-Length: {n}\r\nContent-Length: {n}\r\n\r\n"

        def pieces():
            yield z.compress(head.encode())
            for _ in range(n // piece):
                yield z.compress(zeros)
            yield z.compress(b"\r\n\r\n") + z.flush()

        self.pieces = pieces()
        self.rest = b""

    def read(self, n):
        while len(self.rest) < n and (piece := next(self.pieces, None)) is not None:
            self.rest += piece
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def test_records_of_any_length_are_verified():
    """What is kept is bounded, what is read isn't: a record longer than any cell has its header, length and digest."""
    tracemalloc.start()
    stream = Zeros(W.PAYLOAD_BYTES + (64 << 20))
    (row,) = W.records(stream, keep=1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (row["page_id"], row["problem"], row["payload_digest"], row["payload"]) == (7, None, stream.digest, None) and row["payload_bytes"] > W.PAYLOAD_BYTES
    assert peak < 16 << 20


@pytest.mark.parametrize("keep", [0, 199_999, 200_000])
def test_payloads_over_the_bound_are_null(keep):
    data = W.record_bytes(7, "u", b"x" * 200_000, None, False) + W.record_bytes(8, "u", b"", None, False)
    long, empty = W.records(io.BytesIO(data), keep)
    assert long["problem"] is empty["problem"] is None and empty["payload"] == b"" and long["payload_bytes"] == 200_000
    assert long["payload"] == (b"x" * 200_000 if keep == 200_000 else None)


@pytest.mark.parametrize("step", [1, 3, 50, 10_000])
def test_pieces_of_any_length(step):
    """Headers, blocks and ends may be cut anywhere."""
    member = gzip.decompress(W.record_bytes(7, "u", b"a\r\n\r\nb" * 9, None, False))
    for m in (member, member[:-1], member + b"\r", member.replace(b"a", b"b"), member[:40], b""):
        record = W.Record()
        for i in range(0, len(m), step):
            record.feed(m[i : i + step])
        assert record.row() == parsed(m)
    assert parsed(member)["payload"] == b"a\r\n\r\nb" * 9


def test_headers_of_other_writers():
    def member(**fields):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\n{head}\r\npayload\r\n\r\n".encode()

    uuid = "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"
    row = parsed(member(WARC_Type="response", WARC_Record_ID=uuid, Content_Length=7))
    assert (row["page_id"], row["payload"], row["problem"], row["payload_bytes"]) == (None, b"payload", None, 7)
    for length in ("x", "", "-1", "8", "99999999999999999999"):
        assert parsed(member(WARC_Type="response", Content_Length=length))["problem"] == "content length"
    assert parsed(member(WARC_Type="warcinfo"))["problem"] == "content length"
    assert parsed(b"")["problem"] == "no record header" == parsed(b"\xff\xfe\r\n\r\n")["problem"]


@pytest.mark.parametrize(("old", "new", "problem"), [(b"payload 0", b"payload 1", "block digest"), (b"WARC/1.1", b"HTTP/1.1", "no record header"), (b"Content-Length: 9", b"Content-Length: 8", "content length")])
def test_damage_is_told(old, new, problem):
    member = gzip.decompress(W.record_bytes(0, "u", b"payload 0", None, False))
    assert parsed(member)["problem"] is None
    assert parsed(member.replace(old, new))["problem"] == problem
