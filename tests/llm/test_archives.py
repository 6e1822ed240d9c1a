"""Archives: round trip of pages, reassembly, framing, and what is refused."""

import base64
import glob
import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from paritas.llm import archives as A
from paritas.llm.queries import ORACLE


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if len(data) >= 1000 and (h or "").encode() == data]
        newest = max((p for p in same if p is not None), default=None)
        revisit = newest is not None and page_id != newest
        out.append(
            (
                page_id,
                len(data),
                hashlib.sha1(data).hexdigest(),
                "revisit" if revisit else "response",
                newest if revisit else None,
            )
        )
    return sorted(out, key=str)


LONG = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc日🙂" * 2000
ROWS = [
    (1, "http://a/", "x" * 1000),
    (2, "http://a/\r\nInjected: y", "x" * 1000),
    (3, None, "x" * 999),
    (4, None, "x" * 999),
    (5, "u", None),
    (6, "u", ""),
    (7, "u", LONG),
    (8, "u", LONG),
    (8, "u", LONG),
    (9, "u", LONG + "!"),
    (-4, "u", "\r\n" * 3000),
    (None, "u", "n" * 20000),
    (None, "u", LONG),
    (2**62, "u", "0\r\n\r\n"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    df = df.withColumn("block", F.lit("b")).withColumn("payload_digest", F.lit(1))
    assert sorted((tuple(r) for r in A.archived(df).collect()), key=str) == expected(ROWS)
    assert A.archived(df.limit(0)).count() == 0


def test_payloads_and_plain_archives(spark, tmp_path):
    rows = [r for r in ROWS if r[0] != 8]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    A.write_archives(df, str(tmp_path / "w"), compressed=False)
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/w/part-*"))
    kinds = [h["warc-type"] for h, _ in A.parsed(data)]
    assert kinds.count("continuation") > 10 and "revisit" in kinds
    whole = A.with_payloads(A.reassembled(A.archive_records(spark, str(tmp_path / "w"))))
    found = sorted(bytes(r.payload).decode() for r in whole.collect() if r.kind == "response")
    kept = sorted((h or "") for p, _, h in rows if p != 1 and not (p is None and h == LONG))
    assert found == kept


def test_segments_from_several_archives(spark, tmp_path):
    def record(kind, name, block, *lines):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *lines]
        head.append(f"Content-Length: {len(block)}")
        return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n2\r\n\xc3\xa9\r\n0\r\n\r\n"
    origin = "WARC-Segment-Origin-ID: <urn:x-page:5:0>"
    digest = f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'abc' + 'é'.encode()).hexdigest()}"
    parts = [
        record("response", "urn:x-page:5:0", body[:50], "WARC-Segment-Number: 1", digest),
        record("continuation", "b", body[50:58], "WARC-Segment-Number: 2", origin),
        record(
            "continuation",
            "c",
            body[58:],
            "WARC-Segment-Number: 3",
            f"WARC-Segment-Total-Length: {len(body)}",
            origin,
        ),
    ]
    folder = tmp_path / "several"
    folder.mkdir()
    for i, part in enumerate([parts[2], parts[0], parts[1]]):  # members one by one
        (folder / f"{i}.warc.gz").write_bytes(gzip.compress(part))
    (row,) = A.page_records(spark, str(folder)).collect()
    assert (row.page_id, row.payload_bytes, row.record_type) == (5, 5, "response")
    for name, left in (("gap", [parts[0], parts[2]]), ("short", parts[:2])):
        broken = tmp_path / name
        broken.mkdir()
        (broken / "all.warc").write_bytes(b"".join(left))
        with pytest.raises(Exception, match="segment|long as it says"):
            A.page_records(spark, str(broken)).collect()


def foreign(name, content, *lines):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + content
    head = ["WARC-Type: response", f"WARC-Record-ID: <urn:x-page:{name}:0>", *lines]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_digests_of_other_writers(spark, tmp_path):
    b32 = base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    long = hashlib.sha256(b"three").hexdigest()
    data = [
        foreign(1, b"one", f"WARC-Payload-Digest: sha1:{b32}"),
        foreign(2, b"two", f"WARC-Payload-Digest: SHA-1:{hashlib.sha1(b'two').hexdigest().upper()}"),
        foreign(3, b"three", f"WARC-Payload-Digest: sha256:{long}"),
        foreign(4, b"four", "WARC-Payload-Digest: blake9:xyz"),
        foreign(5, b"five"),
    ]
    (tmp_path / "all.warc").write_bytes(b"".join(data))
    found = {r.page_id: r for r in A.page_records(spark, str(tmp_path)).collect()}
    assert {p: r.payload_bytes for p, r in found.items()} == {1: 3, 2: 3, 3: 5, 4: 4, 5: 4}
    assert found[1].payload_digest == hashlib.sha1(b"one").hexdigest()
    assert found[2].payload_digest == hashlib.sha1(b"two").hexdigest()
    assert found[3].payload_digest == f"sha256:{long}" and found[5].payload_digest is None


def test_damaged_records_have_an_error(spark, tmp_path):
    good, wrong = foreign(1, b"one"), foreign(2, b"two", "WARC-Payload-Digest: sha1:ABC")
    chunked = foreign(3, b"").replace(b"OK\r\n", b"OK\r\nTransfer-Encoding: chunked\r\n")
    chunked = chunked.replace(b"Content-Length: 19", b"Content-Length: 47")
    part = foreign(4, b"x" * 40, "WARC-Segment-Number: 1")
    files = {
        "a.warc": good + wrong + chunked + part,
        "b.warc": foreign(5, b"five") + foreign(6, b"x" * 90)[:-50],
        "c.warc.gz": gzip.compress(foreign(7, b"seven")) + gzip.compress(foreign(8, b"8"))[:-30],
        "d.warc": b"no archive",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = A.page_records(spark, str(tmp_path), keep_damaged=True).collect()
    assert {r.page_id for r in rows if r.error is None} == {1, 5, 7}
    bad = [r for r in rows if r.error]
    assert {r.page_id for r in bad if r.page_id} == {2, 3, 4}
    assert len(bad) == 6 and all(r.payload_bytes is None for r in bad)
    with pytest.raises(Exception, match="digest|chunk|segment|long as|cut off|record"):
        A.page_records(spark, str(tmp_path)).collect()


def test_framing_is_checked():
    assert A.unchunked(b"0\r\n\r\n") == b""
    for broken in (b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"zz"):
        with pytest.raises(ValueError):
            A.unchunked(broken)
    with pytest.raises(ValueError, match="cut off"):
        list(A.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_pages_against_sql(spark, mini):
    pages = spark.read.parquet(f"{mini}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"create view pages as from '{mini}/pages.parquet'")
    rows = db.sql(ORACLE["op10_archives"]).fetchall()
    assert sorted(map(tuple, A.archived(pages).collect())) == sorted(rows)
