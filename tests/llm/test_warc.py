"""Archives against the pages they were made of, the format's own rules, and broken files."""

import base64
import gzip
import hashlib
import re
import uuid

import duckdb
import pytest

from litgrid.llm import warc as W
from litgrid.session import shared_folder

SCHEMA = "page_id long, url string, html string, digest string, first int, hot string, data string, last int"
TRICKY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a.example/", "<p>one</p>"),
    (2, "http://a.example/2", None),
    (3, None, ""),
    (4, "", "<p>one</p>"),
    (5, "http://b.example/ä ö\r\nWARC-Type: x", TRICKY),
    (6, "http://b.example/6", "\r\n\r\n\n\r" + TRICKY * 3),
    (7, "http://b.example/7", "ü😀\x00\x0b" * 5000),
    (7, "http://b.example/other", "same id, another payload"),
    (8, "http://c.example/8", "ü😀\x00\x0b" * 5000),
    (9, "http://c.example/9", "<p>one</p>"),
    (9, "http://c.example/9", "<p>one</p>"),
    (None, "http://d.example/", "no id"),
    (None, "http://d.example/", "no id"),
    (None, None, "<p>one</p>"),
    (-3, "http://e.example/", "x" * 70_000),
    (10, "http://e.example/10", "ends with a line\r\n"),
]


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def table(spark, pages=PAGES, parts=3):
    return spark.createDataFrame([(*p, "d", 1, "h", "x", 2) for p in pages], SCHEMA).repartition(parts)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def wanted(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        f = first.get(html or "")
        revisit = f is not None and f != i
        out.append((i, len((html or "").encode()), sha1(html), "revisit" if revisit else "response", f if revisit else None, True))
    return sorted(out, key=repr)


def read(df):
    return sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 1000, 7])
@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_round_trip(spark, chunk, broadcast):
    at = folder(spark)
    pages = [p for p in PAGES if chunk > 7 or len(p[2] or "") < 5000]
    W.write_archives(table(spark, pages), at, chunk, broadcast_bytes=broadcast)
    assert read(W.read_records(spark, at)) == wanted(pages)
    assert read(W.read_records(spark, at, 13)) == wanted(pages)


def test_hot_payload_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 4)
    pages = [(k, None, "hot") for k in range(40)] + [(100 + k, None, f"t{k // 2}") for k in range(40)] + [(None, None, "hot")]
    at = folder(spark)
    W.write_archives(table(spark, pages), at, broadcast_bytes=0)
    assert read(W.read_records(spark, at)) == wanted(pages)


def plain_records(folder_path):
    """Every record by the format's rules alone: headers, block."""
    import pathlib

    for f in sorted(pathlib.Path(folder_path.removeprefix("file:")).glob("*.gz")):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            yield fields, rest[:n]
            data = rest[n + 4 :]


def test_files_keep_the_format(spark):
    at = folder(spark)
    W.write_archives(table(spark), at, 1000)
    records = list(plain_records(at))
    whole, lengths = {}, {}
    for fields, block in records:
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert re.fullmatch(r"[\x21-\x7e]+", fields.get("WARC-Target-URI", "x"))
        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        if fields["WARC-Type"] == "continuation":
            assert int(fields["WARC-Segment-Number"]) == len(whole[origin]) + 1
            whole[origin].append(block)
            if "WARC-Segment-Total-Length" in fields:
                lengths[origin] = int(fields["WARC-Segment-Total-Length"])
        else:
            whole[origin] = [block]
        assert len(block) <= 1000 + 200
    assert lengths and all(len(b"".join(whole[o])) == n for o, n in lengths.items())
    body = b"".join(whole["<urn:page:-3>"])
    assert body.endswith(b"\r\n\r\n" + b"x" * 70_000) and f"Content-Length: {70_000}\r\n".encode() in body
    revisits = [f for f, _ in records if f["WARC-Type"] == "revisit"]
    assert {f["WARC-Profile"] for f in revisits} == {W.REVISIT} and all("WARC-Refers-To" in f for f in revisits)


def test_chunks_give_the_payload_back(spark):
    at = folder(spark)
    W.write_archives(table(spark), at, 1000)
    rows = W.read_chunks(spark, at, 300).collect()
    assert max(r["n_bytes"] for r in rows) <= 300
    for page, html in ((-3, "x" * 70_000), (6, PAGES[5][2]), (5, TRICKY)):
        own = sorted((r for r in rows if r["page_id"] == page), key=lambda r: r["chunk_no"])
        assert [r["chunk_no"] for r in own] == list(range(len(own))) and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        data = b""
        for r in own:
            data += bytes(r["data"])
            assert r["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert data == html.encode()


def archive(*records):
    return b"".join(records)


def record(body, kind="resource", extra="", length=None):
    n = len(body) if length is None else length
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\n{extra}Content-Length: {n}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_broken_files(size):
    def rows(data):
        p, out = W._Parser("f", 1 << 20, True), []
        for k in range(0, len(data), size):
            out += p.feed(data[k : k + size])
        return [(r["record_type"], bytes(r["data"]), r["intact"]) for r in out + p.end() if r["last"]]

    good = record(b"fine")
    assert rows(good) == [("resource", b"fine", True)]
    assert rows(good + record(b"cut" * 20, length=100)[:-4]) == [("resource", b"fine", True), ("resource", b"cut" * 20, False)]
    assert rows(good + record(b"cut")[:30]) == [("resource", b"fine", True), ("broken", b"", False)]
    assert rows(b"garbage\r\n\r\n" + good) == [("broken", b"", False), ("resource", b"fine", True)]
    assert rows(good + b"WARC/1.1\r\nWARC-Type: x\r\n\r\nno length\r\n\r\n" + good) == [("resource", b"fine", True), ("broken", b"", False), ("resource", b"fine", True)]
    assert rows(record(b"wrong", extra="WARC-Payload-Digest: sha1:AAAA\r\n")) == [("resource", b"wrong", False)]
    # a first segment whose continuation is missing, and a continuation of another record
    first = record(b"first", "response", "WARC-Segment-Number: 1\r\n")
    assert rows(first + good) == [("response", b"first", False), ("resource", b"fine", True)]
    assert rows(first) == [("response", b"first", False)]
    assert rows(first + record(b" second", "continuation", "WARC-Segment-Origin-ID: <urn:x:5>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 12\r\n")) == [("response", b"first second", True)]
    assert rows(first + record(b" third", "continuation", "WARC-Segment-Origin-ID: <urn:x:5>\r\nWARC-Segment-Number: 3\r\nWARC-Segment-Total-Length: 12\r\n")) == [("response", b"first third", False)]
    assert rows(b"") == [] and rows(b"\r\n\r\n") == []


def test_empty_table(spark):
    at = folder(spark)
    W.write_archives(table(spark).limit(0), at)
    assert W.read_records(spark, at).collect() == []


def test_sql_of_the_query(spark, small):
    got = W.op11_warc(spark, small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    rows = con.execute(W.ORACLE)
    names = [d[0] for d in rows.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(rows.fetchall(), key=repr)
