"""Web archives (WARC 1.1) of pages, written and read as streams of bounded chunks.

Payloads travel as a chunked record table: a row for each piece of at most `chunk_bytes` of a record, with the record's id and
the piece's number. Spark cuts the pieces from the page's value, so no Python worker ever holds a whole payload; digests are
carried from piece to piece. A record longer than a piece is written in segments, as the format provides: the first is the
response, the others are `continuation` records that name it and give their numbers, and the last tells the full length.
Segments of a record follow each other in one file.

Of records with equal payloads the one with the smallest id is the response, the others are revisits of it without a body.
Who has a digest first is an aggregation. Digests that several pages share are told to the pages by a broadcast while they are
few bytes; beyond that by a join, but for the digests of very many pages, of which there can only be few.

Files go through Spark's own text writer (gzip, a row a segment), so tasks that fail or run twice leave nothing behind, and any
store that Spark knows will do. They are read through its text reader, a file by one task, as lines that a parser puts together
again by the lengths in the headers; whatever bytes a payload has, they never look like the end of a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.session import ready_checkpoints, ready_workers, shared_folder

CHUNK_BYTES = 1 << 20
#: Shared digests are told by broadcast up to this size, at HOLDER_BYTES each.
BROADCAST_BYTES, HOLDER_BYTES = 8 << 20, 64
#: Beyond it by broadcast are only the digests of more than 1 / HOT of all pages: fewer than HOT.
HOT = 1000
#: Bytes of a header that are looked at before a record counts as broken.
HEADER_BYTES = 1 << 16
#: Bytes of segments in a batch on its way to the writer.
OUT_BYTES = 8 << 20

# fixed values of the format
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"

CHUNKS = pa.schema(
    [
        ("file", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk_no", pa.int32()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
        ("n_bytes", pa.int64()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("announced", pa.string()),
        ("intact", pa.bool_()),
    ]
)
CHUNKS_SQL = "file string, record_id string, record_type string, page_id long, target_uri string, refers_to long, chunk_no int, last boolean, data binary, n_bytes long, digest string, payload_bytes long, announced string, intact boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each piece of a payload: the columns of records but `payload` (binary), with n_bytes (of the whole), chunk_no (from 0), last, data.

    A payload that is null or empty is one empty piece. Pieces of a row follow each other in its partition.
    """
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes: 1 or more")
    rest = [c for c in records.columns if c != "payload"]
    whole = records.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    final = F.expr(f"CAST(greatest(n_bytes - 1, 0) DIV {int(chunk_bytes)} AS INT)")
    cut = whole.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), final)))
    data = F.substring("payload", F.col("chunk_no") * F.lit(int(chunk_bytes)) + 1, F.lit(int(chunk_bytes)))
    return cut.select(*rest, "n_bytes", "chunk_no", (F.col("chunk_no") == final).alias("last"), data.alias("data"))


def holders(pages: DataFrame) -> DataFrame:
    """digest, first (the smallest page_id with it; null if no page with it has an id), n, for the digests of several pages; pages: page_id, digest."""
    return pages.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")


def _with_first(pages: DataFrame, shared: DataFrame, total: int, broadcast_bytes: int) -> DataFrame:
    """page_id, url, digest, payload, payload_bytes, first (null where no other page has the payload); a revisit's payload is null."""
    if shared.count() * HOLDER_BYTES <= broadcast_bytes:
        told = pages.join(F.broadcast(shared.select("digest", "first")), "digest", "left")
    else:
        many = F.col("n") > total / HOT
        hot = F.broadcast(shared.where(many).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
        by_hot = pages.join(hot, "digest", "left")
        # pages of a hot digest need nothing of the next join; keys of their own spread them over its tasks
        own = F.concat("digest", F.encode(F.concat_ws(" ", F.col("page_id").cast("string"), "url"), "utf-8"))
        revisit = F.col("hot_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_first"))
        by_hot = by_hot.withColumns({"key": F.when(F.col("hot"), own).otherwise(F.col("digest")), "payload": F.when(~revisit, F.col("payload"))})
        told = by_hot.join(shared.where(~many).select(F.col("digest").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return told.select("page_id", "url", "digest", "payload_bytes", "first", revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload"))


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:page:none:{digest}"


def _http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _address(url: str | None) -> str:
    """An address in visible ASCII; anything else in it is percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~<>\"\\^`{|}") if url else "about:blank"


def _segment(row: dict, date: str) -> bytes:
    """A segment of a record without the last line break, which the writer adds."""
    digest, number, data = base32(row["digest"]), row["chunk_no"] + 1, row["data"]
    name = record_name(row["page_id"], digest)
    if number == 1:
        block = _http_head(row["payload_bytes"]) + data
        head = [f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {_address(row['url'])}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {HTTP}"]
        if row["revisit"]:
            head += [f"WARC-Refers-To: <{record_name(row['first'], digest)}>", f"WARC-Profile: {REVISIT}"]
    else:
        block = data
        head = ["WARC-Type: continuation", f"WARC-Record-ID: <{name}:{number}>", f"WARC-Segment-Origin-ID: <{name}>"]
    if number > 1 or not row["last"]:
        head.append(f"WARC-Segment-Number: {number}")
    if number > 1 and row["last"]:
        head.append(f"WARC-Segment-Total-Length: {len(_http_head(row['payload_bytes'])) + row['n_bytes']}")
    head += [f"WARC-Date: {date}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return b"\r\n".join([b"WARC/1.1", *(h.encode() for h in head), b"", block, b""])


def _segments(date: str):
    """For mapInArrow over chunks: a text row for each segment. The digest of a payload is carried along its pieces and held against the one announced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = hashlib.sha1()
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if not row["chunk_no"]:
                    carried = hashlib.sha1()
                carried.update(row["data"])
                if row["last"] and not row["revisit"] and carried.digest() != row["digest"]:
                    raise ValueError(f"page {row['page_id']}: its pieces do not add up to the payload")
                out.append(_segment(row, date))
                size += len(out[-1])
                if size > OUT_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z", broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to gzip files in `folder`, which must not exist.

    The payload is html in UTF-8; null is as empty. Of equal payloads those with the smallest page_id are responses, the others
    revisits of it. Rows that share both id and payload are all responses or all revisits. A null page_id is later than any
    id; rows of a payload that no row with an id has are all responses. A null or empty url is written as about:blank, and
    what is not visible ASCII in one is percent-encoded. A very long payload is cut to segments of chunk_bytes. An empty
    table makes an empty folder. Other columns, whatever their names, are not read.
    """
    ready_workers(pages.sparkSession)
    ready_checkpoints(pages.sparkSession)
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = holders(rows.select("page_id", "digest")).checkpoint()
    told = _with_first(rows, shared, pages.count(), broadcast_bytes)
    lines = chunk_table(told, chunk_bytes).mapInArrow(_segments(date), "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(folder)


class _Parser:
    """The records of one file, from its bytes in pieces of any size; gives rows of CHUNKS."""

    def __init__(self, file: str, chunk_bytes: int, with_data: bool) -> None:
        self.file, self.most, self.with_data = file, chunk_bytes, with_data
        self.buffer, self.state, self.left = b"", "head", 0
        self.record: dict | None = None  # the one that is open, over all its segments
        self.rows: list[dict] = []

    def feed(self, data: bytes) -> list[dict]:
        self.buffer = self.buffer + data if self.buffer else data
        at, more = 0, True
        while more:
            at, more = getattr(self, f"_{self.state}")(at)
        self.buffer = self.buffer[at:]
        out, self.rows = self.rows, []
        return out

    def end(self) -> list[dict]:
        """The rest, when the file has ended: a record that is still open, or bytes that are none, are not intact."""
        if self.state == "http":
            self._give(0, min(self.left, len(self.buffer)))
        elif self.state == "head" and self.buffer.strip(b"\r\n"):
            self._close()
            self._open({}, "broken")
        if self.record is not None:
            self._finish(self.state == "head" and not self.record["open"])
        out, self.rows = self.rows, []
        return out

    # Each step takes the place in the buffer and gives the next one, and whether there is enough to go on.

    def _head(self, at: int) -> tuple[int, bool]:
        while self.buffer[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at == len(self.buffer):
            return at, False
        until = self.buffer.find(b"\r\n\r\n", at)
        begins = self.buffer.startswith(b"WARC/", at)
        if until < 0 and begins and len(self.buffer) - at <= HEADER_BYTES or not begins and len(self.buffer) - at < 5:
            return at, False
        fields = {}
        if until >= 0 and begins:
            for line in self.buffer[at:until].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        if not fields.get(b"content-length", "").isdigit():
            self._close()
            if self.record is None:
                self._open(fields, "broken")
                self._finish(False)
            self.state = "lost"
            return at + 1, True
        kind = fields.get(b"warc-type", "")
        if kind == "continuation" and self.record is not None and self.record["open"] and _bare(fields.get(b"warc-segment-origin-id")) == self.record["record_id"]:
            self.record["segment"] += 1
            self.record["in_order"] &= fields.get(b"warc-segment-number") == str(self.record["segment"])
            self.record["open"] = b"warc-segment-total-length" not in fields
            self.state = "block"
        else:
            self._close()
            self._open(fields, kind or "broken")
            self.state = "http" if fields.get(b"content-type", "").startswith("application/http") and kind in ("response", "revisit") else "block"
        self.left = int(fields[b"content-length"])
        return until + 4, True

    def _lost(self, at: int) -> tuple[int, bool]:
        after = self.buffer.find(b"\nWARC/", at)
        if after < 0:
            return max(at, len(self.buffer) - 5), False
        self.state = "head"
        return after + 1, True

    def _http(self, at: int) -> tuple[int, bool]:
        there = min(self.left, len(self.buffer) - at)
        until = self.buffer.find(b"\r\n\r\n", at, at + there)
        if until < 0 and there < self.left and there <= HEADER_BYTES:
            return at, False
        if until >= 0:
            length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", self.buffer[at : until + 2])
            self.record["told"] = int(length[1]) if length else None
            self.left -= until + 4 - at
            at = until + 4
        self.state = "block"
        return at, True

    def _block(self, at: int) -> tuple[int, bool]:
        there = min(self.left, len(self.buffer) - at)
        self._give(at, there)
        self.left -= there
        if not self.left:
            self.state = "head"
            if not self.record["open"]:
                self._finish(True)
        return at + there, not self.left

    def _open(self, fields: dict, kind: str) -> None:
        name, announced = _bare(fields.get(b"warc-record-id")), fields.get(b"warc-payload-digest")
        self.record = {
            "record_id": name,
            "record_type": kind,
            "target_uri": fields.get(b"warc-target-uri"),
            "announced": announced.removeprefix("sha1:") if announced else None,
            "page_id": _page(name),
            "refers_to": _page(_bare(fields.get(b"warc-refers-to"))),
            "open": fields.get(b"warc-segment-number") == "1",
            "segment": 1,
            "in_order": True,
            "told": None,
            "hash": hashlib.sha1(),
            "n": 0,
            "chunk_no": 0,
            "held": b"",
        }

    def _give(self, at: int, n: int) -> None:
        """n payload bytes from a place of the buffer, in pieces; the last piece is held back, as it may be the record's last."""
        r = self.record
        while n > 0:
            if len(r["held"]) == self.most:
                self._row(False, None)
                r["held"] = b""
                r["chunk_no"] += 1
            k = min(n, self.most - len(r["held"]))
            piece = self.buffer[at : at + k]
            r["hash"].update(piece)
            r["held"] = r["held"] + piece if r["held"] else piece
            r["n"] += k
            at, n = at + k, n - k

    def _row(self, last: bool, intact: bool | None) -> None:
        r = self.record
        revisit = r["record_type"] == "revisit"
        digest = base32(r["hash"].digest())
        self.rows.append(
            {
                "file": self.file,
                **{k: r[k] for k in ("record_id", "record_type", "page_id", "target_uri", "refers_to", "chunk_no", "announced")},
                "last": last,
                "data": r["held"] if self.with_data else None,
                "n_bytes": len(r["held"]),
                "digest": digest,
                "payload_bytes": (r["told"] if revisit else r["n"]) if last else None,
                "intact": intact and (revisit or r["announced"] in (None, digest)) if last else None,
            }
        )

    def _finish(self, whole: bool) -> None:
        self._row(True, whole and self.record["in_order"] and self.record["record_type"] != "broken")
        self.record = None

    def _close(self) -> None:
        """Another record begins: one that waits for further segments is not intact."""
        if self.record is not None:
            self._finish(False)


def _bare(name: str | None) -> str | None:
    return name.strip("<>") if name else None


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"urn:page:(-?\d{1,19})", name or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def read_chunks(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a folder (plain or gzip): a row for each piece of a record's payload.

    digest is that of the payload up to and with the piece, carried along; `last` marks a record's last piece, whose row also
    has payload_bytes and intact: the record was there to its end, its segments in order, and its digest is the announced one.
    A revisit has one empty piece and the length its response told. Bytes that are no record give a row of type `broken`.
    An HTTP header before a payload is not part of it. Without with_data, data is null.
    """
    ready_workers(spark)
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

        for batch in batches:
            runs = pc.run_end_encode(batch.column("file"))
            start = 0
            for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if parser is None or parser.file != file:
                    if parser is not None:
                        yield out(parser.end())
                    parser = _Parser(file, chunk_bytes, with_data)
                yield out(parser.feed(b"\n".join([*batch.column("value").slice(start, end - start).to_pylist(), b""])))
                start = end
        if parser is not None:
            yield out(parser.end())

    return lines.mapInArrow(run, CHUNKS_SQL)


def read_records(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each record of the archives: page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, intact.

    The digest of a response is that of the bytes read, the digest of a revisit the one its header announces.
    """
    found = read_chunks(spark, folder, chunk_bytes, with_data=False).where("last")
    digest = F.when(F.col("record_type") == "revisit", F.col("announced")).otherwise(F.col("digest"))
    return found.select("page_id", "target_uri", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "intact")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(spark, folder).drop("target_uri")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
parts AS (SELECT page_id, string_agg(substr(a, (v >> 15 & 31) + 1, 1) || substr(a, (v >> 10 & 31) + 1, 1) || substr(a, (v >> 5 & 31) + 1, 1) || substr(a, (v & 31) + 1, 1), '' ORDER BY i) AS d
  FROM (SELECT page_id, i, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a, CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER) AS v FROM p, range(8) r(i)) GROUP BY page_id)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p JOIN f USING (h) JOIN parts USING (page_id)
"""
