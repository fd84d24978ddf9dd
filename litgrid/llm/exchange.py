"""Which keys occur in an earlier document, asked by batches of texts and answered by buckets of keys.

Texts are packed to batches of a few MB, one compressed row each, which are dealt out once and kept on the executors' disks;
no key of the corpus decides where a text goes. A batch that is lost is packed again from the table, with the same rows in
the same order. The answers to each round are checkpointed, or where they are read in several rounds kept dealt out by batch,
so a lost executor costs no whole round. A batch sends each distinct key it holds once, with the smallest document that has it, packed in one binary row for each bucket. A
bucket sorts what it received and answers each key in the order sent. As a batch sends a key once however many of its rows
have it, a key that half the corpus shares costs its bucket one entry a batch.

A batch sends to at most 2 ** HOP_BITS buckets, so a message has some sixty keys at least and the number of messages is
linear in the bytes. Where more buckets are needed (from some 60 GB of words on) the first ones are relays: a relay gathers
what several batches send to one leading part of the buckets, asks the buckets for each distinct key, and passes the
answers on. That costs the same bytes once more, at any size beyond.

Rows carry `order`, the document id with null as the largest: such rows are never earlier than another.

Keys are bits of two independent hashes of what they stand for, or numbers that are exact. Of two different keys hashed to
2 * log2(n) + 10 bits, n the number of all keys there can be, any two agree with a chance of 1 in 2,048 in the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.llm.batches import give_back, pieces
from litgrid.session import ready_checkpoints, ready_workers

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Leading bits of keys that a batch, or a relay, tells its receivers apart by.
HOP_BITS = 14
RELAY_BYTES = 16 << 20
PARTITION_BYTES = 256 << 20
LAST = np.iinfo(np.int64).max
BATCH = "batch long, payload binary"
MESSAGE = "dest long, src long, round int, top long, payload binary"
MESSAGE_ARROW = pa.schema([("dest", pa.int64()), ("src", pa.int64()), ("round", pa.int32()), ("top", pa.int64()), ("payload", pa.binary())])
U64 = np.uint64

#: How a bucket answers: whether a document other than the sender's has the key, whether an earlier one has it, or a number
#: of the key among those of the bucket that several documents have (0 for the others).
SHARED, EARLIER, RANK = "shared", "earlier", "rank"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def in_batches(docs: DataFrame, total: int, batch_bytes: int = BATCH_BYTES, *keep: str) -> DataFrame:
    """Rows (batch, payload): a batch of order, text and the columns named, as keep0 and so on, sorted by order and text. total: bytes of text.

    Kept dealt out by batch, so that later rounds bring the answers to the batches and leave those where they are.
    """
    ready_workers(docs.sparkSession)
    ready_checkpoints(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("order"), F.col("text").cast("string").alias("text"), *(F.col(f"`{k}`").alias(f"keep{i}") for i, k in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for whole in batches:
            for piece in pieces(whole, limit=batch_bytes):
                table = pa.Table.from_batches([piece]).sort_by([("order", "ascending"), ("text", "ascending")])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([zstandard.ZstdCompressor(level=7).compress(sink.getvalue())], pa.binary())], names=["batch", "payload"])
                name += 1

    return dealt_out(rows.mapInArrow(run, BATCH), "batch", partitions(docs, total))


def partitions(docs: DataFrame, total: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_BYTES))


def dealt_out(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows dealt out by a key and kept on the executors' disks; what is lost is made again from the shuffle before it."""
    out = rows.repartition(parts, key).persist(StorageLevel.DISK_ONLY)
    out.count()  # later plans know how it is dealt out once it is there
    return out


def texts_of(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed binary; of floating-point numbers all first bytes come first, then all second ones and so on, as those that hold the exponent are alike."""
    head = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        head.append(np.array([ord(a.dtype.char), len(a)], np.int64).tobytes())
    body = (np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T if a.dtype.kind == "f" and len(a) else a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([*head, *body]))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for char, length in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        kind = np.dtype(chr(char))
        if kind.kind == "f" and length:
            planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
            out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        else:
            out.append(np.frombuffer(raw, kind, length, at))
        at += length * kind.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def messages(rows: list[tuple]) -> pa.Table:
    """Rows (dest, src, round, top, payload)."""
    return pa.table({n: pa.array([r[i] for r in rows], MESSAGE_ARROW.field(n).type) for i, n in enumerate(MESSAGE_ARROW.names)}, schema=MESSAGE_ARROW)


def hashed_bits(keys: int, certain: bool = True) -> float:
    """Bits for hashed keys, of `keys` different ones at most. certain: whether the answers decide; if they only leave out work
    that later rounds would do, a false match costs work and nothing else, and is let happen to 1 key in 1,024."""
    log = math.log2(max(2, keys))
    return max(64, 2 * log + 10) if certain else log + 10


class Buckets:
    """How keys of `need` bits are dealt to buckets and how wide they travel, for a number of keys expected overall."""

    def __init__(self, keys: int, need: float, hop_bits: int = HOP_BITS, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.need = math.ceil(need)
        self.bits = min(48, self.need - 1, max(3, math.ceil(math.log2(max(1, keys * 8 / bucket_bytes)))))
        self.sent = min(self.bits, hop_bits)  # the leading bits a batch deals by
        #: Whether bits beyond the 64 of a key are needed.
        self.second = self.need > 64

    def width(self, bits: int) -> int:
        """Bytes of a key in a message whose receiver implies so many leading bits."""
        return max(1, math.ceil((self.need - bits) / 8))

    def write(self, keys: np.ndarray, order: np.ndarray, src: int, turn: int, more: np.ndarray | None, bits: int) -> list[tuple]:
        """One message for each receiver that gets some; keys come in ascending order of their documents. more: the keys' further bits."""
        width, rows, squeeze = self.width(bits), [], zstandard.ZstdCompressor(level=1)
        for b, own in dealt(keys, bits):
            k = keys[own] << U64(bits)
            if more is not None:
                k |= more[own] >> U64(64 - bits)
            body = k.view(np.uint8).reshape(-1, 8)[:, max(0, 8 - width) :]
            if width > 8:
                rest = np.zeros(len(k), np.uint64) if more is None else more[own] << U64(bits)
                body = np.hstack([body, rest.view(np.uint8).reshape(-1, 8)[:, 16 - width :]])
            steps = small(np.diff(order[own], prepend=order[own][:1]).view(np.uint64))
            head = np.array([len(k), steps.itemsize, order[own][0]], np.int64)
            # keys are as good as random, but most steps are small: their bytes one place after the other compress
            planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(k), -1).T).tobytes()
            rows.append((b, src, turn, 0, squeeze.compress(head.tobytes() + planes + np.ascontiguousarray(body).tobytes())))
        return rows

    def read(self, payload: bytes, dest: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, their further bits and their documents."""
        width = self.width(bits)
        payload = zstandard.ZstdDecompressor().decompress(payload)
        n, size, first = (int(x) for x in np.frombuffer(payload, np.int64, 3))
        steps = np.ascontiguousarray(np.frombuffer(payload, np.uint8, n * size, 24).reshape(size, n).T).view(np.dtype(f"u{size}")).ravel()
        body = np.frombuffer(payload, np.uint8, n * width, 24 + n * size).reshape(n, width)
        low, high = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
        low[:, max(0, 8 - width) :] = body[:, :8]
        if width > 8:
            high[:, 16 - width :] = body[:, 8:]
        low, high = low.view(np.uint64).ravel(), high.view(np.uint64).ravel()
        more = (low << U64(64 - bits)) | (high >> U64(bits))
        return (U64(dest) << U64(64 - bits)) | (low >> U64(bits)), more, first + np.cumsum(steps.astype(np.int64))


def dealt(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The receivers that get keys, ascending, with the places of their keys in order."""
    if not len(keys):
        return
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint64
    bucket = (keys >> U64(64 - bits)).astype(kind)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        yield int(bucket[part[0]]), part


def by_source(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(src, round, payload) by source: the order of rows in a shuffle may differ if it is read again."""
    return sorted(zip(table["src"].to_pylist(), table["round"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda x: x[:2])


def coded(answer: str, flags: np.ndarray, ranks: np.ndarray | None) -> bytes:
    bits = np.packbits(flags).tobytes()
    if answer != RANK:
        return bits
    own = ranks[flags].astype(np.uint64)
    size = max(1, (int(own.max()).bit_length() + 7) // 8) if len(own) else 1
    return bits + bytes([size]) + own.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def decoded(answer: str, payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, -(-n // 8)), count=n).astype(bool)
    if answer != RANK:
        return flags, None
    ranks = np.zeros(n, np.int64)
    at = -(-n // 8)
    own, size = np.zeros((int(flags.sum()), 8), np.uint8), payload[at]
    own[:, :size] = np.frombuffer(payload, np.uint8, len(own) * size, at + 1).reshape(-1, size)
    ranks[flags] = own.view(np.int64).ravel()
    return flags, ranks


def answers(buckets: Buckets, answer: str) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: the answer to each key sent."""

    def run(table: pa.Table) -> pa.Table:
        got, here = by_source(table), table["dest"][0].as_py()
        parts = [buckets.read(p, here, buckets.bits) for _, _, p in got]
        key, more, doc = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.lexsort((more, key)) if buckets.second else np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        if buckets.second:
            new[1:] |= more[order][1:] != more[order][:-1]
        at, sorted_docs = np.flatnonzero(new), doc[order]
        least = np.minimum.reduceat(sorted_docs, at)
        several = least < np.maximum.reduceat(sorted_docs, at)
        group = np.cumsum(new) - 1
        flags, ranks, top = np.empty(len(key), bool), None, int(several.sum())
        flags[order] = sorted_docs > least[group] if answer == EARLIER else several[group]
        if answer == RANK:
            ranks = np.empty(len(key), np.int64)
            ranks[order] = np.cumsum(several)[group]  # dense, from 1, in the order of the keys
        cuts = np.cumsum([len(x[0]) for x in parts])
        rows = [(src, here, turn, top, coded(answer, flags[a:b], None if ranks is None else ranks[a:b])) for (src, turn, _), a, b in zip(got, np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True)]
        del parts, key, more, doc, order
        give_back()
        return messages(rows)

    return run


class Distinct:
    """The distinct keys of a batch, in the order of their smallest document, as they are asked for. places come in ascending order of documents.

    more: the keys' bits beyond the first 64, if they need them. Should two keys agree in the first 64 alone, one may be listed
    more than once, which the bucket's answers allow for. both: whether a key that several documents of the batch have is sent
    a second time with the last of them, so that its bucket learns of it.
    """

    def __init__(self, keys: np.ndarray, order: np.ndarray, buckets: Buckets, more: np.ndarray | None = None, both: bool = False) -> None:
        self.buckets = buckets
        by = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[by][1:] != keys[by][:-1]
        if more is not None:
            new[1:] |= more[by][1:] != more[by][:-1]
        group = np.cumsum(new) - 1
        first = by[new]  # stable: of each key's places the first
        least = order[first]
        at = first
        if both and len(by):
            last = by[np.append(np.flatnonzero(new)[1:], len(by)) - 1]
            at = np.concatenate([first, last[order[last] > least]])
        rank = np.argsort(at, kind="stable")
        place = np.empty(len(at), np.int64)
        place[rank] = np.arange(len(at))
        self.of = np.empty(len(keys), np.int64)
        self.of[by] = place[: len(first)][group]
        at = at[rank]
        self.keys, self.order, self.more = keys[at], order[at], None if more is None else more[at]
        self.later = order > self.order[self.of]  # an earlier document of the batch has the key

    def ask(self, src: int, turn: int, bits: int | None = None) -> list[tuple]:
        return self.buckets.write(self.keys, self.order, src, turn, self.more, self.buckets.sent if bits is None else bits)

    def read(self, replies: dict[int, bytes], answer: str, bits: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """For each place: whether the answer is yes, and its rank among those of the receiver."""
        flags, ranks = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), np.int64)
        for b, own in dealt(self.keys, self.buckets.sent if bits is None else bits):
            flags[own], r = decoded(answer, replies[b], len(own))
            if r is not None:
                ranks[own] = r
        flags = flags[self.of]
        return (flags | self.later if answer == EARLIER else flags), ranks[self.of] if answer == RANK else None


def by_round(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for src, turn, payload in by_source(table):
        out.setdefault(turn, {})[src] = payload
    return out


def paired(rows: DataFrame, replies: DataFrame, f: Callable[[int, bytes, dict], pa.Table], schema: str) -> DataFrame:
    """f of each row's batch and payload and the replies to it by round and bucket; rows: batch, payload."""
    empty = _empty(schema)

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows:
            return empty
        out = f(t["batch"][0].as_py(), t["payload"][0].as_py(), by_round(r))
        give_back()
        return out

    return rows.groupBy("batch").cogroup(replies.withColumnRenamed("dest", "batch").groupBy("batch")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def mapped(rows: DataFrame, f: Callable[[int, bytes], pa.Table], schema: str) -> DataFrame:
    """f of each row's batch and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, payload in zip(b.column("batch").to_pylist(), b.column("payload"), strict=True):
                yield from f(name, payload.as_py()).to_batches()
                give_back()

    return rows.mapInArrow(run, schema)


def answered(asked: DataFrame, buckets: Buckets, answer: str, size: int, parts: int | None = None) -> DataFrame:
    """The answers to a round of messages, checkpointed, or with parts dealt out by batch to so many. size: keys asked for, about, which the number of relays follows from."""
    out = _answered(asked, buckets, answer, size)
    return out.checkpoint() if parts is None else dealt_out(out, "dest", parts)


def _answered(asked: DataFrame, buckets: Buckets, answer: str, size: int) -> DataFrame:
    if buckets.bits == buckets.sent:
        return asked.groupBy("dest").applyInArrow(answers(buckets, answer), MESSAGE)
    chunks = max(1, math.ceil(size * buckets.width(buckets.sent) / RELAY_BYTES / 2**buckets.sent))
    asked = asked.checkpoint()
    relayed = asked.withColumn("relay", F.col("dest") * chunks + F.pmod(F.xxhash64("src"), F.lit(chunks)))

    def gathered(table: pa.Table) -> tuple[list, list[np.ndarray], np.ndarray, Distinct]:
        got, dest = by_source(table), table["dest"][0].as_py()
        parts = [buckets.read(p, dest, buckets.sent) for _, _, p in got]
        key, more, doc = (np.concatenate([x[i] for x in parts]) for i in range(3))
        by = np.argsort(doc, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        return got, [len(x[0]) for x in parts], back, Distinct(key[by], doc[by], buckets, more[by] if buckets.second else None, answer != EARLIER)

    def send(table: pa.Table) -> pa.Table:
        return messages(gathered(table)[3].ask(table["relay"][0].as_py(), 0, buckets.bits))

    def forward(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return MESSAGE_ARROW.empty_table()
        got, sizes, back, distinct = gathered(table)
        flags, ranks = distinct.read(by_round(replies).get(0, {}), answer, buckets.bits)
        if answer == RANK:  # the number within the bucket, and which of the buckets below the relay
            low = (distinct.keys[distinct.of] >> U64(64 - buckets.bits)) & U64((1 << (buckets.bits - buckets.sent)) - 1)
            ranks = np.where(ranks > 0, ranks + (low.astype(np.int64) << 32), 0)[back]
            flags = ranks > 0
        else:
            flags = flags[back]
        top = int(ranks.max()) if ranks is not None and len(ranks) else 0
        cuts = np.cumsum(sizes)
        here = table["dest"][0].as_py()
        return messages([(src, here, turn, top, coded(answer, flags[a:b], None if ranks is None else ranks[a:b])) for (src, turn, _), a, b in zip(got, np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True)])

    replies = relayed.groupBy("relay").applyInArrow(send, MESSAGE).groupBy("dest").applyInArrow(answers(buckets, answer), MESSAGE)
    return relayed.groupBy("relay").cogroup(replies.withColumnRenamed("dest", "relay").groupBy("relay")).applyInArrow(forward, MESSAGE)
