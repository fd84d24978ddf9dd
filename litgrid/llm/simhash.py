"""SimHash near-duplicates, found by meeting in the middle of the Hamming balls.

Fingerprints: 64 bits, each set if over half of the text's word shingles have it set in their XXH64 (seed 42).
Two fingerprints within `radius` (3) bits meet: those an even number of bits apart share a variant one flip from either,
those an odd number apart a variant one flip from the one with odd parity and two from the one with even parity. So a
fingerprint emits the variants within one flip of it, and if its parity is even those two flips away as well. Variants
are shuffled by their leading bits: a fingerprint goes to each bucket that one of its variants falls in, with the flips
already spent, and the bucket writes out the variants there, so they never lie on disk. Those that meet at a variant form
a star around its smallest node that is at most one flip away; every edge is verified, so even a very large group of
near-copies makes no more edges than variants. Components come from components.py.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from litgrid.llm.batches import map_texts
from litgrid.llm.bytesops import ODD, ODD2, Words, as_bytes, mix, spread
from litgrid.llm.components import components
from litgrid.session import ready_checkpoints, ready_workers, release_shuffles

U64 = np.uint64
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
#: Nodes of fingerprints that no document with an id has begin here.
NO_ID = 1 << 62
#: Variants in a bucket, about, and leading bits of buckets at most: those keep to that size up to some 3e10 fingerprints.
BUCKET_VARIANTS = 2_000_000
MOST_BITS = 24
#: Fingerprints whose two-flip variants are written out at once.
CHUNK = 512
#: Of two sets of similarity 0.8 all bands differ with a chance of (1 - 0.8 ** 7) ** 50, under 1 in 100,000.
BANDS, BAND_ROWS = 50, 7
#: Rounds in which those of a key that are not linked to its largest component are compared with some of it, and with how many.
LEADERS, FEW = 1, 4
#: Bytes and sets of a block in which the rest of a key is compared, and shingles on a side of a matrix of them.
BLOCK_BYTES, BLOCK_SETS, COLUMNS = 4 << 20, 512, 2048


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of a buffer at once."""
    if not len(starts):
        return np.zeros(0, U64)
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    v8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    v4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    pos, rest = starts.astype(np.int64), lens.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(pos), U64(seed) + P5)
        live = np.flatnonzero(rest >= 32)
        if len(live):
            own = np.repeat(np.array([[U64(seed) + P1 + P2], [U64(seed) + P2], [U64(seed)], [U64(seed) - P1]]), len(live), axis=1)
            active = np.arange(len(live))
            while len(active):
                at = pos[live[active]]
                for k in range(4):
                    own[k, active] = _rot(own[k, active] + v8[at + 8 * k] * P2, 31) * P1
                pos[live[active]] += 32
                rest[live[active]] -= 32
                active = active[rest[live[active]] >= 32]
            x = _rot(own[0], 1) + _rot(own[1], 7) + _rot(own[2], 12) + _rot(own[3], 18)
            for k in range(4):
                x = (x ^ (_rot(own[k] * P2, 31) * P1)) * P1 + P4
            h[live] = x
        h += lens.astype(np.uint64)
        while len(m := np.flatnonzero(rest >= 8)):
            h[m] = _rot(h[m] ^ (_rot(v8[pos[m]] * P2, 31) * P1), 27) * P1 + P4
            pos[m] += 8
            rest[m] -= 8
        m = np.flatnonzero(rest >= 4)
        h[m] = _rot(h[m] ^ (v4[pos[m]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[m] += 4
        rest[m] -= 4
        while len(m := np.flatnonzero(rest > 0)):
            h[m] = _rot(h[m] ^ (data[pos[m]].astype(np.uint64) * P5), 11) * P1
            pos[m] += 1
            rest[m] -= 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every text's shingles, text after text, and how many each has."""
    w = Words(texts, lower=True, hashes=False)
    after = np.zeros(len(w.buf) + 1, np.int8)
    after[w.starts] += 1
    np.add.at(after, w.ends + 1, -1)
    out = w.buf.copy()
    out[w.ends] = 0x20
    packed = out[np.cumsum(after[:-1]) > 0]  # each word with one space after it
    at = np.zeros(len(w.lens) + 1, np.int64)
    np.cumsum(w.lens + 1, out=at[1:])
    count = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    _, place = spread(count)
    first = np.repeat(w.first[:-1], count) + place
    last = first + np.repeat(np.minimum(w.counts, size), count)
    return xxh64(packed, at[first], at[last] - 1 - at[first]), count


_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each group of consecutive hashes: the bits set in over half of them; zero for an empty group."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # lanes of 8 bits hold sums of up to 255 hashes
    parts = -(-counts[some] // 255)
    _, place = spread(parts)
    starts = np.cumsum(counts[some]) - counts[some]
    cuts = np.repeat(starts, parts) + place * 255
    groups = np.cumsum(parts) - parts
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(some), 64), bool)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes, groups, axis=0, dtype=np.int64) * 2 > counts[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = majority(*shingle_hashes(as_bytes(batch.column("text")), size))
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _send(bits: int):
    """For mapInArrow over (fp, node): packed rows for every bucket a variant falls in."""
    flips = [[0], [1 << i for i in range(bits)], [(1 << i) | (1 << j) for i, j in combinations(range(bits), 2)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
            even = np.flatnonzero(_popcount(fp) % 2 == 0)
            top = (fp >> U64(64 - bits)).astype(np.int64)
            rows = []
            for spent, masks in enumerate(flips):
                who = np.arange(len(fp)) if spent < 2 else even
                for m in masks:
                    rows.append((top[who] ^ m, who, spent))
            dest = np.concatenate([r[0] for r in rows])
            who = np.concatenate([r[1] for r in rows])
            spent = np.concatenate([np.full(len(r[1]), r[2]) for r in rows])
            order = np.argsort(dest.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1):
                if len(part):
                    own = who[part]
                    out.append({"dest": int(dest[part[0]]), "n": len(part), "payload": fp[own].tobytes() + node[own].tobytes() + spent[part].astype(np.uint8).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("dest", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]))

    return run


def _stars(value: np.ndarray, own: np.ndarray, node: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct variants, of each the member least away and of those the one with the smallest node, and the variant's place for each row given."""
    order = np.lexsort((node[own], away, value))
    value, own = value[order], own[order]
    new = np.r_[True, value[1:] != value[:-1]]
    return value[new], own[new], np.stack([own, own[new][np.cumsum(new) - 1]])


def _meet(bits: int, radius: int):
    """For one bucket: edges between nodes, as stars around the smallest node of each component within the bucket."""
    low = 64 - bits
    one = U64(1) << np.arange(low, dtype=np.uint64)
    two = np.array([(1 << i) | (1 << j) for i, j in combinations(range(low), 2)], np.uint64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fps, nodes, spents = [], [], []
        for n, p in zip(table["n"].to_pylist(), table["payload"].to_pylist(), strict=True):
            fps.append(np.frombuffer(p, np.uint64, n))
            nodes.append(np.frombuffer(p, np.int64, n, 8 * n))
            spents.append(np.frombuffer(p, np.uint8, n, 16 * n))
        fp, node, spent = np.concatenate(fps), np.concatenate(nodes), np.concatenate(spents)
        rest = fp & ((U64(1) << U64(low)) - U64(1))
        whole, once = np.flatnonzero(spent == 0), np.flatnonzero(spent == 1)
        near = np.concatenate([rest[whole], rest[once], (rest[whole][:, None] ^ one).ravel()])
        own = np.concatenate([whole, once, np.repeat(whole, low)])
        if not len(near):
            return schema.empty_table()
        # members are up to two bits apart: within one bit they are tied through the variant's own fingerprint
        value, head, pairs = _stars(near, own, node, (near != rest[own]) | (spent[own] > 0) if radius == 1 else np.zeros(len(near), bool))
        edges = [_edges(pairs, fp, radius)]
        shift = U64(64 - 22)
        seen = np.zeros(1 << 22, bool)
        seen[((value * ODD) >> shift).astype(np.int64)] = True

        def probe(v: np.ndarray, own: np.ndarray) -> None:
            maybe = np.flatnonzero(seen[((v * ODD) >> shift).astype(np.int64)])
            at = np.minimum(np.searchsorted(value, v[maybe]), len(value) - 1)
            good = value[at] == v[maybe]
            if good.any():
                edges.append(_edges(np.stack([own[maybe[good]], head[at[good]]]), fp, radius))

        even = _popcount(fp) % 2 == 0
        for who, masks in ((whole[even[whole]], two), (once[even[once]], one), (np.flatnonzero(spent == 2), np.zeros(1, U64))):
            for k in range(0, len(who), CHUNK):
                part = who[k : k + CHUNK]
                probe((rest[part][:, None] ^ masks).ravel(), np.repeat(part, len(masks)))
        a, b = np.concatenate(edges, axis=1)
        return pa.table(_forest(node[a], node[b]), schema=schema)

    return run


def _edges(pairs: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Distinct pairs whose fingerprints are different and within the radius."""
    a, b = pairs
    ok = (fp[a] != fp[b]) & (_popcount(fp[a] ^ fp[b]) <= radius)
    key = np.unique(a[ok] * (len(fp) + 1) + b[ok])
    return np.stack([key // (len(fp) + 1), key % (len(fp) + 1)])


def _forest(a: np.ndarray, b: np.ndarray) -> dict:
    """Edges from each node to the smallest node of its component here."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        m = np.minimum(label[x], label[y])
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        np.minimum.at(new, label[x], m)
        np.minimum.at(new, label[y], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return {"a": nodes[far], "b": nodes[label[far]]}


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    docs: doc_id, text; other columns, whatever their names, are not read. Texts, very long ones whole in one task, are
    lower-cased (A-Z), words are runs without ASCII white space, shingles are `size` consecutive words joined by a space (a shorter text is one shingle). Rows whose fingerprints differ
    in `radius` (at most 3) bits or fewer are linked; component_id is the smallest doc_id reachable.

    Null and empty texts have the fingerprint zero and are linked like any other. Rows with a null doc_id take part; a
    component without any id has a null component_id. Repeated rows each give a row; an empty table gives none.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius: 0 to 3")
    spark = docs.sparkSession
    ready_workers(spark)
    ready_checkpoints(spark)
    rows = fingerprints(docs, size).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.col("fp").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))).alias("node"))
    nodes = nodes.checkpoint()
    bits = min(MOST_BITS, max(3, math.ceil(math.log2(max(1, nodes.count() * 1073 / BUCKET_VARIANTS)))))
    sent = nodes.mapInArrow(_send(bits), "dest long, n long, payload binary")
    edges = sent.groupBy("dest").applyInArrow(_meet(bits, radius), "a long, b long")
    found = components(edges)
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of every text's shingles and how many each has; the distinct ones of each text, ascending, and how many."""
    hashes, count = shingle_hashes(texts, size)
    own = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, own))
    h, own = hashes[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return hashes, count, h[new], np.bincount(own[new], minlength=len(count))


def _set_names(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A name for each set of hashes; texts with the same shingles have the same."""
    out = mix(n.astype(np.uint64) + ODD)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = mix(out[some] + np.add.reduceat(mix(h ^ ODD2), (np.cumsum(n) - n)[some]))
    return out.view(np.int64)


@cache
def _turns() -> np.ndarray:
    """For each of the signature's hashes an odd factor and an addend."""
    x = np.random.default_rng(SEED).integers(0, 2**64, (BANDS * BAND_ROWS, 2), dtype=np.uint64)
    x[:, 0] |= U64(1)
    return x


def _bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A key for each set and band: of the least values of BAND_ROWS hash functions over the set."""
    out = np.zeros((len(n), BANDS), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    cuts = (np.cumsum(n) - n)[some]
    for k, (factor, addend) in enumerate(_turns()):
        least = np.minimum.reduceat(h * factor + addend, cuts)
        out[some, k // BAND_ROWS] = mix(out[some, k // BAND_ROWS] * ODD + least + U64(k))
    return out


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp, node (the name of the row's set of shingles), bands (keys in binary; none for texts without words)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, count, h, n = _sets(as_bytes(batch.column("text")), size)
        bands = [x.tobytes() if k else b"" for x, k in zip(_bands(h, n), n.tolist(), strict=True)]
        fp = majority(hashes, count).view(np.int64)
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(fp), pa.array(_set_names(h, n)), pa.array(bands, pa.binary())], names=["doc_id", "fp", "node", "bands"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long, node long, bands binary")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            bands, node = part.column("bands").to_pylist(), part.column("node").to_numpy()
            key = np.frombuffer(b"".join(bands), np.int64)
            yield pa.record_batch([pa.array(key), pa.array(np.repeat(node, [len(x) // 8 for x in bands]))], names=["key", "node"])


def _similar(similarity: float):
    """For mapInArrow over (a, b, x, y): the pairs whose sets x and y have that similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = min(len(x), len(y)), max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if few >= similarity * many * 0.999 else 0
                good.append(bool(both) and both / (few + many - both) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def similar_components(docs: DataFrame, rows: DataFrame, size: int, radius: int, similarity: float) -> DataFrame:
    """node, component of the sets of shingles that are linked to another; rows: the signatures of docs.

    Candidates are the fingerprints within `radius` bits and the sets that share a band's key. Each set is first compared with
    a few that share most keys with others, which are near the middle of a large group of copies; LEADERS times more those
    that are not linked to the largest component of a key are compared with a few of it. Sets of keys that are not one
    component even then are compared in blocks, as matrices, so that no link is lost and no pair becomes a row.
    """
    nodes = rows.select("fp", "node").distinct()
    one = nodes.groupBy("fp").agg(F.min("node").alias("node")).checkpoint()
    bits = min(MOST_BITS, max(3, math.ceil(math.log2(max(1, one.count() * 1073 / BUCKET_VARIANTS)))))
    near = one.mapInArrow(_send(bits), "dest long, n long, payload binary").groupBy("dest").applyInArrow(_meet(bits, radius), "a long, b long")
    same = nodes.withColumnRenamed("node", "b").join(one.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")

    keys = rows.select("node", "bands").dropDuplicates(["node"]).mapInArrow(_explode, "key long, node long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(sizes, "key").checkpoint()
    shared = shared.join(shared.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("key", "node", "weight").checkpoint()
    release_shuffles(docs.sparkSession)
    stars = _with_heads(shared)
    pairs = near.unionAll(same).unionAll(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()

    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(shared.select("node")).distinct().checkpoint()
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, "doc_id", "left_semi").unionAll(texts.where("doc_id IS NULL"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, h, n = _sets(as_bytes(batch.column("text")), size)
        parts = [x.tobytes() for x in np.split(h, np.cumsum(n)[:-1])]
        return pa.record_batch([pa.array(_set_names(h, n)), pa.array(parts, pa.binary())], names=["node", "shingles"])

    of = map_texts(texts, sets, "node long, shingles binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]).checkpoint()
    release_shuffles(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        x = of.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = of.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long")

    edges = verified(pairs).checkpoint()
    release_shuffles(docs.sparkSession)
    found = components(edges)
    for turn in range(LEADERS + 1):
        labelled = shared.join(found, "node", "left").select("key", "node", "weight", F.coalesce("component", "node").alias("component"))
        open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        left = labelled.join(open_keys, "key", "left_semi").checkpoint()
        release_shuffles(docs.sparkSession)
        if turn < LEADERS:
            counted = left.groupBy("key", "component").agg(F.count("*").alias("n"))
            most = counted.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
            led = left.join(most, "key")
            drawn = led.where("component = main").groupBy("key").agg(F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node"))["node"].alias("head"))
            more = _few(led.where("component <> main").join(drawn, "key").select("node", "head", F.xxhash64("node", "head").alias("at")))
        else:
            new = _in_blocks(left, of, similarity).checkpoint()
            release_shuffles(docs.sparkSession)
            return found if new.isEmpty() else components(edges.unionAll(new))
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti").checkpoint()
        if more.isEmpty():
            continue
        new = verified(more).checkpoint()
        release_shuffles(docs.sparkSession)
        pairs = pairs.unionAll(more)
        if not new.isEmpty():
            edges = edges.unionAll(new)
            found = components(edges)
    raise AssertionError("the last turn returns")


def _in_blocks(left: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join all similar sets of a key, of (key, node); of: node, shingles.

    The sets of a key are dealt to blocks of bounded bytes, and two blocks at a time meet in a task as matrices, so the pairs are
    never rows and only a forest of the links leaves the task.
    """
    sizes = of.select("node", (F.octet_length("shingles").cast("long") + 64).alias("bytes"))
    blocks = F.ceil(F.greatest(F.sum("bytes") / BLOCK_BYTES, F.count("*") / BLOCK_SETS)).cast("int")
    many = left.join(sizes, "node").groupBy("key").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int")
    each = left.select("key", "node").join(many, "key").select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = each.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    return placed.join(of, "node").groupBy("key", "i", "j").applyInArrow(_matrix(similarity), "a long, b long")


def _matrix(similarity: float):
    """For one group of sets: a forest of the pairs with that similarity or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets], np.float64)
        names, column = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(column, minlength=len(names)) > 1  # of others no two sets have one in common
        own = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        keep = shared[column]
        own, column = own[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        both, width = np.zeros((len(sets), len(sets)), np.float64), int(shared.sum())
        for start in range(0, width, COLUMNS):
            a, b = np.searchsorted(column, (start, start + COLUMNS))
            has = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
            has[own[a:b], column[a:b] - start] = 1
            both += has @ has.T
        with np.errstate(invalid="ignore", divide="ignore"):
            near = both / (size[:, None] + size[None, :] - both) >= similarity
        x, y = np.nonzero(np.triu(near, 1))
        return pa.table(_forest(nodes[x], nodes[y]), schema=schema) if len(x) else schema.empty_table()

    return run


def _with_heads(shared: DataFrame) -> DataFrame:
    """a, b: every node with those of the greatest weight among the greatest of its keys."""
    heads = shared.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("h")).select("key", F.col("h.weight").alias("at"), F.col("h.node").alias("head"))
    return _few(shared.join(heads, "key").where("node <> head").select("node", "head", "at"))


def _few(heads: DataFrame) -> DataFrame:
    """a, b: each node with the first FEW of its heads, of which it has one for each of its keys at most; at: their order, the greatest first."""
    chosen = F.slice(F.sort_array(F.collect_set(F.struct("at", "head")), asc=False), 1, FEW)
    return heads.groupBy("node").agg(chosen.alias("all")).select(F.explode("all").alias("h"), "node").select(F.col("h.head").alias("a"), F.col("node").alias("b"))


def keep_one(docs: DataFrame, size: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest doc_id of their group of near-copies, one row of each group; rows without an id stay.

    Near-copies are texts whose sets of shingles have a similarity (common ones by all) of at least `similarity`, and those
    reachable from each other through such pairs; every link is verified on the sets. Bands of BAND_ROWS least hashes find
    a pair of similarity 0.8 with a chance of all but 1 in 100,000. Texts without words are one group. Rows that share an
    id but not a group are judged apart.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    ready_checkpoints(spark)
    release_shuffles(spark)
    rows = _signatures(docs, size).checkpoint()
    found = similar_components(docs, rows, size, radius, similarity)
    of = rows.where("doc_id IS NOT NULL").select("doc_id", "node").join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    kept = of.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("kept")).select("kept.*").checkpoint()
    names = [f"c{i}" for i in range(len(docs.columns))]
    chosen = docs.where("doc_id IS NOT NULL").join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, chosen.schema, strict=True)] + [StructField("node", LongType())])

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, h, n = _sets(as_bytes(batch.column("text")), size)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(_set_names(h, n))], names=[*names, "node"])

    chosen = map_texts(chosen, named, schema)
    own = f"c{docs.columns.index('doc_id')}"
    chosen = chosen.join(kept.withColumnRenamed("doc_id", "kept_id"), (F.col(own).cast("long") == F.col("kept_id")) & (chosen["node"] == kept["node"]), "left_semi").dropDuplicates([own, "node"])
    return chosen.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True))).unionByName(docs.where("doc_id IS NULL"))


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
