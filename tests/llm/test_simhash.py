import random
import re

import numpy as np
import pytest
import xxhash

from litgrid.llm import simhash
from litgrid.llm.components import components


def fingerprint(text, size=3):
    raw = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w)
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(s))


def labels(nodes, links):
    least = {n: n for n in nodes}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_xxh64():
    r = random.Random(0)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(100), 1000]]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    lens = np.array([len(p) for p in parts])
    assert simhash.xxh64(buf, np.cumsum(lens) - lens, lens).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


@pytest.mark.parametrize("size", [3, 5])
def test_documents(docs, rows, size):
    fp = [fingerprint(t, size) for _, t in rows]
    n = len(rows)
    groups = labels(range(n), [(i, j) for i in range(n) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[groups[i]] = min(least.get(groups[i], d), d)
    want = [(d, f"{fp[i]:016x}", least.get(groups[i])) for i, (d, _) in enumerate(rows)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, size).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [3, 5])
def test_balls_meet_exactly(bits):
    """All links within three bits, in clusters dense enough that stars stand in for many pairs."""
    import pyarrow as pa

    r = random.Random(bits)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        centre = r.getrandbits(64)
        fps.add(centre)
        for _ in range(25):
            x = centre
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    batch = pa.record_batch([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.arange(len(fps)))], names=["fp", "node"])
    sent = pa.Table.from_batches(list(simhash._send(bits)([batch])))
    links = []
    for dest in set(sent["dest"].to_pylist()):
        out = simhash._meet(bits, 3)(sent.filter(pa.compute.equal(sent["dest"], dest)))
        links += zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)
    n = len(fps)
    assert labels(range(n), links) == labels(range(n), [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == labels({x for e in links for x in e}, links)


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_one_of_each_group_stays(docs):
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert kept.count(1) == 1 and 5 not in kept and 12 not in kept and 14 not in kept and kept.count(11) == 1 and kept.count(None) == 2


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_every_radius(radius):
    """All links of each radius, where smaller nodes lie two bits from both ends of a link of one bit."""
    import pyarrow as pa

    r = random.Random(radius)
    fps = [1 ^ (3 << 2 * k) for k in range(32)] + [5, 0, 1]  # 0 and 1 are a link; smaller nodes share every variant of 1
    for _ in range(8):
        centre = r.getrandbits(64)
        fps += [centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.randrange(2) << r.randrange(64)) for _ in range(40)]
    fps = list(dict.fromkeys(fps))
    batch = pa.record_batch([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.arange(len(fps)))], names=["fp", "node"])
    sent = pa.Table.from_batches(list(simhash._send(3)([batch])))
    links = []
    for dest in set(sent["dest"].to_pylist()):
        out = simhash._meet(3, radius)(sent.filter(pa.compute.equal(sent["dest"], dest)))
        links += zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)
    n = len(fps)
    assert labels(range(n), links) == labels(range(n), [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
