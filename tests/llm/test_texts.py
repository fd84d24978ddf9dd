"""Decontamination, token counts, pieces, quality, sharding."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litgrid.llm import decontamination, pieces, quality, sharding, token_counts

from .conftest import PASSAGE, prose

ITEMS = [(1, PASSAGE), (2, "short one"), (3, None), (4, "!!"), (5, " ".join(PASSAGE.split()[20:45])), (10, prose(25, 10)), (None, "word word word")]


def words(text):
    raw = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


@pytest.mark.parametrize("block", [10**6, 30])
def test_decontamination(spark, docs, rows, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_hit", F.lit("x"))
    windows = {}
    for k, t in ITEMS:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("null" if k is None else str(k))
    want = []
    for d, t in rows:
        w, hit, own = words(t), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[tuple(w[i : i + n])]
        want.append((d, len(w), len(hit), sorted(own)))
    found = decontamination.find(docs, items, block_words=block)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=repr) == sorted(want, key=repr)
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items).collect()}
    assert 7 not in kept and 2 not in kept and PASSAGE[:50] not in kept[1 if 1 in kept else 13] and kept[13] == dict(rows)[13]


def test_no_items(docs, rows, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in decontamination.find(docs, items).collect())
    assert decontamination.decontaminate(docs, items).count() == len(rows)


COUNTER = token_counts.Counter(token_counts.Tokens(public_tokenizers.path("byte_bpe_50k.json")), 1 << 12)
BPE = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = st.text(st.one_of(st.sampled_from("'strevmlld \n\t aeé1२!…😀  ǅ"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_token_counts_equal_the_library(texts):
    texts = [*texts, *(t + "<|endoftext|>" + t for t in texts)]
    want = [len(e.ids) for e in BPE.encode_batch(texts, add_special_tokens=False)]
    assert COUNTER.count([t.encode() for t in texts]).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeinorst-=_xé… "), min_size=1, max_size=200), max_size=4))
def test_long_stretches_equal_the_library(texts):
    texts = [*texts, *(t.replace(" ", "") * 3 for t in texts), "x" * 700, "ab" * 150, "=" * 333]
    assert COUNTER.count([t.encode() for t in texts]).tolist() == [len(e.ids) for e in BPE.encode_batch(texts, add_special_tokens=False)]


def test_followers_are_those_of_the_library():
    """Pairs of tokens that may follow each other, against encoding the two together."""
    t, rng = COUNTER.tokens, np.random.default_rng(1)
    words = [w for w in BPE.get_vocab() if w.isalpha() and w.isascii()]
    a, b = ([words[i] for i in rng.integers(0, len(words), 3000)] for _ in range(2))
    ids = BPE.get_vocab()
    got = t.follows(np.array([ids[x] for x in a]), np.array([ids[x] for x in b]))
    want = [e.ids == [ids[x], ids[y]] for x, y, e in zip(a, b, BPE.encode_batch([x + y for x, y in zip(a, b, strict=True)], add_special_tokens=False), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < 3000


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [(d, len((t or "").encode()), len(BPE.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    got = token_counts.token_counts(docs, path).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.token_counts(empty, path).collect() == []


MODEL = public_tokenizers.path("piece_bpe_32k.model")
ENCODER, LIBRARY = pieces.Encoder(pieces.PieceModel(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  ▁theingoan\n1é😀<0xA>"), st.characters(exclude_categories=["Cs", "Cn"], exclude_characters="\0")), max_size=40), min_size=1, max_size=5))
def test_pieces_equal_the_library(texts):
    ids, counts = ENCODER.encode([t.encode() for t in texts])
    cuts = np.r_[0, np.cumsum(counts)]
    got = [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    assert got == [LIBRARY.encode(t) for t in texts]
    back = pieces.decode(ids, counts, ENCODER.m)
    assert [b.decode() for b in back] == [t.replace("▁", " ") for t in texts]


def test_unigram_scores(tmp_path):
    """The same pass with sums of scores, against all ways to cut a word."""
    m = pieces.PieceModel(MODEL)
    m.kind = pieces.UNIGRAM
    e = pieces.Encoder(m)

    def best(w):
        if not w:
            return 0.0
        return max((m.scores[m.ids[w[:n]]] if w[:n] in m.ids else m.unknown if n == 1 else -np.inf) + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in m.ids or n == 1)

    words = sorted({"the", "then", "thing", "😀a", "zq"})
    for (own, w) in e._depth_first(words):
        score = sum(m.unknown if m.pieces[k].startswith("<0x") else m.scores[k] for k in own)
        assert w.startswith(pieces.MARK) and (("😀" in w) or abs(score - best(w)) < 1e-6)


def test_pieces_round_trip(docs, rows, empty):
    got = pieces.encode_decode(docs, MODEL)
    for r in got.collect():
        assert r["n_pieces"] == len(r["ids"]) and r["lossless"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest()
    assert sorted((r["text"] for r in got.collect())) == sorted(t or "" for _, t in rows)
    assert sorted(r["text"] for r in pieces.decode_pieces(got.drop("text"), MODEL).collect()) == sorted(t or "" for _, t in rows)
    assert pieces.encode_decode(empty, MODEL).collect() == []


def test_quality_of_held_out_rows(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    rows = quality.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.88


def test_quality_edges(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (13, 1, 1), (13, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, one)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(empty, model).collect() == [] and quality.keep_good(empty, model).collect() == []
    assert quality.keep_good(docs, model, 0.0).count() == len(rows)


def test_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    xs, ps = quality.calibration(x, (x + rng.normal(size=500) > 0).astype(int))
    assert (np.diff(np.interp(np.sort(x), xs, ps)) >= 0).all() and ps.min() >= 0 and ps.max() <= 1


def test_hilbert_curve(spark):
    for dims, bits in ((2, 3), (3, 2), (1, 3)):
        c = sorted(sharding.hilbert(spark, dims, bits).collect(), key=lambda r: r["curve"])
        assert [r["curve"] for r in c] == list(range(1 << dims * bits))
        at = [[r["cell"] >> i * bits & (1 << bits) - 1 for i in range(dims)] for r in c]
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(at, at[1:], strict=False))


def test_shards(docs, rows, empty, spark, small):
    got = sharding.assign(docs, shards=3).collect()
    assert len(got) == len(rows)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    assert sharding.assign(empty).collect() == []
    many = sharding.assign(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/documents.parquet"), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in many]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def curve_index(cell, dims, bits):
    """The place of a cell on the Hilbert curve, by turning quadrants one level after the other (the textbook algorithm on single numbers)."""
    x = [cell >> (dims - 1 - i) * bits & (1 << bits) - 1 for i in range(dims)]
    q = 1 << bits - 1
    while q > 1:
        for i in range(dims):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << b * dims + dims - 1 - i for b in range(bits) for i in range(dims))


def test_forty_shards_against_a_plain_loop(spark, small):
    """The whole table: the order is by curve and then by groups of equal texts, and every row's shard follows from the bytes before its group."""
    import xxhash

    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {(r["doc_id"], r["text_crc32"]): r for r in sharding.op3_hilbert_sharding(spark, small.replace("sf0.001", "sf0.01")).collect()}
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    code = lambda c: int.from_bytes((c or "").encode()[:7].ljust(7, b"\0"), "big") if c is not None else -1
    texts = [(r["text"] or "").encode() for r in rows]
    values = [[float(code(r["lang"])), float(code(r["source"])), float(len(t) + 16)] for r, t in zip(rows, texts, strict=True)]
    edges = []
    for k in range(3):  # the smallest value that at least i / 16 of the rows don't exceed
        v = sorted(x[k] for x in values)
        edges.append([v[-(-i * len(v) // 16) - 1] for i in range(1, 16)])
    cell = [sum(sum(x[k] > e for e in edges[k]) << 4 * (2 - k) for k in range(3)) for x in values]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    total = sum(len(t) + 16 for t in texts)
    h = lambda t: np.int64(np.uint64(xxhash.xxh64(t, seed=42).intdigest()).astype(np.int64))
    place = {}
    for t, g in groups.items():
        head = min(g, key=lambda i: rows[i]["doc_id"])
        # large groups, which may be cut at any row, follow the others of their cell
        place[t] = (curve_index(cell[head], 3, 4), (len(t) + 16) * len(g) * 40 * 20 > total, int(h(t)), zlib.crc32(t), len(t) + 16)
    done = 0
    for t in sorted(groups, key=place.__getitem__):
        g = groups[t]
        size = (len(t) + 16) * len(g)
        for n, i in enumerate(sorted(g, key=lambda i: rows[i]["doc_id"])):
            r = got[rows[i]["doc_id"], zlib.crc32(t)]
            assert r["curve"] == place[t][0]
            if size * 40 * 20 <= total:
                assert r["shard"] == min(39, (2 * done + size) * 40 // (2 * total)), (r, done, size, total)
        done += size
    assert len(got) == len(rows) and {r["law"] for r in got.values()} == {"bytes"}
    for s in range(40):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_pieces_of_documents_equal_the_library(spark, small):
    """The registered query over a whole table against the library's own pieces."""
    folder = small.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pieces.op2_sentencepiece(spark, folder).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]] or "")
        assert r["n_pieces"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_good_texts_score_higher_whatever_their_length(spark):
    """Against plain compression with the same dictionaries, block by block."""
    import zstandard

    rows = [(i, prose(300 + i, i) if i % 2 else "buy now " * (200 + i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"quality": F.lit("x"), "head": F.lit(1)})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit(1), "part": F.lit("p")})
    model = quality.fit(docs, labels)
    pair = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good)]
    for r in quality.score(docs, model).collect():
        t = dict(rows)[r["doc_id"]].encode()
        blocks = [t[i : i + model.block] for i in range(0, len(t), model.block)]
        x = sum(len(pair[0].compress(b)) - len(pair[1].compress(b)) for b in blocks) / len(t)
        assert abs(r["score"] - np.interp(x, model.xs, model.ps)) < 1e-12 and r["predicted"] == r["doc_id"] % 2


def test_shards_on_disk(docs, spark, tmp_path):
    rows = sharding.assign(docs, shards=3)
    sharding.write_shards(rows, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == rows.count() and {r["shard"] for r in back.select("shard").collect()} <= {0, 1, 2}


def test_quality_scores_by_a_plain_loop(spark, small):
    """Every text's score from the two dictionaries alone: block by block, sizes added up, the curve read between its points."""
    import bisect
    import zlib

    import zstandard

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x " * 700), (-3, "y" * 500), (-4, "z" * 501)], "doc_id long, text string")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = docs.unionAll(odd)
    bad, good = (zstandard.ZstdCompressionDict(d) for d in (model.bad, model.good))

    def size(block, d):
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    def chance(x):
        if x <= model.xs[0] or x >= model.xs[-1]:
            return model.ps[0] if x <= model.xs[0] else model.ps[-1]
        k = bisect.bisect_right(model.xs, x)
        a, b = model.xs[k - 1], model.xs[k]
        return model.ps[k - 1] + (model.ps[k] - model.ps[k - 1]) * (x - a) / (b - a)

    want = []
    for r in rows.collect():
        data = (r["text"] or "").encode()
        blocks = [data[i : i + model.block] for i in range(0, len(data), model.block)]
        x = sum(size(b, bad) - size(b, good) for b in blocks) / len(data) if data else 0.0
        p = chance(x)
        want.append((r["doc_id"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, round(float(p), 9), int(p >= 0.3)))
    got = [(r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in quality.score(rows, model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
