"""Both removers of repeats against plain loops, with and without many batches."""

import hashlib
import re

import numpy as np
import pytest

from litgrid.llm import exchange as X
from litgrid.llm import substring_dedup, suffix_dedup

from .conftest import prose

LAST = float("inf")


def removed(units, ids, size, cut):
    """Units of each row covered by a window that starts in a row with a smaller id."""
    first = {}
    for u, d in zip(units, ids, strict=True):
        for i in range(len(u) - size + 1):
            k = cut(u, i)
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    out = []
    for u, d in zip(units, ids, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if first[cut(u, i)] < (LAST if d is None else d):
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def runs(gone):
    return len(re.findall("1+", "".join("01"[g] for g in gone)))


@pytest.mark.parametrize("batch", [1 << 22, 3000])
@pytest.mark.parametrize("size", [13, 1, 5])
def test_word_windows(docs, rows, size, batch):
    units = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    gone = removed(units, [d for d, _ in rows], size, lambda u, i: tuple(u[i : i + size]))
    want = []
    for (d, _), u, g in zip(rows, units, gone, strict=True):
        kept = b" ".join(x for x, y in zip(u, g, strict=True) if not y)
        want.append((d, len(u), sum(g), runs(g), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = substring_dedup.remove_repeats(docs, size, batch).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], len(r["spans"]), r["kept_sha256"], r["kept_text"]) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("batch", [1 << 21, 3000])
@pytest.mark.parametrize("length", [50, 7, 2])
def test_byte_strings(docs, rows, length, batch):
    units = [(t or "").encode() for _, t in rows]
    gone = removed(units, [d for d, _ in rows], length, lambda u, i: u[i : i + length])
    want = [(d, len(u), sum(g), runs(g), hashlib.sha256(bytes(x for x, y in zip(u, g, strict=True) if not y)).hexdigest()) for (d, _), u, g in zip(rows, units, gone, strict=True)]
    got = suffix_dedup.remove_repeats(docs, length, batch).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_other_columns_are_kept(docs, rows):
    got = substring_dedup.remove_repeats(docs, keep=("lang", "text", "source")).select("doc_id", "lang", "text", "source").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(rows, key=repr)
    assert {(r["lang"], r["source"]) for r in got} == {("en", None)}


def test_periodic_texts_with_varying_bytes(spark):
    """Texts in which one unit recurs within every string are compared at all their bytes."""
    import random

    r = random.Random(5)
    rule = lambda inside: "-" * 25 + "".join(c + "-" * 25 for c in inside)
    rows = [(1, rule("57777779")), (2, rule("5aehmnw9"))]
    rows += [(10 + k, rule("".join(r.choice("abc") for _ in range(r.randrange(2, 40))))) for k in range(40)]
    rows += [(60 + k, "-" * r.randrange(1, 400) + r.choice("xy") + "-" * r.randrange(1, 400)) for k in range(20)]
    units = [t.encode() for _, t in rows]
    gone = removed(units, [d for d, _ in rows], 50, lambda u, i: u[i : i + 50])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, 2000).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {d: sum(g) for (d, _), g in zip(rows, gone, strict=True)}


def exchanged(parts, buckets, answer):
    """Answers to what these batches ask, without Spark."""
    import pyarrow as pa

    from litgrid.llm import exchange

    rows = [m for src, p in enumerate(parts) for m in p.ask(src, 0)]
    replies = {}
    for dest in {r[0] for r in rows}:
        for r in exchange.answers(buckets, answer)(exchange.messages([r for r in rows if r[0] == dest])).to_pylist():
            replies.setdefault(r["dest"], {})[r["src"]] = r["payload"]
    return [p.read(replies.get(src, {}), answer) for src, p in enumerate(parts)]


@pytest.mark.parametrize("need", [40, 64, 70, 128])
@pytest.mark.parametrize("answer", ["earlier", "shared", "rank"])
def test_answers(need, answer):
    """Against plain counts, with keys that agree in the whole first hash where the second is sent."""
    from litgrid.llm import exchange

    rng = np.random.default_rng(need)
    b = exchange.Buckets(1000, need)
    keys = (rng.integers(0, 20, 300).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    more = rng.integers(0, 2, 300).astype(np.uint64) << np.uint64(63) if b.second else np.zeros(300, np.uint64)
    order = np.sort(rng.integers(0, 40, 300))
    order[rng.integers(0, 300, 5)] = order[0]
    order.sort()
    parts, own = [], np.arange(300) % 3
    for k in range(3):
        parts.append(exchange.Distinct(keys[own == k], order[own == k], b, more[own == k] if b.second else None, answer != "earlier"))
    names = list(zip(keys.tolist(), more.tolist(), strict=True))
    docs = {}
    for n, d in zip(names, order.tolist(), strict=True):
        docs.setdefault(n, set()).add(d)
    ranks = {}
    for k, (flags, rank) in enumerate(exchanged(parts, b, answer)):
        for j, (i, f) in enumerate(zip(np.flatnonzero(own == k), flags, strict=True)):
            assert f == (order[i] > min(docs[names[i]]) if answer == "earlier" else len(docs[names[i]]) > 1)
            if answer == "rank":
                assert (rank[j] > 0) == f
                if f:
                    assert ranks.setdefault((int(keys[i]) >> 64 - b.sent, int(rank[j])), names[i]) == names[i]
    assert answer != "rank" or len(set(ranks.values())) == len(ranks)


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats])
def test_relays(docs, remove):
    """More buckets than a batch sends to give the same results."""
    want = sorted(map(str, remove(docs).collect()))
    assert sorted(map(str, remove(docs, batch_bytes=20_000, bucket_bytes=20_000, hop_bits=2).collect())) == want


def test_messages_are_linear():
    """A corpus of any size: the keys in a message don't get fewer, and a bucket's bytes don't get more."""
    from litgrid.llm import exchange

    for total in (10**9, 10**11, 10**13, 10**15):
        b = exchange.Buckets(total // 4, exchange.hashed_bits(total))
        assert (exchange.BATCH_BYTES / 4) / 2**b.sent >= 60
        assert total // 4 * 8 / 2**b.bits <= exchange.BUCKET_BYTES
        assert b.width(b.bits) * 8 + b.bits >= 2 * np.log2(total) + 10


def ranked(text, k):
    return {i: text[i : i + k] for i in range(len(text) - k + 1)}


def test_ranks_at_each_length():
    """Numbers after every offset against the prefixes themselves: equal if and only if the prefixes are, none for those of one document."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(120)) for _ in range(6)]
    texts += [texts[0][20:100] + "c" * 10, "zz" + texts[1][:70]]
    raw = [t.encode() for t in texts]
    length, ids = 20, np.arange(len(raw))
    sizes = suffix_dedup.lengths(length)
    assert sizes == [7, 14, 20]
    s = suffix_dedup.Strings(raw, length)
    a = np.arange(len(s.at))
    state = suffix_dedup.Open(suffix_dedup.Open.of(s, ids, a, a + 1), length)
    buckets, widths, replies = [X.Buckets(1000, 80)], [], {}
    where = {int(p): (int(d), int(p - s.bounds[d])) for p, d in zip(s.at, s.doc, strict=True)}
    for level, size in enumerate(sizes[:-1]):
        at, keys = state.asked(level, replies, buckets, widths)
        asked = keys.ask(0, level)
        found = {}
        for dest in {m[0] for m in asked}:
            for row in X.answers(buckets[level], X.RANK)(X.messages([m for m in asked if m[0] == dest])).to_pylist():
                found[row["src"]] = row["payload"]
                widths[level:] = [max([*widths[level:], buckets[level].sent + max(1, row["top"].bit_length())])]
        replies[level] = found
        _, rank = keys.read(found, X.RANK)
        names, of = {}, {}
        docs_of = {}
        for d, t in enumerate(texts):
            for w in ranked(t, size).values():
                docs_of.setdefault(w, set()).add(d)
        for p, k, n in zip(state.batch_positions(at).tolist(), keys.keys[keys.of].tolist(), rank.tolist(), strict=True):
            d = int(np.searchsorted(s.bounds, p, side="right")) - 1
            w = texts[d][p - s.bounds[d] :][:size]
            assert (n > 0) == (len(docs_of[w]) > 1)
            if n:
                number = (k >> 64 - buckets[level].sent, n)
                assert names.setdefault(number, w) == w and of.setdefault(w, number) == number
        buckets.append(X.Buckets(1000, 2 * widths[level]))
    assert where


def test_mixed_pairs_are_exact():
    a = np.repeat(np.arange(200, dtype=np.uint64), 200)
    b = np.tile(np.arange(200, dtype=np.uint64), 200)
    for width in (8, 20, 32, 33, 50):
        hi, lo = suffix_dedup.mixed_pairs(a, b, width)
        assert len(set(zip(hi.tolist(), lo.tolist(), strict=True))) == len(a)
        if 2 * width < 64:
            assert not (hi & np.uint64((1 << 64 - 2 * width) - 1)).any()


def test_cleaned_texts_keep_their_white_space(spark):
    passage = prose(20, 7)
    rows = [(1, passage), (2, f"first  line\n\n{passage}\tand\n last"), (3, f"{passage}\n"), (4, f"a\n{passage}")]
    got = {r["doc_id"]: r["clean_text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "first  line\n\nand\n last", 3: "\n", 4: "a\n"}
