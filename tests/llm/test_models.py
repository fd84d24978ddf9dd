"""Nearest neighbours and the language model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from litgrid.llm import neighbours, pitman_yor


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def cosine(a, b):
    return float(neighbours.cosines(np.array([a], float), np.array([b], float))[0])


def exact(rows, queries, k):
    out = {}
    for q, a in queries:
        s = sorted((-cosine(a, b), v) for v, b in rows if v != q)
        out[q] = [(v, -d) for d, v in s[:k]]
    return out


@pytest.mark.parametrize("dims", [64, 5, 1])
def test_recall_and_scores(spark, dims):
    rows = list(enumerate(unit(400, dims, dims)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want, hit = exact(rows, rows[::20], 5), 0
    scores = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == cosine(scores[q], scores[v]) for _, v, s in found)
        hit += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert len(got) == 20 and hit / 100 >= 0.9


def test_unsound_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30, None), (31, [0.0, 0.0]), (32, [1.0, None]), (33, [float("nan"), 1.0]), (34, [float("inf"), 1.0]), (None, [1.0, 0.0]), (35, [1.0]), (36, [0.0, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, df.where("vec_id IN (0, 36, 30, 31)")).collect())
    assert got == [(0, i, i) for i in range(1, 6)] + [(36, i + 1, i) for i in range(5)]
    few = spark.createDataFrame(rows[:3] + [(99, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in neighbours.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (99, -1.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_sizes_of_components(spark):
    """Finite vectors near the ends of the range take part, and score as they are."""
    for scale in (1e200, 1e-170, 1.7e308, 5e-324):
        rows = [(i, [scale, scale * (i % 3), -scale if i > 3 else 0.0]) for i in range(6)] if scale != 1.7e308 else [(i, [scale, scale if i % 2 else 0.0, 0.0]) for i in range(6)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "bucket": F.lit(1), "rank": F.lit(None)})
        got = {}
        for r in neighbours.nearest(df, df.where("vec_id = 0")).collect():
            got[r["vec_id"]] = r["score"]
        small = [[x / scale for x in v] for _, v in rows]
        assert len(got) == 5 and all(abs(got[i] - np.dot(small[0], small[i]) / np.linalg.norm(small[0]) / np.linalg.norm(small[i])) < 1e-12 for i in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, small, sf):
    """Against all pairs, for the registered query."""
    import pyarrow.parquet as pq

    folder = small.replace("sf0.001", sf)
    table = pq.read_table(f"{folder}/embeddings.parquet")
    rows = [(i, np.array(v, float)) for i, v in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True) if v is not None and None not in v and np.any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    got = {}
    for r in neighbours.op9_cross_polytope_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        hit += len(got[int(ids[q])] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(got) and len(got) == (ids % 50 == 0).sum()


def test_reach_is_measured(spark):
    """Vectors whose nearest ones are far off: the limit by their number alone misses many; the measured one reaches them."""
    rows = list(enumerate(unit(1500, 192, 4)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries, x = df.where("vec_id % 25 = 0"), np.array([v for _, v in rows])

    def recall(limit):
        got, hit = {}, 0
        for r in neighbours.nearest(df, queries, limit=limit).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        for i in range(0, 1500, 25):
            s = x @ x[i]
            s[i] = -9
            hit += len(got[i] & set(np.argsort(-s)[:5].tolist()))
        return hit / 300

    assert recall(neighbours.reach(1500)) < 0.9 <= recall(None)


def test_needed_limit_is_what_finds(spark):
    """A pair is found by the limit that it needs, and not by less."""
    rows = list(enumerate(unit(40, 16, 6)))
    x = np.array([v for _, v in rows])
    for i, j in ((0, 1), (2, 3), (4, 5), (6, 7)):
        least = int(neighbours.needed(x[i : i + 1], x[j : j + 1], 2)[0])
        pair = spark.createDataFrame([rows[i], rows[j]], "vec_id long, embedding array<double>")
        for limit in {least, least - 1} - {0}:
            found = neighbours._search(neighbours._sound(pair), neighbours._sound(pair.where(f"vec_id = {i}")), 16, 1, 2, limit, 1, neighbours.SEED).collect()
            assert len(found) == (limit >= least)


def test_parts_of_a_block_give_the_same(spark, monkeypatch):
    rows = list(enumerate(unit(300, 16, 1)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = neighbours._sound(df)
    joined = vectors.mapInArrow(neighbours._blocks(16, 2, -1, 7), neighbours.BLOCK).join(vectors.where("vec_id < 20").mapInArrow(neighbours._blocks(16, 2, 4, 7), neighbours.BLOCK).selectExpr("tab", "bucket", "ids q_ids", "codes q_codes", "scales q_scales", "vecs q_vecs"), ["tab", "bucket"]).toArrow().to_batches()
    want = [b.to_pydict() for b in neighbours._near(16, 5, 40, 7)(iter(joined))]
    monkeypatch.setattr(neighbours, "PARTED", 1)
    assert [b.to_pydict() for b in neighbours._near(16, 5, 40, 7)(iter(joined))] == want


def test_repeated_ids_are_rows_of_their_own(spark):
    """Every row but the query's own is a candidate, those of the same id too."""
    vecs = unit(60, 16, 3)
    rows = [(i, v) for i, v in enumerate(vecs)] + [(50, vecs[50]), (50, vecs[7]), (7, vecs[7]), (None, vecs[1]), (0, None), (0, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest_in(df, "vec_id % 50 = 0", 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and any(v)]
    want = {}
    for k, (i, q) in enumerate(fine):
        if i % 50 == 0:
            scored = sorted((-round(float(q @ v / np.sqrt((q @ q) * (v @ v))), 9), j) for m, (j, v) in enumerate(fine) if m != k)
            want.setdefault(i, []).extend((n, j, -x) for n, (x, j) in enumerate(scored[:5], 1))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def tokens(text):
    raw = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", raw), None]


def test_language_model_counts(docs, rows, empty):
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for (d, t), h in zip(rows, held, strict=True)), key=repr)
    got = pitman_yor.score(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=repr) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert pitman_yor.score(empty).collect() == []


def test_held_out_perplexity(spark, small):
    p = {r["held_out"]: r for r in pitman_yor.perplexity(pitman_yor.score(spark.read.parquet(f"{small}/documents.parquet"))).collect()}
    assert p[True]["perplexity"] < 0.5 * p[True]["base_perplexity"]


def test_everything_held_out(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = pitman_yor.score(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 3


def test_stirling_numbers():
    """Against the sum over all seatings of few customers."""

    def seatings(n):
        if n == 0:
            yield []
            return
        for s in seatings(n - 1):
            yield [*s, 1]
            for i in range(len(s)):
                yield [*s[:i], s[i] + 1, *s[i + 1 :]]

    d, table = 0.4, pitman_yor.log_stirling(6, 0.4)
    for n in range(1, 7):
        total = Counter()
        for s in seatings(n):
            total[len(s)] += math.prod(math.prod(j - d for j in range(1, k)) for k in s)
        assert all(abs(math.exp(table[n, t]) - x) < 1e-9 * x for t, x in total.items())


def test_drawn_tables_follow_the_seating():
    """The mean number of tables of many draws against the exact one, for a restaurant with one dish."""
    rng, n, d, strength = np.random.default_rng(1), 12, 0.5, 1.0
    table = pitman_yor.log_stirling(pitman_yor.EXACT, d)
    k = np.arange(1, n + 1)
    logs = table[n, 1 : n + 1] + k * math.log(0.1) + np.cumsum(np.log(strength + d * (k - 1)))
    p = np.exp(logs - logs.max())
    draws = pitman_yor.draw_tables(np.full(20_000, n), np.ones(20_000, np.int64), np.full(20_000, math.log(0.1)), np.zeros(20_000), d, strength, rng, table)
    assert abs(draws.mean() - (p * k).sum() / p.sum()) < 0.03


def exchanged(texts, bits, hot, held=10**9):
    """The messages of all rounds, dealt by hand; gives every bucket's words and what it knows in the end."""
    batch = pa.record_batch([pa.array(range(1, len(texts) + 1), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_pylist([r for r in pitman_yor._occurrences(batch, 0, bits, held, hot) if r["dest"] >= 0], schema=pitman_yor.ARROW)
    of = lambda table, d: table.filter(pc.equal(table["dest"], d))
    dests = lambda *tables: sorted(set().union(*(t["dest"].to_pylist() for t in tables)))
    each = lambda f, *tables: pa.concat_tables([f(*(of(t, d) for t in tables)) for d in dests(*tables)])
    asked = each(pitman_yor.questions(bits, hot), rows)
    replies = each(pitman_yor.first_replies(hot), rows, asked)
    settled = each(pitman_yor.burn_in(3, bits, hot), rows, replies)
    known = pa.concat_tables([replies, each(pitman_yor.later_replies(1), asked, settled), settled])
    seated = each(pitman_yor.sample(4, bits, hot), rows, known)
    known = pa.concat_tables([replies, each(pitman_yor.later_replies(2), asked, seated), seated])
    return [pitman_yor._state(of(rows, d), of(known, d), hot) for d in dests(rows)]


@pytest.mark.parametrize("bits", [0, 3])
@pytest.mark.parametrize("common", [[], ["a"], ["a", None]])
def test_predictive_probabilities_sum_to_one(common, bits):
    """Of all words after each context in every sample, over all buckets, with the unknown word's share; with words dealt by context and without."""
    from litgrid.llm.bytesops import Words

    import random

    r = random.Random(bits)
    texts = [" ".join(r.choices("abcdefghijkl", [1 / (k + 1) for k in range(12)], k=r.randrange(1, 60))) for _ in range(40)] + ["a b " * 150, ""]
    hot = np.sort(np.array([pitman_yor.END if w is None else Words([w.encode()]).hash[0] for w in common], np.uint64))
    states = exchanged(texts, bits, hot)
    assert len(states) == 1 if not bits else len(states) > 3
    samples = [list(x) for x in zip(*([(s.parent(), s.predictive(), s.context_tables().copy(), s.customers, s.tables) for s in pitman_yor.sampled(s)] for s in states), strict=True)]
    assert len(samples) == 4
    counts = Counter(w for t in texts for w in tokens(t))
    for sample in samples:
        assert len({(x[3], x[4]) for x in sample}) == 1  # all buckets hold the same totals
        customers, tables = sample[0][3:]
        unknown = (pitman_yor.S1 + pitman_yor.D1 * tables) / (len(counts) + 1) / (pitman_yor.S1 + customers)
        parent, mass, back = {}, Counter(), {}
        for s, (chance, p, t, _, _) in zip(states, sample, strict=True):
            parent |= dict(zip(s.own.words.tolist(), chance.tolist(), strict=True))
            for c in range(len(s.own.contexts)):
                name = int(s.own.contexts[c])
                b = (pitman_yor.S2 + pitman_yor.D2 * t[c]) / (pitman_yor.S2 + s.c_context[c])
                assert back.setdefault(name, b) == b
            for i, (w, c) in enumerate(zip(s.own.word.tolist(), s.own.context.tolist(), strict=True)):
                name = int(s.own.contexts[c])
                mass[name] += p[i] - back[name] * chance[w]
        assert len(parent) == len(counts) and abs(sum(parent.values()) + unknown - 1) < 1e-9
        assert all(abs(m + back[name] - 1) < 1e-9 for name, m in mass.items())


@pytest.mark.parametrize("n", [65, 300, 512])
def test_many_customers_are_seated_exactly(n):
    """Tables of dishes with many customers against the Stirling numbers of a table of their own."""
    rng, d, strength, parent, others = np.random.default_rng(2), 0.75, 1.0, 0.05, 3
    table, k = pitman_yor.log_stirling(n, d), np.arange(1, n + 1)
    logs = table[n, 1:] + k * math.log(parent) + np.cumsum(np.log(strength + d * (others + k - 1)))
    p = np.exp(logs - logs.max())
    p /= p.sum()
    draws = pitman_yor.draw_tables(np.full(20_000, n), np.ones(20_000, np.int64), np.full(20_000, math.log(parent)), np.full(20_000, others), d, strength, rng, pitman_yor.log_stirling(pitman_yor.EXACT, d))
    have = np.bincount(draws, minlength=n + 1)[1:] / len(draws)
    assert np.abs(np.cumsum(have) - np.cumsum(p)).max() < 0.015


def test_scores_against_a_plain_sampler():
    """Mean predictive probabilities of one customer at a time: each is taken up and seated again, in restaurants held as lists."""
    import random

    r = random.Random(4)
    texts = [" ".join(r.choices("abcdef", [6, 5, 4, 3, 2, 1], k=8)) for _ in range(30)]
    d2, s2, d1, s1 = pitman_yor.D2, pitman_yor.S2, pitman_yor.D1, pitman_yor.S1
    seqs = [tokens(t) for t in texts]
    base = 1 / (len({w for q in seqs for w in q}) + 1)
    low, high, totals, sat = {}, {}, {}, []  # tables (their customers) by context and word; of words; by context: customers, tables

    def top(w):
        n, t = sum(map(sum, high.values())), sum(map(len, high.values()))
        return (sum(high.get(w, [])) - d1 * len(high.get(w, [])) + (s1 + d1 * t) * base) / (s1 + n)

    def chance(u, w):
        n, t = totals.get(u, (0, 0))
        own = low.get((u, w), [])
        return (sum(own) - d2 * len(own) + (s2 + d2 * t) * top(w)) / (s2 + n)

    def seat(tables, d, new):
        x = r.random() * (sum(tables) - d * len(tables) + new)
        for i, k in enumerate(tables):
            x -= k - d
            if x < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        x = r.randrange(sum(tables))
        for i, k in enumerate(tables):
            x -= k
            if x < 0:
                tables[i] -= 1
                if not tables[i]:
                    tables.pop(i)
                    return True
                return False

    def move(u, w, back):
        n, t = totals.get(u, (0, 0))
        if back:
            gone = leave(low[u, w])
            totals[u] = (n - 1, t - gone)
            if gone:
                leave(high[w])
        else:
            opened = seat(low.setdefault((u, w), []), d2, (s2 + d2 * t) * top(w))
            totals[u] = (n + 1, t + opened)
            if opened:
                tables = sum(map(len, high.values()))
                seat(high.setdefault(w, []), d1, (s1 + d1 * tables) * base)

    pairs = [(u, w) for q in seqs for u, w in zip([None, *q], q, strict=False)]
    for u, w in pairs:
        move(u, w, False)
    mean, n = Counter(), 0
    for turn in range(160):
        for u, w in pairs:
            move(u, w, True)
            move(u, w, False)
        if turn >= 20:
            n += 1
            for p in set(pairs):
                mean[p] += chance(*p)
    del sat
    (s,) = exchanged(texts, 0, np.zeros(0, np.uint64))
    ours = np.mean([x.predictive() for x in pitman_yor.sampled(s)], axis=0)
    from litgrid.llm.bytesops import Words

    name = {w: int((pitman_yor.END if w is None else Words([w]).hash[0])) for q in seqs for w in q}
    have = {(int(s.own.contexts[c]), int(s.own.words[w])): p for w, c, p in zip(s.own.word, s.own.context, ours, strict=True)}
    gaps = [math.log10(have[name[u] >> (64 - pitman_yor.NAME_BITS), name[w]]) - math.log10(mean[u, w] / n) for u, w in pairs]
    assert len(have) == len(set(pairs)) and abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 0.2


def test_many_buckets_score_like_one(spark, small, monkeypatch):
    """The exchange between buckets: counts and base scores are the same, scores differ by the draws alone; no message but to owners and the root."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {r["doc_id"]: r for r in pitman_yor.score(docs).collect()}
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 20_000)
    many = {r["doc_id"]: r for r in pitman_yor.score(docs).collect()}
    assert set(one) == set(many)
    for d, a in one.items():
        b = many[d]
        assert (a["held_out"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["held_out"], b["n_tokens"], b["n_known"], b["train_tokens"])
        assert abs(a["base_score"] - b["base_score"]) < 1e-9 * abs(a["base_score"]) + 1e-9
    gap = np.array([(one[d]["score"] - many[d]["score"]) / one[d]["n_tokens"] for d in one])
    assert abs(gap).max() < 0.05 and abs(gap.mean()) < 0.005


def test_messages_follow_the_contexts():
    """Twice the text: at most twice the rows that buckets send, whatever their number."""
    def rows(n_docs, bits):
        texts = [" ".join(f"w{(7 * i + j * j) % 97}" for j in range(40)) for i in range(n_docs)]
        batch = pa.record_batch([pa.array(range(n_docs), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        hot = np.zeros(0, np.uint64)
        sent = [r for r in pitman_yor._occurrences(batch, 0, bits, 10, hot) if r["dest"] >= 0]
        return sum(pitman_yor.questions(bits, hot)(pa.Table.from_pylist([r], schema=pitman_yor.ARROW)).num_rows for r in sent)

    assert rows(40, 12) <= 40 * 41 + 4096 and rows(80, 12) <= 2 * rows(40, 12) and rows(40, 16) <= 40 * 41 * 2


def test_dishes_are_grouped_by_one_sort():
    """A sweep looks at its dishes once, not once for each number of customers that occurs; the groups and their order are the same."""
    c = np.random.default_rng(3).integers(0, pitman_yor.EXACT + 40, 5000)
    want = [(n, np.flatnonzero(c == n).tolist()) for n in np.unique(c[(c > 1) & (c <= pitman_yor.EXACT)]).tolist()]
    assert [(n, who.tolist()) for n, who in pitman_yor.alike(c)] == want
    assert list(pitman_yor.alike(np.array([0, 1, pitman_yor.EXACT + 1]))) == list(pitman_yor.alike(c[:0])) == []
