"""What plans and mechanisms must do besides giving the right rows."""

import random
import re
import time
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litgrid.functions import jats, sections, variants
from litgrid.functions.xml import parses
from litgrid.operators import chains, citations, handles, ranking, related, similar_text, spelling, tiers
from litgrid.plans import chained, indexed
from litgrid.session import shared_folder
from litgrid.sources import cursor, layout, tables
from litgrid.streaming import flow, replies


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark, name="t"):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- tiers


@pytest.mark.parametrize("few", [tiers.FEW_KEYS, 0])
def test_tiers_are_cut_before_they_are_aggregated(spark, small, few, monkeypatch):
    seen = []
    cut = tiers.cut_to

    def watched(rows, keys, n, key, few):
        out = cut(rows, keys, n, key, few)
        seen.append((n, plan(out.groupBy(key).count())))
        return out

    monkeypatch.setattr(tiers, "cut_to", watched)
    found = chained.chain(spark, small, few)
    open_, plans = zip(*seen, strict=True)
    assert len(plans) == 3 and list(open_) == sorted(open_, reverse=True)
    for p in plans:
        assert p.index("Aggregate") < p.index("LeftSemi")  # a plan is written from its top
        assert p.count("FileScan") == 1
        assert "BroadcastHashJoin" in p or not few
    assert found.outcomes().count() == spark.read.parquet(f"{small}/customer.parquet").count()


def test_later_tiers_are_not_read_when_nothing_is_open(spark):
    asked = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    first = spark.createDataFrame([(1, "text", None, None, 5), (1, " ", None, None, 1), (1, "other", None, None, 3)], "id int, payload string, n_sections int, failed boolean, size int")
    broken = first.where("1 / (id - id) > 0")
    found = tiers.run_chain(asked, "id", [chains.Tier("a", first), chains.Tier("b", broken)], ("size",))
    assert [tuple(r) for r in found.found.collect()] == [(1, "a", 3)]
    assert [tuple(r) for r in found.steps.collect()] == [(1, 0, "a", "found")]
    assert tiers.run_chain(asked.limit(0), "id", [chains.Tier("a", first)]).outcomes().collect() == []
    nothing = tiers.run_chain(asked, "id", [chains.Tier("a", None)])
    assert nothing.reasons().collect()[0]["reason"] == "no-pmc-fallback-disabled" and nothing.found.collect() == []


# --- payloads


@pytest.mark.parametrize(
    ("text", "fine"),
    [("<a/>", True), ("<a><b></a>", False), ("<a><b></a></b></a>", False), ("<a>&bad</a>", False), ("<a>&nbsp;</a>", True), ('<?xml version="1.0"?><!DOCTYPE a SYSTEM "x"><a>é</a>', True), ("<a/><b/>", False), ("text", False), ('<a b="1" b="2"/>', False), ("<a>1 < 2</a>", False), (" \n<a>x</a>\n ", True)],
)
def test_xml_is_parsed(text, fine):
    assert parses(text) is fine


# --- cursor source


def test_cursor_pages(spark):
    cursor.register(spark)
    at = folder(spark)
    spark.range(0, 1000).select("id", (F.col("id") % 10).alias("m"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s")).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1024).parquet(at)
    for size, shards in ((7, 5), (1000, 1), (1, 3), (333, 100)):
        rows = spark.read.format(cursor.NAME).option("path", at).option("pageSize", size).option("shards", shards).load()
        assert sorted(r["id"] for r in rows.collect()) == list(range(1000))
        assert rows.where("m = 3 AND id > 500").count() == 50 and rows.where("s IS NULL").count() == 334 and rows.where("m IN (1, 2) AND id <= 99 AND s IS NOT NULL").count() == spark.read.parquet(at).where("m IN (1, 2) AND id <= 99 AND s IS NOT NULL").count()


def test_cursor_pages_outside_a_filter_are_not_read(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    pq.write_table(pa.table({"id": range(1000)}), tmp_path / "x.parquet", row_group_size=100)
    (shard,) = cursor.shards(str(tmp_path), 1)
    pages = cursor.Pages(shard, 50)
    for wanted, groups in (([EqualTo(("id",), 250)], 1), ([GreaterThan(("id",), 799)], 2), ([In(("id",), (5, 995))], 2), ([], 10)):
        pages.read_groups, pages.held, at = 0, None, cursor.START
        while at is not None:
            _, at = pages.fetch(at, ["id"], cursor._ruled_out(wanted))
        assert pages.read_groups == groups


def test_cursor_stream_goes_on_where_it_was(spark):
    cursor.register(spark)
    at, seen = folder(spark), []
    for start in (0, 100, 100):
        if len(seen) < 2:
            spark.range(start, start + 100).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.format(cursor.NAME).option("path", f"{at}/in").option("pageSize", 30).load()
        replies.run_into(stream, f"{at}/out", f"{at}/checkpoint")
        seen.append(spark.read.parquet(f"{at}/out").count())
    assert seen == [100, 200, 200] and spark.read.parquet(f"{at}/out").distinct().count() == 200


# --- replies


def test_replies_in_several_runs(spark):
    """State lives on between the runs; each batch's watermark settles what has waited long enough."""
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    runs = [
        [(1, 0, True), (2, 0, True), (3, 1, True), (1, 3, False), (9, 2, False)],
        [(2, 12, False), (4, 11, True), (1, 14, False), (None, 14, True)],
        [(4, 12, False), (5, 40, True), (3, 41, False)],
        [(6, 300, True)],
    ]
    at, kind = folder(spark), "key long, minute int, is_request boolean"
    for rows in runs:
        df = spark.createDataFrame(rows, kind)
        df.withColumn("ts", F.to_timestamp(F.element_at(F.lit([minute(m) for m in range(301)]), F.col("minute") + 1))).select("key", "ts", "is_request").write.mode("append").parquet(f"{at}/in")
        stream = flow.file_stream(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema, 100)
        replies.run_into(replies.settle(stream, "5 minutes", "1 hour", "30 minutes", 2), f"{at}/out", f"{at}/checkpoint")
    got = sorted((r["key"], r["status"]) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [(1, "late"), (1, "ok"), (2, "late"), (2, "not_found"), (3, "late"), (3, "not_found"), (4, "ok"), (5, "not_found"), (9, "unasked")]


# --- relevance


def test_top_by_blocks_equals_all_scores(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randrange(0, 40))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    monkeypatch.setattr(ranking, "BLOCK", 16)
    monkeypatch.setattr(ranking, "FIRST", 3)
    index = ranking.build(df, folder(spark))
    import math

    full = [(i, t) for i, t in rows if t]
    mean, n = sum(len(t) for _, t in full) / len(full), len(full)
    df_ = {w: sum(w in t for _, t in full) for w in words}
    for terms in (["w3", "w50", "w50"], ["w0"], ["none"], [], words):
        score = lambda t, q=terms: sum(math.log1p((n - df_[w] + 0.5) / (df_[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(q) if w in t)
        want = sorted(((-round(score(t), 6), i) for i, t in full if any(w in t for w in terms)))[:10]
        got = ranking.top(spark, index, terms, 10).orderBy("pos").collect()
        assert [x["id"] for x in got] == [i for _, i in want]
    p = plan(index.postings(spark).where(F.col("term").isin("w3", "w50")))
    assert re.search(r"PushedFilters: \[In\(term, \[w3,w50\]\)\]", p)


def test_index_is_dealt_out_by_blocks_of_terms(spark, monkeypatch):
    """Tasks count the words of their documents first: a row is stored of a term and a block, whose lists hold the documents."""
    monkeypatch.setattr(ranking, "FILE_WORDS", 100)
    r = random.Random(7)
    texts = [(i, " ".join(r.choices(["An", "ox", "é", "a1b", "x-y", "", "zebra\n"], k=r.randrange(0, 30)))) for i in range(-200, 200)]
    df = spark.createDataFrame([*texts, (None, "ox"), (900, None), (901, "1 É"), (902, "ox")], "id long, text string").coalesce(1)
    found = {(w, i): (n, len(ws)) for i, t in [*texts, (902, "ox")] for ws in [re.findall("[a-z]+", t.lower())] for w in set(ws) for n in [ws.count(w)]}
    index = ranking.build(df, folder(spark))
    assert {(x["term"], x["id"]): (x["tf"], x["length"]) for x in index.postings(spark).collect()} == found
    assert index.lists(spark).count() == len({(w, i // ranking.BLOCK) for w, i in found})
    # more words, more tasks
    assert max(int(re.search(r"part-(\d+)", f)[1]) for f in index.postings(spark).inputFiles()) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = ranking.build(df.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("terms")), folder(spark))
    assert (lists.n, lists.mean_length) == (index.n, index.mean_length) == (len({i for _, i in found}), sum(n for n, _ in found.values()) / index.n)
    assert ranking.top(spark, lists, ["ox", "zebra"], 7).collect() == ranking.top(spark, index, ["ox", "zebra"], 7).collect()
    empty = ranking.build(df.limit(0), folder(spark))
    assert empty.n == 0 and ranking.top(spark, empty, ["ox"], 3).collect() == []


# --- links of many records


def test_links_are_dealt_out_by_their_number(spark, monkeypatch):
    """More links, more tasks: one exchange by the record for distinct links and their places, whatever the session's number of tasks is."""
    edges = spark.createDataFrame([(k % 30, k * 7 % 11, k % 5, k % 3) for k in range(300)], "a long, b long, n int, m int")
    whole = sorted(tuple(r) for r in related.linked(edges, "a", "b", ["n", "m"]).collect())
    monkeypatch.setattr(tables, "TASK_ROWS", 25)
    found = related.linked(edges, "a", "b", ["n", "m"])
    own = edges.where("a <> b").count()
    p = plan(found)
    assert sorted(tuple(r) for r in found.collect()) == whole
    assert p.count("Exchange") == 1 and re.search(rf"hashpartitioning\(a#\d+L, {-(-own // 25)}\)", p)
    asked, titles = spark.range(30).select(F.col("id").alias("src")), spark.range(30).select(F.col("id").alias("src"), F.lit("t").alias("title"))
    got = [sorted(map(tuple, chains.coverage_fallback(asked, "src", found.where("src < 9"), titles, [("x", found.where("src < 12"))], "references").select("src", "dst", "provider").collect())) for _ in (monkeypatch.setattr(tables, "TASK_ROWS", 5), monkeypatch.undo())]
    assert got[0] == got[1] == sorted((a, b, "first" if a < 9 else "x") for a, b, _ in whole if a < 12)


# --- spelling


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_spelling_finds_every_pair(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(150)}
    for n in (20, 23, 24, 25, 26, 30):  # around the length from which parts are met instead of deletions
        base = "".join(r.choice("abcdefgh") for _ in range(n))
        words.add(base)
        for _ in range(12):
            x = list(base)
            for _ in range(r.randrange(1, 4)):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], [x[k], "z"], ["y"]])
            words.add("".join(x))
    words = sorted(words) + [""]
    df = spark.createDataFrame([(w, 1) for w in words], "entry string, n long")
    asked = df.select(F.col("entry").alias("word"))
    got = {(x["word"], x["entry"], x["distance"]) for x in spelling.neighbours(asked, df).collect()}
    assert got == {(a, b, d) for a in words for b in words if a != b and (d := edits(a, b)) <= 2}


def test_spelling_pairs_are_few(spark, small):
    v = indexed._vocabulary(spark, small)
    asked, entries = v.where("n < 10").select(F.col("entry").alias("word")), v.where("n >= 10")
    pairs = spelling.candidates(asked, entries).count()
    assert pairs < 0.01 * asked.count() * entries.count()


def test_deletions_have_one_hash_each(spark):
    """A word has as many keys as strings that deletions leave of it, and equal strings have equal keys, whatever they come from."""
    words = ["", "a", "aa", "ab", "ba", "aba", "é😀a", "banana", "bandana", "abcdefghijklmnopqrstuvwx"]
    where, keys = spelling.deletions(pa.array(words))
    own = {w: {w[:i] + w[i + 1 : j] + w[j + 1 :] for i in range(len(w)) for j in range(i + 1, len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w} for w in words}
    found = {w: set(keys[where == k].tolist()) for k, w in enumerate(words)}
    assert [len(found[w]) for w in words] == [len(own[w]) for w in words] and len(keys) == sum(map(len, own.values()))
    assert all(len(found[v] & found[w]) == len(own[v] & own[w]) for v in words for w in words)
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "entry string, n long")
    assert {(x["n"], x["key"]) for x in spelling.keyed(rows, "entry").collect()} == set(zip(where.tolist(), keys.tolist(), strict=True))


def test_spelling_reads_the_texts_once(spark, small):
    p = plan(indexed.spelling_index(spark, small))
    assert "documents.parquet" not in p and "Scan ExistingRDD" in p  # the vocabulary is kept before it is read for either side


# --- citations


def test_citations_by_any_fields(spark):
    r = random.Random(5)
    records = [(k, r.choice(["J one", "J two", None]), str(1990 + r.randrange(3)), r.choice(["1", "2", ""]), str(r.randrange(6)), r.choice(["Amy", "Bob"])) for k in range(200)]
    asked = [(f"k{k}", *(None if r.random() < 0.4 else r.choice([x[i] for x in records]) for i in range(1, 6))) for k in range(120)] + [("bars", "J|one", "1990", None, None, None), ("upper", " j ONE ", None, None, None, "AMY"), ("nothing", None, " ", None, None, None)]
    kind = "journal string, year string, volume string, page string, author string"
    a, b = spark.createDataFrame(asked, f"key string, {kind}"), spark.createDataFrame(records, f"id long, {kind}")
    got = {x["key"]: x for x in citations.match(a, b, "id").collect()}
    norm = lambda x: (x or "").strip().lower() or None
    rows = 0
    for key, *fields in asked:
        valid = norm(fields[0]) or norm(fields[1])
        hits = [i for i, *f in records if all(norm(x) is None or norm(x) == norm(y) for x, y in zip(fields, f, strict=True))] if valid else []
        rows += len(hits)
        x = got[key]
        assert x["n_candidates"] == len(hits)
        assert x["status"] == ("invalid" if not valid else "matched" if len(hits) == 1 else "ambiguous" if hits else "not_found")
        assert x["candidates"] == (hits[:10] if len(hits) > 1 else None) and x["matched_id"] == (hits[0] if len(hits) == 1 else None)
    assert citations.candidates(a, b, "id").count() == rows
    lines = a.select(citations.parse_request_line(citations.request_line(a, "key")).alias("r")).select("r.*")
    assert {x["key"]: x["journal"] for x in lines.collect()}["bars"] == "J one"
    assert citations.match(a.limit(0), b, "id").collect() == []


def test_records_that_no_request_wants_are_dropped_before_they_are_dealt_out(spark):
    """Under a pattern every record has a row; those that are not asked for would be shuffled as many times as there are patterns."""
    kind = "journal string, year string, volume string, page string, author string"
    records = spark.range(4000).select("id", F.lit("J").alias("journal"), F.lit("1990").alias("year"), F.lit("1").alias("volume"), F.col("id").cast("string").alias("page"), F.concat(F.lit("A"), "id").alias("author"))
    asked = spark.createDataFrame([("a", "J", None, None, "7", None), ("b", None, "1990", None, None, "A8"), ("c", "J", None, None, "8", "A9"), ("d", None, None, None, "9", None)], f"key string, {kind}")
    rows = citations._by_pattern(citations._requests(asked), records, "id")
    found = {(r["fields"], r["id"]) for r in rows.collect()}
    assert found >= {("1:j - - 1:7 -", 7), ("- 4:1990 - - 2:a8", 8)} and len(found) < 40
    got = {x["key"]: (x["status"], x["matched_id"]) for x in citations.match(asked, records, "id").collect()}
    assert got == {"a": ("matched", 7), "b": ("matched", 8), "c": ("not_found", None), "d": ("invalid", None)}


# --- similar texts


def test_similar_texts_lose_no_pair(spark):
    import math
    from collections import Counter

    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, r.choices(words, [1 / (k + 1) for k in range(300)], k=r.randrange(0, 30))) for i in range(150)] + [(200, ["w7", "w9"]), (201, ["w7", "w9"]), (202, [])]
    n, df_ = len(rows), Counter(w for _, t in rows for w in set(t))
    vec = {}
    for i, t in rows:
        v = {w: c * math.log(n / df_[w]) for w, c in Counter(t).items() if df_[w] < n}
        size = math.sqrt(sum(x * x for x in v.values()))
        if size:
            vec[i] = {w: x / size for w, x in v.items()}
    df = spark.createDataFrame(rows, "id long, words array<string>")
    for least in (0.2, 0.6):
        want = set()
        for q in (x for x in vec if x % 20 == 0):
            scored = sorted((-round(sum(x * vec[d].get(w, 0) for w, x in vec[q].items()), 6), d) for d in vec if d != q)
            want |= {(q, k, d, -s) for k, (s, d) in enumerate(((s, d) for s, d in scored if -s >= least), 1) if k <= 5}
        got = {(x["query_id"], x["pos"], x["id"], x["score"]) for x in similar_text.similar_texts(df, "id % 20 = 0", 5, least).collect()}
        assert got == want


def test_similar_documents_meet_by_rare_words(spark, small):
    rows = indexed._words(spark, small).withColumnRenamed("terms", "words")
    all_ = similar_text.vectors(rows).checkpoint()
    queries = all_.where("id % 20 = 0")
    assert similar_text.candidate_pairs(queries, all_, similar_text.LEAST).count() < queries.count() * all_.count() / 2


def test_similar_texts_in_blocks(spark):
    """More texts than a block holds, a third of them copies, and an id in two rows: the k best by all pairs, with no join that makes pairs rows."""
    import math
    from collections import Counter

    import numpy as np

    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [r.choices(words, [1 / (k + 1) for k in range(400)], k=8) for _ in range(60)]
    rows = [(i, texts[0] if i % 3 == 0 else r.choice(texts) + r.choices(words, k=3)) for i in range(similar_text.BLOCK_TEXTS + 200)]
    got = similar_text.similar_texts(spark.createDataFrame([*rows, (1, ["w399", "w398"])], "id long, words array<string>").coalesce(1), "id % 500 = 0", 4, 0.3)
    p = got._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join") == 1 and "Join Cross" in p
    rows[1] = (1, [*rows[1][1], "w399", "w398"])
    n, df = len(rows) + 1, Counter(w for _, t in rows for w in set(t))
    place = {w: k for k, w in enumerate(df)}
    m = np.zeros((len(rows), len(place)))
    for i, t in rows:
        for w, c in Counter(t).items():
            m[i, place[w]] = c * math.log(n / df[w])
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    want = set()
    for q in range(0, len(rows), 500):
        scored = sorted((-round(float(x), 6), d) for d, x in enumerate(m @ m[q]) if d != q)
        want |= {(q, k, d, -x) for k, (x, d) in enumerate(scored[:4], 1) if -x >= 0.3}
    assert {(x["query_id"], x["pos"], x["id"], x["score"]) for x in got.collect()} == want


def test_similar_texts_of_two_languages_lie_in_blocks_of_their_own():
    """Alternating texts of two vocabularies and a few common words: a block is of one kind, and all texts lie in one block."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = [np.r_[r.integers(0, 300, 40) + 1000 * (i % 2), r.integers(5000, 5003, 2)] for i in range(900)]
    frequent, weights = similar_text._kinds(texts[:400])
    batch = pa.record_batch({"id": pa.array(range(900)), "words": pa.array([t.tolist() for t in texts], pa.list_(pa.int64()))})

    def kinds(part):
        at = [np.bincount(np.searchsorted(frequent, [w for w in t if w in frequent]), minlength=len(frequent)) for t in part.column("words").to_pylist()]
        return (np.array(at) @ weights).argmax(axis=1)

    size = lambda part: part.column("words").value_lengths().to_numpy()
    blocks = [x.column("id").to_pylist() for _, x in similar_text._by_kind(iter([batch.slice(0, 500), batch.slice(500)]), kinds, size, 100)]
    assert sorted(sum(blocks, [])) == list(range(900)) and all(len(b) <= 100 and len({i % 2 for i in b}) == 1 for b in blocks)


def test_similar_texts_keep_every_pair_that_counts(monkeypatch):
    """What two blocks give against their plain product, whichever words are a product of matrices; nearly equal scores are told apart in double precision."""
    import numpy as np

    r = np.random.default_rng(4)

    def side(n, copies):
        m = r.random((n, 60)) * (r.random((n, 60)) < r.random(60))
        m[copies] = m[copies[0]] + 1e-7 * r.random((len(copies), 60))
        m[-1] = 0
        m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)
        word, at = np.nonzero(m.T)
        words, per = np.unique(word, return_counts=True)
        return m, (words, per, at, m.T[word, at])

    (left, q), (right, d) = side(30, [3, 4]), side(50, list(range(10, 40)))
    want, floor = left @ right.T, np.where(np.arange(30) % 2, 0.3, 0.6)
    for dense, pairs in ((0.0, 10), (1.0, 10), (0.1, 10**6)):
        monkeypatch.setattr(similar_text, "DENSE", dense)
        monkeypatch.setattr(similar_text, "PAIRS", pairs)
        terms, a, b = similar_text._shared(q, d, 30, 50)
        for most in (3, 50):
            got = {}
            for rows, columns in similar_text._reachable(a.lengths(), b.lengths(), floor):
                i, j, s = similar_text._scores(terms, a.only(rows), b.only(columns), floor[rows], most)
                got |= {(x, y): z for x, y, z in zip(rows[i].tolist(), columns[j].tolist(), s.tolist(), strict=True)}
            assert all(abs(want[p] - s) < 1e-14 for p, s in got.items())
            for i in range(30):
                best = [j for j in np.argsort(-want[i], kind="stable")[:most] if want[i, j] >= floor[i]]
                assert all((i, j) in got for j in best)


def test_similar_texts_that_share_too_little_are_no_matrix():
    import numpy as np

    # no row reaches a column: nothing is to be looked at; one long column alone brings its rows
    assert similar_text._reachable(np.full(4, 0.4), np.full(6, 0.4), np.full(4, 0.2)) == []
    parts = similar_text._reachable(np.array([0.9, 0.1, 0.1, 0.1]), np.array([0.1, 0.1, 0.9, 0.1, 0.1, 0.3]), np.full(4, 0.2))
    assert [(a.tolist(), b.tolist()) for a, b in parts] in ([([0], [2, 5])], [([0], [2]), ([0], [5])])


# --- layout


def test_layout_prunes(spark, small):
    at = indexed._laid_out(spark, small)
    refs = spark.createDataFrame([("src1", "D1"), ("src1", "D21"), ("PMC", "PMC5")], "source string, id string")
    p = plan(layout.lookup(spark, at, refs, "source", "id", "pmcid"))
    assert "dynamicpruning" in p and re.search(r"PushedFilters: \[[^\]]*In\(id, \[", p) and re.search(r"PushedFilters: \[[^\]]*pmcid", p)
    p = plan(layout.sources(at, spark, ["src1"], "source"))
    assert re.search(r"PartitionFilters: \[[^\]]*source", p)
    import pathlib

    import pyarrow.parquet as pq

    files = list(pathlib.Path(at.removeprefix("file:")).glob("source=src1/*.parquet"))
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).path_in_schema == "id" for f in files)


# --- files and batches of bounded size


def test_xml_files_are_bounded(spark):
    """A task reads an XML file whole, so one writing task makes several."""
    import inspect
    import pathlib

    assert inspect.signature(tables.write_xml).parameters["records"].default <= 100_000
    at = folder(spark, "xml")
    tables.write_xml(spark.range(25).select(F.col("id").alias("n")).coalesce(1), at, "r", "rs", records=10)
    assert len(list(pathlib.Path(at.removeprefix("file:")).glob("part-*"))) == 3
    assert sorted(x["n"] for x in tables.record_xml(spark, at, "n long", "r").collect()) == list(range(25))


def test_articles_are_held_in_small_batches(spark):
    """A batch of many articles leaves in parts, in order."""
    import pyarrow as pa

    whole = pa.record_batch([pa.array(range(300)), pa.array([f"<article><body><p>{k}</p></body></article>" for k in range(300)])], names=["key", "xml"])
    parts = list(jats.parse_batches("k")([whole]))
    assert [x.num_rows for x in parts] == [128, 128, 44]
    assert [x for p in parts for x in p.column("k").to_pylist()] == list(range(300))


def test_blocks_of_vectors_are_small():
    """A task's matrix of scores stays at 8 MB, as a few copies of it are held for each of an executor's tasks."""
    assert related.VECTOR_BLOCK * related.QUERY_BLOCK * 8 <= 8 << 20


def test_links_in_their_own_order_are_not_sorted_to_be_distinct(spark):
    edges = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (1, 1), (2, None), (None, 4)], "a long, b long")
    found = related.linked(edges, "a", "b", ["b"])
    assert "SortAggregate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (1, 3, 2)]


# --- sections


def test_sections_of_any_depth():
    xml = "<article><body><p>Lead <b>one</b>.</p><p>More.</p><sec><label>1</label><title>A</title><p>a1</p><sec><title>B</title><p>b😀</p><sec><p>c</p></sec></sec><p>a2</p></sec><p>Between.</p><sec><title>D</title></sec></body></article>"
    got = [(x[0], x[1], x[2], x[3], x[4], x[6], x[7]) for x in sections.rows(xml)]
    assert got == [("1", None, 1, 1, None, "Lead one.More.", 14), ("2", None, 1, 2, "A", "a1\n\na2", 6), ("2.1", "2", 2, 3, "B", "b😀", 3), ("2.1.1", "2.1", 3, 4, None, "c", 1), ("3", None, 1, 5, None, "Between.", 8), ("4", None, 1, 6, "D", "", 0)]
    assert list(sections.rows(None)) == list(sections.rows("<a>")) == list(sections.rows("<a/>")) == []


def test_sections_are_parsed_a_few_articles_at_a_time(spark):
    """A batch of the table function holds the sections of 10,000 articles as Python objects."""
    xml = "<a><body><p>x</p><sec><title>T</title><p>{}</p></sec></body></a>"
    whole = pa.record_batch([pa.array(range(300)), pa.array([xml.format(k) if k % 2 else None for k in range(300)])], names=["key", "xml"])
    parts = list(sections.parse_batches("xml")([whole]))
    assert [p.num_rows for p in parts] == [128, 128, 44] and parts[0].schema.names[:2] == ["key", "path"]
    assert [k for p in parts for k in p.column("key").to_pylist()] == [k for k in range(300) if k % 2 for _ in range(2)]
    got = sections.sections(spark.createDataFrame([(1, xml.format("y"), "z"), (2, None, "z")], "k int, xml string, more string"), "xml")
    assert got.columns[:2] == ["k", "more"] and [(r.k, r.more, r.path, r.title, r.text) for r in got.orderBy("ord").collect()] == [(1, "z", "1", None, "x"), (1, "z", "2", "T", "y")]


def test_section_table_in_sql(spark):
    sections.register(spark)
    spark.createDataFrame([(1, "<a><body><sec><title>T</title><p>x</p></sec></body></a>"), (2, None)], "k int, xml string").createOrReplaceTempView("articles_of_test")
    got = spark.sql("SELECT k, s.title, s.size FROM articles_of_test, LATERAL litgrid_sections(xml) s").collect()
    assert [tuple(r) for r in got] == [(1, "T", 1)]


# --- variants


def test_summaries_are_parsed_once(spark, small):
    p = plan(indexed.summary_variants(spark, small))
    assert len(re.findall("parse_json", p.split("Initial Plan")[0], re.IGNORECASE)) <= 1 or p.count("Generate") >= 2
    raw = ['{"uid":"1","title":"A","authors":["X","Y; Z"]}', '{"result":[{"UID":2},{"title":"none"},{"Uid":"3","Authors":{"Author":"Q"}}]}', "[]", "{", "null", None, '{"error":"x","uid":"9"}', '[{"uid":"4","authors":null}]']
    rows = spark.createDataFrame(list(enumerate(raw)), "k int, raw string")
    got = {r["uid"]: r["authors"] for r in variants.summaries(rows, "raw").collect()}
    assert got == {"1": "X; Y; Z", "2": "", "3": "Q", "4": ""} or got == {"1": "X; Y; Z", "2": None, "3": "Q", "4": None}


def test_variants_are_stored(spark):
    at = folder(spark)
    rows = spark.createDataFrame([(1, '{"a":{"b":[1,2]}}'), (2, "no")], "k int, raw string")
    variants.parsed(rows, "raw").drop("raw").write.parquet(at)
    got = spark.read.parquet(at).orderBy("k").select(variants.member(variants.member(F.col("v"), "a", kind="variant"), "b", kind="array<int>").alias("b")).collect()
    assert [r["b"] for r in got] == [[1, 2], None]


# --- handles


def test_handle_reads_the_page_alone(spark):
    page = spark.range(20).select((F.col("id") + 1).alias("pos"), (F.col("id") * 7).alias("rid"))
    handle = handles.keep(page, "pos")
    again = handles.page(spark, handle, "pos", 5, 5)
    assert [r["rid"] for r in again.orderBy("pos").collect()] == [35, 42, 49, 56, 63]
    p = plan(again)
    assert p.count("FileScan") == 1 and f"handle-{handle}" in p and "Range" not in p
    old = handles.keep(page, "pos", ttl_s=-10)
    with pytest.raises(LookupError):
        handles.read(spark, old)
    with pytest.raises(ValueError):
        handles.read(spark, "../x")
    assert int(handle.rpartition("-")[2]) > time.time()
