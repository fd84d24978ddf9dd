"""The pipeline's near-copies against brute-force similarity of their five-word shingles."""

import random
import re
import time

import corpus_pipeline
import pytest

from litgrid.llm import simhash

from .test_simhash import labels


def shingles(text, size=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] * bool(w))


def firsts(rows):
    """The smallest id of each group, the groups by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: not (a or b) or len(a & b) * 5 >= len(a | b) * 4
    groups = labels(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[groups[i]] = min(least.get(groups[i], d), d)
    return sorted(least.values())


def variants():
    """Near-copies of all similarities from 0.6, in families whose members are not all alike, and long chains."""
    r, out = random.Random(1), []
    word = lambda: f"w{r.randrange(5000)}"
    for _ in range(40):
        base = [word() for _ in range(r.choice([30, 120, 400]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(1, max(2, len(base) // 22))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    chain = [word() for _ in range(200)]
    for _ in range(25):
        chain = chain[8:] + [word() for _ in range(8)]
        out.append(" ".join(chain))
    r.shuffle(out)
    return list(enumerate(out))


def test_all_near_copies_go(spark):
    rows = variants()
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == firsts(rows)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_stage(spark, small, table):
    folder = small.replace("sf0.001", table)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.simhash_near_dedup(spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in got) == firsts(rows)
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)


def test_unrelated_texts_of_one_id(spark):
    """Both stay, and so does a copy's group of its own."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    got = simhash.keep_one(spark.createDataFrame([(1, a), (1, b), (1, b), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, b)]


def test_large_group_below_the_similarity(spark, monkeypatch):
    """Many copies of a text that is not there: near each other, but hardly any are linked; in blocks of any size."""
    r = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(160):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 3])):
            copy[r.randrange(150)] = f"x{r.randrange(40)}"
        rows.append((k, " ".join(copy)))
    want = firsts(rows)
    assert 10 < len(want) < 150
    monkeypatch.setattr(simhash, "LEADERS", 0)
    for sets, columns in ((512, 2048), (7, 50)):
        monkeypatch.setattr(simhash, "BLOCK_SETS", sets)
        monkeypatch.setattr(simhash, "COLUMNS", columns)
        got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(x["doc_id"] for x in got.collect()) == want


def test_rounds_leave_no_shuffles(spark):
    """Many rounds over many partitions keep the files of the last rounds alone."""
    from litgrid.llm.components import components

    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = files()
        found = components(spark.createDataFrame([(k * 7 % 64, (k + 1) * 7 % 64) for k in range(63)], "a long, b long"))
        time.sleep(2)
        assert files() - before < 1000
        assert {(x["node"], x["component"]) for x in found.collect()} == {(k, 0) for k in range(64)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
