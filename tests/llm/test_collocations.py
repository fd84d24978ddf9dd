"""Collocations against plain counting of all phrases, with and without a head that holds everything."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from litgrid.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=2000, least=10, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + 2] for p, a in cands.items() if len(p) == 3 for i in (0, 1) if 100 * a >= share * counts[p[i : i + 2]]}
        kept = []
        for p, a in cands.items():
            if p in gone:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed=1, n=600):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "é", "😀", "\x0e", "_", "-", "0", " q", "z" * 30)]
    weights = [1 / (k + 1) ** 1.4 for k in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        words = r.choices(vocabulary, weights, k=r.randrange(0, 60))
        rows.append((r.choice(["en", "en", "en", "de", None, "", "a b"]), "".join(w + r.choice([" "] * 20 + ["  ", "\t", ", ", ".", "\n", "\r\n", " ? "]) for w in words)))
    rows += [("en", None), (None, ""), ("de", " \t .,; \n"), ("xx", "only rare words here"), ("en", "New York City " * 40), ("en", "aa aa aa aa aa " * 20)]
    return rows + [("en", "New York, new york; NEW YORK\tnew  york")] * 12


SCHEMA = "lang string, text string"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("n", "code", "phrase", "word", "rank", "w1", "score", "part"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize(("head", "bits"), [(1 << 19, 20), (40, 20), (12, 3), (0, 12)])
def test_against_plain_counts(spark, head, bits):
    rows = texts()
    want = plain(rows)
    assert len(want) > 200 and any(len(r[2].split(" ")) == 3 for r in want)
    assert got(C.collocations(table(spark, rows), head=head, map_bits=bits)) == want


def test_other_limits(spark, monkeypatch):
    monkeypatch.setattr(C, "BATCH_BYTES", 50)
    rows = texts(2, 150)
    assert got(C.collocations(table(spark, rows), top=7, least=3, share=80, map_bits=16)) == plain(rows, 7, 3, 80)


def test_nothing_frequent(spark):
    assert C.collocations(table(spark, [("en", "a b c"), ("en", None)]), map_bits=10).collect() == []
    assert C.collocations(table(spark, texts()).limit(0), map_bits=10).collect() == []
    # words are frequent, pairs are not
    assert C.collocations(table(spark, [("en", f"w{k} . v{k} x{k}") for k in range(5)] * 9 + [("en", "w1. w1. w1")]), map_bits=10).collect() == []


@pytest.mark.parametrize(("block", "dense"), [(4, 4), (4, 10**9), (1 << 11, 16), (3, 1)])
def test_tiles(block, dense):
    r = np.random.default_rng(block)
    a, b = (np.minimum(r.zipf(1.5, 5000) - 1, 3000) for _ in "ab")
    codes, n = C.tiles(a, b, block, 10**9 if dense == 10**9 else dense)
    have = {(c >> 32, c & 0xFFFFFFFF): k for c, k in zip(codes.tolist(), n.tolist(), strict=True)}
    assert len(have) == len(codes) and have == Counter(zip(a.tolist(), b.tolist(), strict=True))
    assert [len(x) for x in C.tiles(a[:0], b[:0])] == [0, 0]


def test_long_texts_are_cut_at_pieces():
    r = random.Random(3)
    for _ in range(50):
        text = "".join(r.choice("ab ,.") * r.randrange(1, 6) for _ in range(r.randrange(0, 60))).encode()
        parts = list(C._cut(text, 20))
        assert b"".join(parts) == text
        assert all(p[-1:] in b",." for p in parts[:-1])


def test_scores_beyond_64_bits(spark):
    big = 10**13 - 1
    r = spark.sql(f"SELECT CAST({big} AS BIGINT) AS a, CAST({big + 7} AS BIGINT) AS l, CAST({big + 1} AS BIGINT) AS r").select(C._scored(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert r == 1000000 * big * big // ((big + 7) * (big + 1))


def test_sql_of_the_query(spark, small):
    have = C.op12_phrase_collocations(spark, small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rows = con.execute(C.ORACLE)
    assert sorted(have.columns) == sorted(d[0] for d in rows.description)
    want = sorted(rows.fetchall())
    assert got(have) == want and len(want) > 100
