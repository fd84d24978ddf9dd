"""Every stage of the pipeline on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from litgrid.llm import registry


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{small}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, small).write.parquet(f"{folder}/{k}")
        kept = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, kept))
        docs = kept
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert set(after.columns) == set(corpus_pipeline.COLUMNS)
        assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        assert after.select("doc_id").distinct().count() == after.count() <= before.count()


def test_near_copies(stages):
    """The first of each group by comparing the five-word shingles of all pairs."""
    from .test_similar import firsts

    before, after = map(rows, stages[1])
    assert sorted(after) == firsts(sorted((d, r["text"]) for d, r in before.items()))
    assert all(after[d]["text"] == before[d]["text"] for d in after)


def test_substrings(stages):
    from .test_repeats import removed

    before, after = map(rows, stages[2])
    import re

    ids = sorted(before)
    units = [re.findall(rb"[^\x20\x09-\x0D]+", before[d]["text"].encode()) for d in ids]
    gone = removed(units, ids, 13, lambda u, i: tuple(u[i : i + 13]))
    for d, u, g in zip(ids, units, gone, strict=True):
        if not any(g):
            assert after[d]["text"] == before[d]["text"]
        elif all(g):
            assert d not in after
        else:
            kept = [x for x, y in zip(u, g, strict=True) if not y]
            assert re.findall(rb"[^\x20\x09-\x0D]+", after[d]["text"].encode()) == kept
            # what is left is the text without the removed words and the white space after them
            assert re.sub(r"\s", "", after[d]["text"]) == b"".join(kept).decode()


def test_benchmark(stages, spark, small):
    from litgrid.llm import decontamination

    before, after = stages[3]
    found = rows(decontamination.find(before, spark.read.parquet(f"{small}/benchmark.parquet")))
    before, after = rows(before), rows(after)
    for d, r in found.items():
        if r["n_hit"] * 2 > r["n_words"]:
            assert d not in after
        else:
            assert after[d]["text"] == (r["clean_text"] if r["n_hit"] else before[d]["text"])


def test_pieces(stages):
    before, after = map(rows, stages[4])
    assert set(before) == set(after) and all(after[d]["text"] == before[d]["text"] and after[d]["lossless"] for d in after)


def test_clean_documents_stay(stages, spark, small):
    good = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 AND doc_id IS NOT NULL").collect()}
    before, after = map(rows, stages[0])
    assert len(good & set(after)) >= 0.97 * len(good & set(before))


def test_whole_run_is_its_stages(stages, spark, small):
    """run() against the stages one after the other, each of which the tests above hold against plain loops."""
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    want = rows(stages[-1][1])
    assert got == want


@pytest.fixture(scope="module")
def odd_tables(spark, docs, small, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns with clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").withColumn("part", F.lit("x")).write.parquet(f"{folder}/benchmark.parquet")
    rows = [(d, int(d % 2 == 0 or d > 9), 0) for d in range(1, 18)] + [(5, 1, 0), (None, 1, 0), (7, None, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({"text": F.lit(1), "score": F.lit("s")}).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_odd_rows(odd_tables, spark, docs):
    out = corpus_pipeline.run(spark, odd_tables).collect()
    assert all(r["lossless"] for r in out) and 0 < len(out) <= docs.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_rows(odd_tables, spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, odd_tables)
    if k < 4:
        assert set(got.columns) == set(corpus_pipeline.COLUMNS)
    kept, given = got.collect(), docs.collect()
    assert len(kept) <= len(given) and {r["doc_id"] for r in kept} <= {r["doc_id"] for r in given}
    assert stage(spark, docs.limit(0), odd_tables).collect() == []
