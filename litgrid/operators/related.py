"""Related records: link lists, similarity, and the chain of providers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.operators.tiers import first_success
from litgrid.sources.tables import dealt

#: Vectors and queries in a block; a pair of blocks has a matrix of scores of some 8 MB and a few copies of it.
VECTOR_BLOCK, QUERY_BLOCK = 2048, 512
BLOCK = "dims int, ids binary, vecs binary"


def linked(edges: DataFrame, src: str, dst: str, order: list[str]) -> DataFrame:
    """src, dst, pos: each record's distinct links but itself, by first appearance."""
    own = dealt(edges.where(F.col(dst).isNotNull() & (F.col(src) != F.col(dst))), src)  # once for both steps
    if order == [dst]:  # the link is its own place: distinct ones are hashed, where the least of a struct is found by sorting
        first = own.select(src, dst).distinct().withColumn("_at", F.col(dst))
    else:
        first = own.groupBy(src, dst).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.row_number().over(Window.partitionBy(src).orderBy("_at", dst)).alias("pos"))


def link_page(edges: DataFrame, src: str, dst: str, order: list[str], ids: list[int] | None, offset: int, limit: int) -> DataFrame:
    """A page of the links of each record; with ids of these records only, a filter that reaches the scan."""
    own = edges if ids is None else edges.where(F.col(src).isin(*ids))
    return linked(own, src, dst, order).where(F.col("pos").between(offset + 1, offset + limit))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one length: their ids and numbers in binary. Vectors that are null, empty or hold a null are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                part = whole.slice(at, size)
                ids, lists = part.column("id").to_numpy(), part.column("vec")
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
                for d in np.unique(n):
                    own = np.flatnonzero(n == d)
                    vecs = flat[(starts[own][:, None] + np.arange(d)).ravel()]
                    yield pa.record_batch([pa.array([d], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([vecs.tobytes()])], names=["dims", "ids", "vecs"])

    sound = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda c: c.isNull()))
    return sound.mapInArrow(run, BLOCK)


def _best(k: int):
    """For mapInArrow over pairs of blocks: of each query the k best of the block, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a pair at a time as Python objects
                r = batch.slice(row, 1).to_pylist()[0]
                if r["dims"] != r["q_dims"]:
                    continue
                q, v = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                a, b = np.frombuffer(r["q_vecs"]).reshape(len(q), -1), np.frombuffer(r["vecs"]).reshape(len(v), -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (a @ b.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])
                s[(q[:, None] == v[None, :]) | ~np.isfinite(s)] = -np.inf
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
                i, j = np.nonzero((s >= edge) & (s > -np.inf))
                yield pa.record_batch([pa.array(q[i]), pa.array(v[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    return run


def similar(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, pos: the k most similar vectors of each stated query, itself left out; ties by id.

    A stated set of queries against all vectors, exactly: every block of queries meets every block of vectors, whose scores
    are a product of matrices, and only the best of each query leave it.
    """
    asked = _packed(queries, QUERY_BLOCK).select(*(F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "vecs")))
    found = _packed(vectors, VECTOR_BLOCK).crossJoin(asked).mapInArrow(_best(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k)


def first_provider(asked: DataFrame, key: str, tiers: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """Links of the first provider that succeeds for each record.

    tiers: name, links (key and more), and whether an empty list is a failure of that provider; one that may be empty settles
    every record it is asked for, so those after it are not asked.
    """
    last = next((k for k, t in enumerate(tiers) if not t[2]), len(tiers) - 1)
    found = first_success(asked, key, [(n, links) for n, links, _ in tiers[: last + 1]])
    return found.withColumnRenamed("tier", "provider")


def two_hop(works: DataFrame, id_map: DataFrame) -> DataFrame:
    """src, dst: the related works of each work as ids of records, by way of the id map (work_id, pmid)."""
    hops = works.select("src", F.posexplode("related").alias("pos", "work_id"))
    return hops.join(id_map, "work_id").where("pmid <> src").groupBy("src", "pmid").agg(F.min("pos").alias("pos")).select("src", F.col("pmid").alias("dst"), "pos")
