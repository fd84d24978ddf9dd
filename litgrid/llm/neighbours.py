"""Approximate nearest neighbours by cross-polytope hashing.

In each table a unit vector is turned by two fast pseudo-rotations, each three rounds of random signs and a Hadamard
transform, and hashed to the nearest signed axis of either. A query looks at the vectors whose two axes are near to it: those
for which the axis' places in the query's own orders multiply to at most a limit (multiprobe). The first axis is the bucket
that vectors are dealt by, the second parts each bucket. The more vectors there are the nearer the nearest ones are, so a
lower limit may do (see `reach`); that it does is measured in each search: some queries are compared with every vector, and
the limit is raised until the search reaches RECALL of what is nearest to them (see `measured_reach`).

Rows of a bucket travel as blocks of vectors in a byte a component, with their ids, and meet blocks of the queries that look
into it; a bucket of any size is many blocks, which a skewed join can split. Where blocks meet, products of the bytes choose
each query's best few; these candidates, RERANKED for each query, are then scored exactly on the vectors as they are. The
rotations follow from a seed; nothing is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgrid.session import ready_checkpoints, ready_workers

TABLES = 10
SEED = 7
#: Candidates of each query that are scored exactly.
RERANKED = 32
#: Queries that are compared with every vector, and the share of their nearest ones that the limit must reach.
SAMPLE, RECALL = 256, 0.97
#: Vectors hashed at once, which bounds the blocks of a bucket; queries in a block, about.
CHUNK = 8192
QUERY_BLOCK = 512
#: Candidates a task gathers before it keeps only the best of each query.
HELD = 1_000_000
#: Vectors of a block from which on its parts by the second axis are scored apart.
PARTED = 2048
BLOCK = "tab int, bucket int, n int, ids binary, codes binary, scales binary, vecs binary"
BLOCK_ARROW = pa.schema([("tab", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("vecs", pa.binary())])
FOUND = "query_id long, vec_id long, score double"


def reach(n: int) -> int:
    """The least limit to the product of places that a query looks at among n vectors (see `measured_reach`)."""
    return max(4, round(2048 / max(1, n) ** 0.25))


def _first(limit: int) -> int:
    """How many axes of the first hash a query goes to."""
    return max(2, -(-limit // 16))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, unscaled; the width is a power of two."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


def axes(unit: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The numbers of the nearest signed axes of each row after the table's rotation, nearest first."""
    width = 1 << max(0, (unit.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width))
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x = hadamard(x * s)
    if probes <= 1:
        at = np.abs(x).argmax(axis=1)
        return (2 * at + (x[np.arange(len(x)), at] > 0))[:, None]
    both = np.stack([-x, x], axis=2).reshape(len(x), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, 2 * width)]


def normal(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to [0.5, 1), which changes no cosine and no digit of its products, but for parts beyond 300 digits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as signed bytes times a scale."""
    unit = normal(x)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _blocks(dims: int, tables: int, first: int, seed: int):
    """For mapInArrow over (vec_id, embedding): packed blocks by table and bucket. first: axes of the first hash that each row goes to, which
    queries do with the place of the axis in codes; vectors go to one, with the second hash there, and are sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                ids = batch.column("vec_id").to_numpy()
                z, scale = _bytes(batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, dims))
                for t in range(tables):
                    buckets = axes(z, 2 * t, abs(first), seed)
                    flat, who = buckets.ravel(), np.repeat(np.arange(len(ids)), buckets.shape[1])
                    code = np.tile(np.arange(buckets.shape[1]), len(ids)) if first > 0 else axes(z, 2 * t + 1, 1, seed)[:, 0]
                    order = np.lexsort((code, flat))
                    cuts = np.flatnonzero(np.diff(flat[order])) + 1
                    rows = []
                    for part in np.split(order, cuts):
                        own = who[part]
                        rows.append((t, int(flat[part[0]]), len(own), ids[own].tobytes(), code[part].astype(np.uint16).tobytes(), scale[own].tobytes(), z[own].tobytes()))
                    yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(BLOCK_ARROW)], schema=BLOCK_ARROW)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Small blocks of one bucket as one."""
    names = ["ids", "codes", "scales", "vecs"]
    rows = sorted(zip(*(table[n].to_pylist() for n in names), strict=True))
    return pa.table({"tab": [table["tab"][0].as_py()], "bucket": [table["bucket"][0].as_py()], "n": [sum(table["n"].to_pylist())], **{n: [b"".join(r[i] for r in rows)] for i, n in enumerate(names)}}, schema=BLOCK_ARROW)


def best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best distinct candidates; ties go to the smaller id."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    # a candidate met in several tables has the same score each time and so stands next to itself
    new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]
    q, v, s = q[new], v[new], s[new]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = place < k
    return q[keep], v[keep], s[keep]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a and the same row of b in double precision, added up dimension by dimension, so that equal vectors score alike."""
    a, b = normal(a), normal(b)
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        left += a[:, i] * a[:, i]
        right += b[:, i] * b[:, i]
    return dot / np.sqrt(left * right)


def _near(dims: int, most: int, limit: int, seed: int):
    """For mapInArrow over joined blocks: each query's best candidates in the task, by products of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def keep(q: np.ndarray, v: np.ndarray, s: np.ndarray, allowed: np.ndarray | None = None) -> None:
            nonlocal n
            s[q[:, None] == v[None, :]] = -np.inf
            if allowed is not None:
                s[~allowed] = -np.inf
            # of each row the best and all that tie with the last of them
            edge = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most, None] if s.shape[1] > most else -np.inf
            i, j = np.nonzero((s >= edge) & (s > -np.inf))
            if len(i):
                held.append(best(q[i], v[j], s[i, j], most))
                n += len(held[-1][0])

        def settle() -> None:
            nonlocal held, n
            if held:
                held = [best(*(np.concatenate(x) for x in zip(*held, strict=True)), most)]
                n = 0

        for batch in batches:
            for r in batch.to_pylist():
                q, v = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                a = np.frombuffer(r["q_vecs"], np.int8).reshape(-1, dims).astype(np.float32)
                b = np.frombuffer(r["vecs"], np.int8).reshape(-1, dims)
                place, code = np.frombuffer(r["q_codes"], np.uint16).astype(np.int64) + 1, np.frombuffer(r["codes"], np.uint16)
                x, y = np.frombuffer(r["q_scales"], np.float32), np.frombuffer(r["scales"], np.float32)
                # the axes of the second hash that each query looks at
                order = axes(a, 2 * r["tab"] + 1, 1 << 16, seed)
                looks = np.zeros(order.shape, bool)
                np.put_along_axis(looks, order, np.arange(1, order.shape[1] + 1) * place[:, None] <= limit, axis=1)
                if len(v) < PARTED:
                    keep(q, v, (a @ b.T.astype(np.float32)) * x[:, None] * y[None, :], looks[:, code])
                else:
                    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
                    for i, j in zip(cuts, cuts[1:], strict=False):
                        who = np.flatnonzero(looks[:, code[i]])
                        if len(who):
                            keep(q[who], v[i:j], (a[who] @ b[i:j].T.astype(np.float32)) * x[who, None] * y[None, i:j])
                if n > HELD:
                    settle()
        settle()
        for q, v, s in held:
            yield pa.record_batch([pa.array(q), pa.array(v), pa.array(s.astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def _exact(dims: int):
    """For mapInArrow over (query_id, vec_id, a, b): the cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(n).flatten().to_numpy().astype(np.float64).reshape(-1, dims) for n in ("a", "b"))
            yield pa.record_batch([batch.column("query_id"), batch.column("vec_id"), pa.array(cosines(a, b) if len(a) else np.zeros(0))], names=["query_id", "vec_id", "score"])

    return run


def _truth(ids: np.ndarray, q: np.ndarray, k: int):
    """For mapInArrow over (vec_id, embedding): of all vectors of the task the k nearest to each of a few queries, by looking at all."""
    q = normal(q)
    q /= np.sqrt((q * q).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, s, x = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0)), np.zeros((len(q), 0, q.shape[1]))
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                part = whole.slice(at, CHUNK)
                own, vecs = part.column("vec_id").to_numpy(), part.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, q.shape[1])
                unit = normal(vecs)
                score = q @ (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).T
                score[ids[:, None] == own[None, :]] = -np.inf
                best = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(own) > k else np.tile(np.arange(len(own)), (len(q), 1))
                v, s, x = np.hstack([v, own[best]]), np.hstack([s, np.take_along_axis(score, best, 1)]), np.concatenate([x, vecs[best]], axis=1)
                kept = np.argsort(-s, axis=1, kind="stable")[:, :k]
                v, s, x = np.take_along_axis(v, kept, 1), np.take_along_axis(s, kept, 1), np.take_along_axis(x, kept[:, :, None], 1)
        i, j = np.nonzero(s > -np.inf)
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x[i, j].ravel()), q.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.record_batch([pa.array(ids[i]), pa.array(v[i, j]), pa.array(s[i, j]), vectors], names=["query_id", "vec_id", "score", "embedding"])

    return run


def needed(q: np.ndarray, v: np.ndarray, tables: int, seed: int = SEED) -> np.ndarray:
    """The least limit by which a search finds each row of v from the same row of q."""
    (q, _), (v, _) = _bytes(q), _bytes(v)
    least = np.full(len(q), np.iinfo(np.int64).max)
    for t in range(tables):
        first, second = ((axes(q, h, 1 << 16, seed) == axes(v, h, 1, seed)).argmax(axis=1).astype(np.int64) + 1 for h in (2 * t, 2 * t + 1))
        # within the limit, and in a bucket that the query goes to
        least = np.minimum(least, np.maximum(first * second, np.where(first > _first(0), 16 * (first - 1) + 1, 0)))
    return least


def measured_reach(vectors: DataFrame, queries: DataFrame, dims: int, k: int, tables: int, seed: int, n: int) -> int:
    """The limit that reaches RECALL of the k nearest vectors of up to SAMPLE queries, found by comparing these with all; `reach(n)` at least."""
    order = F.xxhash64("vec_id"), "vec_id"
    sample = queries.orderBy(*order).limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return reach(n)
    ids = sample["vec_id"].to_numpy()
    ids, at = np.unique(ids, return_index=True)
    q = np.array(sample["embedding"].to_pylist(), np.float64)[at]
    found = vectors.mapInArrow(_truth(ids, q, k), f"{FOUND}, embedding array<double>")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "embedding").toArrow()
    if not best.num_rows:
        return reach(n)
    least = np.sort(needed(q[np.searchsorted(ids, best["query_id"].to_numpy())], np.array(best["embedding"].to_pylist(), np.float64), tables, seed))
    return max(reach(n), int(least[min(len(least) - 1, int(np.ceil(RECALL * len(least))) - 1)]))


def _search(vectors: DataFrame, queries: DataFrame, dims: int, k: int, tables: int, limit: int, salts: int, seed: int) -> DataFrame:
    most = max(RERANKED, 2 * k)
    axes_count = 2 << max(0, (dims - 1).bit_length())
    first = min(axes_count, _first(limit))
    index = vectors.mapInArrow(_blocks(dims, tables, -1, seed), BLOCK)
    small = queries.mapInArrow(_blocks(dims, tables, first, seed), BLOCK)
    asked = small.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).groupBy("tab", "bucket", "salt").applyInArrow(_merge, BLOCK)
    pairs = index.join(asked.select("tab", "bucket", *(F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "scales", "vecs"))), ["tab", "bucket"])
    near = pairs.select("tab", "ids", "codes", "scales", "vecs", "q_ids", "q_codes", "q_scales", "q_vecs").mapInArrow(_near(dims, most, limit, seed), FOUND)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("near"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("place") <= most)
    chosen = ranked.select("query_id", "vec_id").join(vectors.withColumnRenamed("embedding", "b"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id")
    return chosen.select("query_id", "vec_id", "a", "b").mapInArrow(_exact(dims), FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, limit: int | None = None, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) of each query's k nearest vectors found, itself left out.

    vectors, queries: vec_id, embedding (an array of numbers); other columns, whatever their names, are not read. Vectors that
    are null or zero or hold a null or non-finite component take no part, nor do rows with a null id, nor those whose length
    is not that of most vectors (of equally many the shorter). Ties go to the smaller id. Rows of one id are one vector, with
    the better score, and a query's own id is no candidate (nearest_in tells such rows apart). limit: the product of places looked at (`measured_reach`, if None). A query
    that finds fewer than k vectors looks at all; it has fewer rows only if there are no more vectors. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ready_workers(spark)
    ready_checkpoints(spark)
    vectors, queries = (_sound(x) for x in (vectors, queries))
    sizes = vectors.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes[0]["dims"], sizes[0]["count"]
    vectors, queries = (x.where(F.size("embedding") == dims) for x in (vectors, queries))
    axes_count = 2 << max(0, (dims - 1).bit_length())
    limit = measured_reach(vectors, queries, dims, k, tables, seed, n) if limit is None else limit
    salts = max(1, queries.count() * _first(limit) // (axes_count * QUERY_BLOCK))
    found = _top(_search(vectors, queries, dims, k, tables, limit, salts, seed), k).checkpoint()
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    few = queries.join(enough, "vec_id", "left_anti").checkpoint()
    if few.isEmpty():
        return found
    rest = _top(_search(vectors, few, dims, k, 1, 16 * axes_count**2, salts, seed), k)
    return found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def nearest_in(vectors: DataFrame, is_query: str, k: int = 5, tables: int = TABLES, limit: int | None = None, seed: int = SEED) -> DataFrame:
    """The same for those rows of one table that are queries, by a condition on vec_id; each row is a candidate and, if it is one, a query of its own.

    Rows that repeat an id are told apart: all but the query's own row are its candidates, and each query has its k rows.
    """
    sound = _sound(vectors)
    if sound.groupBy("vec_id").count().where("count > 1").limit(1).isEmpty():
        return nearest(vectors, vectors.where(is_query), k, tables, limit, seed)
    ready_checkpoints(vectors.sparkSession)
    # numbers in the order of the ids, so that ties go to the smaller id as before
    rows = sound.orderBy("vec_id").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    own = lambda x: x.select(F.col("row").alias("vec_id"), "embedding")
    found = nearest(own(rows), own(rows.where(is_query)), k, tables, limit, seed).withColumnsRenamed({"query_id": "q_row", "vec_id": "v_row"})
    named = lambda row, name: rows.select(F.col("row").alias(row), F.col("vec_id").alias(name))
    return found.join(named("q_row", "query_id"), "q_row").join(named("v_row", "vec_id"), "v_row").select("query_id", "rank", "vec_id", "score")


def _sound(x: DataFrame) -> DataFrame:
    """vec_id, embedding as floats if they are, else doubles."""
    kind = dict(x.dtypes)["embedding"]
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "array<float>" else "array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    largest = F.lit(1.7976931348623157e308)
    fine = F.forall("embedding", lambda c: F.coalesce(c.cast("double").between(-largest, largest), F.lit(False))) & F.exists("embedding", lambda c: c != 0)
    return x.where(fine)


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_cross_polytope_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest_in(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")

