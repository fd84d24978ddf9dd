"""Similar records by their texts: a similarity join of weighted term vectors, in blocks.

A text is a unit vector of its words, weighted by how often they stand in it and how few texts have them. Texts travel as
blocks of sparse vectors. Every block of queries meets every block of texts in a task, where the similarities are added up, of
frequent words as a product of matrices and of the others pair by pair; only each query's best leave the task. So no pair is
ever a row, a task holds two blocks and their matrix, and what lies on disk grows with the texts; the time grows with their
number times that of the queries.

Blocks are of texts of one kind, by a clustering of a sample's frequent words: texts of two kinds, as of two languages, share
few words, so that their blocks cost little. Kinds are a matter of time only: what the words that two blocks share leave
possible (Cauchy and Schwarz) is looked at in full, whatever the kinds. Products of matrices are in single precision, whose
error is bounded; each pair that may be among a query's best is added up again in double precision.

Words are told apart by 64 bits of hash (among 10 million words two are alike with a chance of 1 in 370,000).

For least similarities that rule out most pairs there is also the prefix filter: words are ordered by the number of texts that
have them, the rarest first, and a vector's prefix is what must be taken of it until the rest is shorter than the least
similarity that counts; two texts that are similar enough share a word of both prefixes (`vectors`, `candidate_pairs`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from litgrid.session import ready_checkpoints, ready_workers

LEAST = 0.2
#: Texts, words and queries in a block; a task holds a few matrices of BLOCK_QUERIES by BLOCK_TEXTS.
BLOCK_TEXTS, BLOCK_WORDS, BLOCK_QUERIES = 2048, 500_000, 1024
#: Queries whose blocks a task meets its texts with, one block after the other; texts of a task that makes blocks.
PACK_QUERIES, TASK_TEXTS = 4096, 50_000
#: Kinds of texts, the texts and frequent words they are learned from, and words of a text for that.
KINDS, SAMPLE_TEXTS, SAMPLE_TERMS, SAMPLE_WORDS = 8, 2048, 512, 256
#: Share of a matrix from which on a word's pairs are a product of matrices, and pairs that are added up at once.
DENSE, PAIRS = 0.002, 500_000
_COUNTED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("entries", pa.int64()), ("ids", pa.binary()), ("asked", pa.binary()), ("words", pa.list_(pa.int64())), ("per", pa.list_(pa.int32())), ("counts", pa.binary())])
_WEIGHED = pa.schema([("kind", pa.int32()), ("n", pa.int64()), ("terms", pa.int64()), ("entries", pa.int64()), ("ids", pa.binary()), ("asked", pa.binary()), ("numbers", pa.binary())])
_ASKED = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("words", pa.binary()), ("weights", pa.binary())])
_PACKED = pa.schema([("q_n", pa.int64()), ("q_terms", pa.int64()), ("q_entries", pa.int64()), ("q_numbers", pa.binary())])


def vectors(rows: DataFrame) -> DataFrame:
    """id, terms (their numbers by rarity, rising), weights (of length one), prefix (how many of them); rows: id, words. Texts without words that tell them apart have no vector."""
    ready_checkpoints(rows.sparkSession)
    rows = rows.where("id IS NOT NULL")
    n = rows.count()
    counted = rows.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))
    df = counted.groupBy("word").agg(F.count("*").alias("df")).checkpoint()
    # a word's number only has to follow its rarity and be its own: the number of texts, then its place among words as common
    place = F.row_number().over(Window.partitionBy("df").orderBy("word"))
    numbered = df.where(F.col("df") < n).withColumn("term", F.col("df") * F.lit(1 << 32) + place)
    weight = F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))
    rowed = counted.join(numbered, "word").select("id", F.struct("term", weight.alias("w")).alias("t"))
    listed = rowed.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.sqrt(F.sum(F.col("t.w") * F.col("t.w"))).alias("norm"))
    return listed.select("id", F.transform("t", lambda t: t["term"]).alias("terms"), F.transform("t", lambda t: t["w"] / F.col("norm")).alias("weights"))


def _prefixes(least: float):
    """For mapInArrow over (id, terms, weights): id, term of each vector's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, t, w in zip(batch.column("id").to_pylist(), batch.column("terms"), batch.column("weights"), strict=True):
                t, w = t.values.to_numpy(), w.values.to_numpy()
                rest = np.sqrt(np.cumsum((w * w)[::-1]))[::-1]  # the length of what begins here
                keep = t[rest >= least * (1 - 1e-9)]
                ids.append(np.full(len(keep), i, np.int64))
                terms.append(keep)
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(terms))], names=["id", "term"])

    return run


def candidate_pairs(queries: DataFrame, all_: DataFrame, least: float) -> DataFrame:
    """query_id, id of the vectors that share a word of both prefixes, each pair once."""
    q = queries.mapInArrow(_prefixes(least), "id long, term long").withColumnRenamed("id", "query_id")
    d = all_.mapInArrow(_prefixes(least), "id long, term long")
    return q.join(d, "term").where("query_id <> id").select("query_id", "id").distinct()


def _zip(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), 1)


def _unzip(data: bytes, *parts: tuple[type, int]) -> list[np.ndarray]:
    data, at, out = zlib.decompress(data), 0, []
    for kind, n in parts:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _kinds(sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Frequent words of a sample of texts, rising, and for each word and kind the weight with which it speaks for the kind: spherical k-means."""
    own, n = [np.unique(x, return_counts=True) for x in sample if len(x)], len(sample)
    words, df = np.unique(np.concatenate([w for w, _ in own] or [np.zeros(0, np.int64)]), return_counts=True)
    telling = np.flatnonzero(df < n)
    kept = np.sort(telling[np.argsort(-df[telling], kind="stable")[:SAMPLE_TERMS]])
    words, idf = words[kept], np.log(n / df[kept])
    x = np.zeros((len(own), len(words)))
    for i, (w, c) in enumerate(own):
        _, a, b = np.intersect1d(w, words, assume_unique=True, return_indices=True)
        x[i, b] = c[a] * idf[b]
    norm = np.sqrt((x * x).sum(axis=1))
    x = x[norm > 0] / norm[norm > 0, None]
    if len(x) < KINDS:
        return words, np.zeros((len(words), 1))
    # each centre begins as the text that is least like those before
    centres = x[:1]
    for _ in range(KINDS - 1):
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
    for _ in range(20):
        nearest = (x @ centres.T).argmax(axis=1)
        for k in np.unique(nearest):
            mean = x[nearest == k].sum(axis=0)
            centres[k] = mean / np.sqrt((mean * mean).sum())
    return words, idf[:, None] * centres.T


def _by_kind(batches: Iterator[pa.RecordBatch], kinds, size, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of a kind, up to `most` with together BLOCK_WORDS words, one row at least. kinds, size: each row's kind and number of words."""

    def cut(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        whole = pa.concat_batches(parts)
        sizes, out, at = np.cumsum(size(whole)), [], 0
        while at < whole.num_rows:
            fit = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_WORDS, "right"))
            end = min(whole.num_rows, at + most, max(at + 1, fit))
            out.append(whole.slice(at, end - at))
            at = end
        return out

    held: dict[int, list[pa.RecordBatch]] = {}  # what fills no block yet
    room: dict[int, list[int]] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            part = whole.slice(at, most)
            kind = kinds(part)
            for k in np.unique(kind).tolist():
                own = part.take(pa.array(np.flatnonzero(kind == k)))
                held.setdefault(k, []).append(own)
                rows, words = room.get(k, (0, 0))
                room[k] = [rows + own.num_rows, words + int(size(own).sum())]
                if room[k][0] >= most or room[k][1] >= BLOCK_WORDS:
                    *full, last = cut(held[k])
                    yield from ((k, x) for x in full)
                    held[k], room[k] = [last.take(pa.array(range(last.num_rows)))], [last.num_rows, int(size(last).sum())]  # without what it was cut from
                    del full, last
        del whole, part, own  # before the next is read
    for k in sorted(held):
        yield from ((k, x) for x in cut(held[k]))


def _count(frequent: np.ndarray, weights: np.ndarray):
    """For mapInArrow over (id, asked, words as hashes): blocks of texts of a kind with their distinct words, in how many texts of the block each is, and the counts by word and text."""

    def kinds(part: pa.RecordBatch) -> np.ndarray:
        words, n = part.column("words").flatten().to_numpy(), part.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if not len(frequent):
            return np.zeros(len(n), np.int64)
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        own = np.flatnonzero(frequent[at] == words)
        counts = np.bincount(np.repeat(np.arange(len(n)), n)[own] * len(frequent) + at[own], minlength=len(n) * len(frequent))
        return (counts.reshape(len(n), -1) @ weights).argmax(axis=1)

    def block(number: int, kind: int, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, asked = part.column("id").to_numpy(), part.column("asked").to_numpy(zero_copy_only=False).astype(np.uint8)
        n = part.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words, own = np.unique(part.column("words").flatten().to_numpy(), return_inverse=True)
        own *= len(ids)
        own += np.repeat(np.arange(len(ids)), n)
        key, tf = np.unique(own, return_counts=True)
        word, text = key // len(ids), key % len(ids)
        per = np.bincount(word, minlength=len(words)).astype(np.int32)
        numbers = number, kind, len(ids), len(key), ids.tobytes(), asked.tobytes(), words, per, _zip(text.astype(np.int32), tf.astype(np.int32))
        return pa.record_batch([pa.array([x], t) for x, t in zip(numbers, _COUNTED.types, strict=True)], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        size = lambda part: part.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for number, (kind, part) in enumerate(_by_kind(batches, kinds, size, BLOCK_TEXTS)):
            yield block(first + number, kind, part)

    return run


def _weigh(n: int):
    """For a block and the words of it that other texts have too (at, df): its texts' weights, by word."""

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for r in block.to_pylist():
            words, per = np.array(r["words"], np.int64), np.array(r["per"], np.int64)
            text, tf = _unzip(r["counts"], (np.int32, r["entries"]), (np.int32, r["entries"]))
            df = per.copy()  # words that are not told of are in one text alone, this one
            df[known["at"].to_numpy()] = known["df"].to_numpy()
            idf = np.log(n / df)
            own = np.repeat(np.arange(len(words)), per)
            norm = np.sqrt(np.bincount(text, (tf * idf[own]) ** 2, r["n"]))
            keep = (df > 1) & (df < n)  # others are in one text alone, or tell none apart
            kept = keep[own]
            numbers = _zip(words[keep], idf[keep], norm, per[keep].astype(np.int32), text[kept], tf[kept])
            out.append({"kind": r["kind"], "n": r["n"], "terms": int(keep.sum()), "entries": int(kept.sum()), "ids": r["ids"], "asked": r["asked"], "numbers": numbers})
        return pa.Table.from_pylist(out, schema=_WEIGHED)

    return run


def _columns(n: int, terms: int, entries: int, numbers: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's terms, how many texts have each, and by term the texts' places and weights."""
    words, idf, norm, per, text, tf = _unzip(numbers, (np.int64, terms), (np.float64, terms), (np.float64, n), (np.int32, terms), (np.int32, entries), (np.int32, entries))
    return words, per.astype(np.int64), text.astype(np.int64), tf * np.repeat(idf, per) / norm[text]


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over weighed blocks: their queries as rows."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["asked"], np.uint8)
            words, per, text, w = _columns(r["n"], r["terms"], r["entries"], r["numbers"])
            mine = np.flatnonzero(asked[text])
            order = mine[np.argsort(text[mine], kind="stable")]
            word, text, w = np.repeat(words, per)[order], text[order], w[order]
            who = np.flatnonzero(asked)
            cuts = np.searchsorted(text, np.append(who, r["n"]))
            rows = [(int(ids[i]), r["kind"], word[a:b].tobytes(), w[a:b].tobytes()) for i, a, b in zip(who, cuts, cuts[1:], strict=False) if b > a]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ASKED.types, strict=True)], schema=_ASKED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over queries: blocks of them, by word."""
    kinds = lambda part: part.column("kind").to_numpy()
    size = lambda part: np.array([len(x) // 8 for x in part.column("words").to_pylist()])
    for _, part in _by_kind(batches, kinds, size, BLOCK_QUERIES):
        word, w = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("words", np.int64), ("weights", np.float64)))
        own = np.repeat(np.arange(part.num_rows), size(part))
        order = np.argsort(word, kind="stable")
        words, per = np.unique(word[order], return_counts=True)
        numbers = [part.column("id").to_numpy(), words, w[order], per.astype(np.int32), own[order].astype(np.int32)]
        yield pa.record_batch([pa.array([x]) for x in (part.num_rows, len(words), len(word), b"".join(x.tobytes() for x in numbers))], schema=_PACKED)


def _asked_of(r: dict) -> tuple[np.ndarray, tuple]:
    """The ids of a block of queries; its terms, how many queries have each, and by term the queries' places and weights."""
    n, terms, entries, at, out = r["q_n"], r["q_terms"], r["q_entries"], 0, []
    for kind, size in ((np.int64, n), (np.int64, terms), (np.float64, entries), (np.int32, terms), (np.int32, entries)):
        out.append(np.frombuffer(r["q_numbers"], kind, size, at))
        at += out[-1].nbytes
    ids, words, w, per, own = out
    return ids, (words, per.astype(np.int64), own.astype(np.int64), w)


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and on, n of each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Side:
    """Entries of a block, by the words it shares with another: the word, the place of the query or text, and the weight."""

    def __init__(self, n: int, word: np.ndarray, at: np.ndarray, w: np.ndarray):
        self.n, self.word, self.at, self.w = n, word, at, w

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.at, self.w * self.w, self.n))

    def only(self, rows: np.ndarray) -> Side:
        """The same for some of the queries or texts."""
        if len(rows) == self.n:
            return self
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        at = place[self.at]
        g = np.flatnonzero(at >= 0)
        return Side(len(rows), self.word[g], at[g], self.w[g])

    def matrix(self, columns: np.ndarray, n: int, kind: type) -> np.ndarray:
        """Weights by place and column, the column of each word that has one."""
        out = np.zeros((self.n, n), kind)
        c = columns[self.word]
        g = np.flatnonzero(c >= 0)
        out[self.at[g], c[g]] = self.w[g]
        return out


def _shared(q: tuple, d: tuple, rows: int, columns: int) -> tuple[int, Side, Side]:
    """How many words two blocks share, and their entries of these."""
    (q_words, q_per, q_at, q_w), (words, per, at, w) = q, d
    if not len(q_words) or not len(words):
        return 0, *(Side(n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for n in (rows, columns))
    place = np.minimum(np.searchsorted(words, q_words), len(words) - 1)
    a = np.flatnonzero(words[place] == q_words)
    b, sides = place[a], []
    for n, own, per_, at_, w_ in ((rows, a, q_per, q_at, q_w), (columns, b, per, at, w)):
        e = _places((np.cumsum(per_) - per_)[own], per_[own])
        sides.append(Side(n, np.repeat(np.arange(len(own)), per_[own]), at_[e], w_[e]))
    return len(a), *sides


def _reachable(q: np.ndarray, d: np.ndarray, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of one or two parts of the matrix that hold all places where q times d, the lengths of what is shared, comes to the row's floor."""
    need = np.divide(floor, q, out=np.full(len(q), np.inf), where=q > 0)
    by = np.argsort(-d, kind="stable")
    least = np.sort(need)
    n = np.searchsorted(least, d[by], "right")  # rows that a column can reach, falling
    used = int(np.searchsorted(-n, 0, "left"))  # columns that reach any
    if not used:
        return []
    # few long columns with all their rows, the others with theirs; in two parts only where that saves a quarter
    area = np.arange(used) * n[0] + (used - np.arange(used)) * n[:used]
    cut = int(area.argmin())
    cuts = [0, cut, used] if area[cut] < 0.75 * used * n[0] and cut else [0, used]
    return [(np.flatnonzero(need <= d[by[a]]), np.sort(by[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _sparse(q: Side, d: Side, q_n: np.ndarray, d_n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What these words, in so many of the queries and texts, add to each pair's similarity."""
    fits = min(int((q_n * d_n)[words].sum()), PAIRS + max(len(q.word), len(d.word)))
    out, places, terms, n = None, np.empty(fits, np.int64), np.empty(fits), 0

    def settle() -> None:
        nonlocal out, n
        more = np.bincount(places[:n], terms[:n], q.n * d.n) if n else np.zeros(q.n * d.n)
        out, n = more if out is None else np.add(out, more, out=out), 0

    fewer = q_n[words] <= d_n[words]
    # the first entry that the side with fewer has of each word with all of the other's, then the second, of the words that have one
    for a, b, a_n, b_n, a_step, b_step, own in ((q, d, q_n, d_n, d.n, 1, words[fewer]), (d, q, d_n, q_n, 1, d.n, words[~fewer])):
        own = own[np.argsort(-a_n[own], kind="stable")]
        first, many, times = (np.cumsum(a_n) - a_n)[own], a_n[own], b_n[own]
        e, ends = _places((np.cumsum(b_n) - b_n)[own], times), np.cumsum(times)
        place, w = b.at[e] * b_step, b.w[e]
        for j in range(int(many[0]) if len(own) else 0):
            m = int(np.searchsorted(-many, -j, "left"))
            end = int(ends[m - 1])
            np.add(np.repeat(a.at[first[:m] + j] * a_step, times[:m]), place[:end], out=places[n : n + end])
            np.multiply(np.repeat(a.w[first[:m] + j], times[:m]), w[:end], out=terms[n : n + end])
            n += end
            if n > PAIRS:
                settle()
    settle()
    return out.reshape(q.n, d.n)


def _scores(terms: int, q: Side, d: Side, floor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of all pairs that reach the row's floor and may be among the row's `most` best or tie with them."""
    q_n, d_n = np.bincount(q.word, minlength=terms), np.bincount(d.word, minlength=terms)
    pairs = q_n * d_n
    dense = pairs > DENSE * q.n * d.n
    width = int(dense.sum())
    near, error, single = _sparse(q, d, q_n, d_n, np.flatnonzero(~dense & (pairs > 0))), 0.0, None
    if width:
        columns = np.where(dense, np.cumsum(dense) - 1, -1)
        single = q.matrix(columns, width, np.float32) @ d.matrix(columns, width, np.float32).T
        near += single
        error = (width + 8) * 2.0**-23  # twice what sums of products of unit vectors in single precision may miss
    i, j = np.nonzero(near >= (floor - error)[:, None])
    if len(i) > 2 * most * q.n and d.n > most:
        edge = np.partition(near, d.n - most, axis=1)[:, d.n - most]
        keep = near[i, j] >= (edge - 2 * error - 1e-6)[i]  # what rounds alike is decided by ids
        i, j = i[keep], j[keep]
    s = near[i, j]
    if width:
        s -= single[i, j]  # its place is taken by the sum in double precision
        rows, i_ = np.unique(i, return_inverse=True)
        texts, j_ = np.unique(j, return_inverse=True)
        a, b = q.only(rows).matrix(columns, width, np.float64), d.only(texts).matrix(columns, width, np.float64)
        step = max(1, PAIRS // width)
        for k in range(0, len(i), step):
            s[k : k + step] += np.einsum("ij,ij->i", a[i_[k : k + step]], b[j_[k : k + step]])
    return i, j, s


def _best(k: int, least: float):
    """For mapInArrow over pairs of blocks: of each query the k best of the task, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, d = None, None
        names: dict[int, np.ndarray] = {}  # a block's queries, by the first of them
        held: dict[int, list[np.ndarray]] = {}  # places of these, what they found, the scores, and the least that counts for each query

        def meet(r: dict) -> None:
            nonlocal last, d
            if last is None or last != r["ids"].to_pybytes():  # a block of texts meets one block of queries after the other
                last, d = r["ids"].to_pybytes(), _columns(r["n"], r["terms"], r["entries"], r["numbers"])
            ids, (asked, q) = np.frombuffer(last, np.int64), _asked_of(r)
            first = int(asked[0])
            if first not in held:
                names[first], held[first] = asked.copy(), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(asked), least)]
            best = held[first]
            floor = np.maximum(best[3] - 1e-6, 1e-7)  # scores are rounded
            terms, left, right = _shared(q, d, len(asked), len(ids))
            for rows, columns in _reachable(left.lengths(), right.lengths(), floor):
                i, j, s = _scores(terms, left.only(rows), right.only(columns), floor[rows], k + 1)
                i, what, s = rows[i], ids[columns[j]], np.round(s, 6)
                good = (asked[i] != what) & (s >= best[3][i])
                if good.any():
                    i, what, s = (np.concatenate(x) for x in zip(best[:3], (i[good], what[good], s[good]), strict=True))
                    order = np.lexsort((what, -s, i))
                    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
                    best[:3] = (x[order[place < k]] for x in (i, what, s))
                    full = order[place == k - 1]
                    best[3][i[full]] = s[full]

        for batch in batches:
            for row in range(batch.num_rows):
                cells = {c: batch.column(c)[row] for c in batch.schema.names}
                meet({c: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for c, x in cells.items()})
            del batch, cells  # before the next is read
        for first, (i, what, s, _) in held.items():
            yield pa.record_batch([pa.array(c) for c in (names[first][i], what, s)], names=["query_id", "id", "score"])

    return run


def similar_texts(rows: DataFrame, is_query, k: int, least: float = LEAST) -> DataFrame:
    """query_id, pos, id, score: the k texts most similar to each query, itself left out, of a similarity of `least` (over 0) or more; ties by id.

    rows: id (long), words; is_query: a condition on id. The words of a repeated id are one text's. Scores are rounded to six decimals.
    """
    spark = rows.sparkSession
    ready_workers(spark)
    ready_checkpoints(spark)
    rows = rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "words")
    n, distinct = rows.select("id").agg(F.count("*"), F.count_distinct("id")).first()
    if distinct < n:
        rows = rows.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
    asked = F.coalesce(F.expr(is_query) if isinstance(is_query, str) else is_query, F.lit(False)).alias("asked")
    hashed = rows.select("id", asked, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, distinct // SAMPLE_TEXTS))) == 0).limit(2 * SAMPLE_TEXTS) if distinct > BLOCK_TEXTS else rows.limit(0)
    sample = sample.select(F.slice(F.transform("words", lambda w: F.xxhash64(w)), 1, SAMPLE_WORDS).alias("words")).where("words IS NOT NULL").toArrow()
    kinds = _kinds([x.values.to_numpy() for x in sample["words"]])
    tasks = max(spark.sparkContext.defaultParallelism, distinct // TASK_TEXTS)  # blocks are of one task's texts and of a kind
    blocks = hashed.coalesce(tasks).mapInArrow(_count(*kinds), from_arrow_schema(_COUNTED)).checkpoint()
    n_blocks = max(1, blocks.count())
    parts = min(n_blocks, 4 * spark.sparkContext.defaultParallelism)  # each gives k rows a query at most
    found = blocks.select("block", F.posexplode(F.arrays_zip("words", "per")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.per").alias("per"))
    known = found.withColumn("df", F.sum("per").over(Window.partitionBy("word"))).where("df > 1").select("block", "at", "df")
    weighed = blocks.repartition(parts, "block").groupBy("block").cogroup(known.repartition(parts, "block").groupBy("block")).applyInArrow(_weigh(n), from_arrow_schema(_WEIGHED)).checkpoint()
    queries = weighed.mapInArrow(_queries, from_arrow_schema(_ASKED)).checkpoint()
    packed = queries.repartition(1 + queries.count() // PACK_QUERIES).mapInArrow(_pack, from_arrow_schema(_PACKED)).checkpoint()
    scored = weighed.crossJoin(packed).mapInArrow(_best(k, least), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
