"""Spelling by deletion neighbourhoods: words within a few edits share a string that deletions of so many letters make of both.

Each word of the dictionary, and each word asked for, has the hashes of all strings that deletions of up to `edits` letters
leave of it, and the two meet by equality of those; the distance is then worked out for the pairs that met. A pair of words
within two edits always meets, so the result is that of comparing all with all, while only words that look alike are ever
paired; unlike strings of one hash make a pair more, which the distance drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.session import ready_workers

EDITS = 2
#: Words longer than this are met by the hash of their halves instead of their deletions, whose number grows with the square.
LONG = 24
#: Words whose deletions a task holds at a time.
PIECE = 4096
#: Hashes are sums of letters times powers of an odd number, so a deletion moves the letters after it down by its inverse.
BASE = 0x9E3779B97F4A7C15


@cache
def _cuts(size: int, edits: int) -> list[np.ndarray]:
    """For 0 to `edits` deletions, the places of each way to delete so many of `size` letters."""
    return [np.array(list(combinations(range(size), d)), np.int64).reshape(comb(size, d), d) for d in range(min(edits, size) + 1)]


def deletions(words: pa.Array, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct strings that up to `edits` deletions make of each word, itself among them: the word's place, and the hash."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    at, where, hashes = np.cumsum(sizes) - sizes, [], []
    for size in np.unique(sizes).tolist():
        who = np.flatnonzero(sizes == size)
        # letters are told apart by more than their last bits, and words of zeros by their length
        own = (letters[at[who][:, None] + np.arange(size)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(29)
        power = np.array([pow(BASE, k, 1 << 64) for k in range(size)], np.uint64)
        upto = np.zeros((len(who), size + 1), np.uint64)
        np.cumsum(own * power, axis=1, out=upto[:, 1:])
        found = []
        for cuts in _cuts(size, edits):
            edges = np.c_[np.full(len(cuts), -1), cuts, np.full(len(cuts), size)]
            total = np.zeros((len(who), len(cuts)), np.uint64)
            for k in range(edges.shape[1] - 1):
                total += (upto[:, edges[:, k + 1]] - upto[:, edges[:, k] + 1]) * np.uint64(pow(BASE, -k, 1 << 64))
            found.append(total)
        found = np.sort(np.concatenate(found, axis=1), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        where.append(np.repeat(who, new.sum(axis=1)))
        hashes.append(found[new])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, hashes = np.concatenate(where), np.concatenate(hashes).view(np.int64)
    order = np.argsort(where, kind="stable")
    return where[order], hashes[order]


def keyed(rows: DataFrame, column: str, edits: int = EDITS) -> DataFrame:
    """The rows with a key for each of a word's deletions; the words are not null."""
    ready_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                part = whole.slice(at, PIECE)
                where, hashes = deletions(part.column(column), edits)
                cuts = np.searchsorted(where, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(cuts, pa.array(hashes))], names=[*part.schema.names, "keys"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, keys array<long>").select(*rows.columns, F.explode("keys").alias("key"))


def _pieces(word: Column, edits: int) -> Column:
    """For long words: each of edits + 1 parts with its place and those around it; edits leave one part unchanged, moved by `edits` at most."""
    n = edits + 1
    size = F.length(word)
    cut = lambda k: F.expr("0") + F.floor(size * k / n).cast("int")
    return F.array(*(F.concat(F.lit(f"{k}:"), F.substring(word, cut(k) + 1, cut(k + 1) - cut(k))) for k in range(n)))


def _shifted(word: Column, edits: int) -> Column:
    """For long words asked for: what the parts of a dictionary word of any length in reach would be found as."""
    n, parts = edits + 1, []
    for d in range(-edits, edits + 1):
        size = F.length(word) + d
        for k in range(n):
            a, b = F.floor(size * k / n).cast("int"), F.floor(size * (k + 1) / n).cast("int")
            for s in range(-edits, edits + 1):
                parts.append(F.when(a + s >= 0, F.concat(F.lit(f"{k}:"), F.substring(word, a + s + 1, b - a))))
    return F.array_distinct(F.array_compact(F.array(*parts)))


def candidates(asked: DataFrame, dictionary: DataFrame, edits: int = EDITS) -> DataFrame:
    """word, entry (and n) of the pairs that share a deletion, each once. asked: word; dictionary: entry, n."""
    is_long = lambda c: F.length(c) > LONG
    words, entries = asked.select("word").distinct(), dictionary.select("entry", "n")
    a, b = F.col("word"), F.col("entry")
    short = keyed(words.where(~is_long(a)), "word", edits).join(keyed(entries.where(~is_long(b)), "entry", edits), "key").drop("key")
    # a long word may be near one that is just not long
    reach = F.length(b) > LONG - edits
    asks = words.where(F.length(a) > LONG - edits).select("word", F.explode(_shifted(a, edits)).alias("key"))
    far = asks.join(entries.where(reach).select("entry", "n", F.explode(_pieces(b, edits)).alias("key")), "key").where(is_long(a) | is_long(b)).drop("key")
    return short.unionByName(far).where(F.abs(F.length("word") - F.length("entry")) <= edits).select("word", "entry", "n").distinct()


def neighbours(asked: DataFrame, dictionary: DataFrame, edits: int = EDITS) -> DataFrame:
    """word, entry, n, distance of all pairs within `edits` edits, a word itself not among its neighbours."""
    found = candidates(asked, dictionary, edits).where("word <> entry")
    distance = F.levenshtein("word", "entry", edits)
    return found.withColumn("distance", distance).where(F.col("distance") >= 0)


def suggest(asked: DataFrame, dictionary: DataFrame, edits: int = EDITS) -> DataFrame:
    """word, corrected, distance: a word of the dictionary is right; else the nearest one, of those the most frequent, then the first by letters; without any the word itself.

    Null words are left out, repeated ones come once.
    """
    words = asked.where("word IS NOT NULL").select("word").distinct()
    known = words.join(dictionary.select(F.col("entry").alias("word")), "word", "left_semi").select("word", F.col("word").alias("corrected"), F.lit(0).alias("distance"))
    open_ = words.join(dictionary.select(F.col("entry").alias("word")), "word", "left_anti")
    order = Window.partitionBy("word").orderBy("distance", F.desc("n"), "entry")
    best = neighbours(open_, dictionary, edits).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    fixed = open_.join(best.select("word", "entry", "distance"), "word", "left").select("word", F.coalesce("entry", "word").alias("corrected"), F.coalesce("distance", F.lit(-1)).alias("distance"))
    return known.unionAll(fixed)
