"""Phrase collocation mining: words and pairs ranked by frequency, counted in tiles of their ranks.

Three passes over the texts. The first counts words. The frequent ones get ranks, the most frequent first; a bounded head of
them is told to all tasks, so that a pair of words is a cell of a matrix whose mass lies in the corner of small ranks. The
second counts pairs: a batch sorts its pairs into tiles of BLOCK by BLOCK ranks; tiles that are full enough are counted by a
dense bincount over the cell's address, the others as sorted coordinates. Frequent pairs are ranked again in the same way,
and the third pass counts triples as pairs of a pair's rank and a word's rank, by the same tiles.

What is frequent but beyond the head is known to the tasks by a bit map of bounded size, of hashes: it may take something rare
for frequent, which costs a row and is dropped when its count is known, but never the other way round. Phrases with a part
beyond the head travel as what they are instead of ranks. Tasks send a row for each distinct phrase of a batch, and Spark
adds those up; no word, pair or language is a task of its own.

A phrase can only be frequent if all its parts are, so nothing is lost by looking at frequent parts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.llm.batches import give_back, pieces
from litgrid.llm.bytesops import ODD, Words, as_bytes, lower_table, mix, word_hashes
from litgrid.session import ready_checkpoints, ready_workers

U64 = np.uint64
LEAST = 10
#: Words and pairs of the head: as many at most, and bytes of the words.
HEAD, HEAD_BYTES = 1 << 19, 12 << 20
#: Bits of the map of what is frequent beyond the head; it is sent in slots.
MAP_BITS, SLOT_BITS = 26, 15
#: Ranks on a side of a tile, and the share of its cells that makes it dense.
BLOCK, DENSE = 1 << 11, 16
#: Bytes of text worked on at once; longer texts are cut at the ends of pieces.
BATCH_BYTES = 12 << 20
#: Parts of a language's candidates that are ranked before the whole.
PARTS = 32
OUT_ROWS = 1 << 16


def _separators() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    return t


def _word_bytes() -> np.ndarray:
    t = ~_separators()
    t[[0x20, 0x09]] = False
    return t


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a long text that end where a piece ends; a piece that is longer than the limit stays whole."""
    at, marks = 0, np.flatnonzero(_separators()[np.frombuffer(text, np.uint8)]) if len(text) > limit else None
    while marks is not None and len(text) - at > limit:
        k = np.searchsorted(marks, at + limit)
        if k and marks[k - 1] >= at:
            end = int(marks[k - 1]) + 1
        elif k < len(marks):
            end = int(marks[k]) + 1
        else:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class _Texts:
    """The words of texts of one language: each distinct one once, which each occurrence is, and which stand before another of the same piece."""

    def __init__(self, texts: list[bytes]) -> None:
        w = Words(texts, _word_bytes(), lower=True, hashes=False)
        cuts = np.zeros(len(w.buf) + 1, np.int32)
        np.cumsum(_separators()[w.buf], out=cuts[1:])
        piece = cuts[w.starts]
        self.joined = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1]) if len(piece) else np.zeros(0, bool)
        packed = w.buf[_word_bytes()[w.buf]]
        offsets = np.zeros(len(w.lens) + 1, np.int32)
        np.cumsum(w.lens, out=offsets[1:])
        every = pa.Array.from_buffers(pa.binary(), len(w.lens), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = every.dictionary_encode()
        self.words, self.of = coded.dictionary, coded.indices.to_numpy()

    def hashes(self) -> np.ndarray:
        """A hash of each distinct word."""
        lens = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        return word_hashes(np.frombuffer(b"".join(self.words.to_pylist()), np.uint8), lens)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, BATCH_BYTES or a little more at a time."""
    for batch in batches:
        for part in pieces(batch, limit=BATCH_BYTES):
            lang, texts = part.column("lang").dictionary_encode(), part.column("text")
            codes = lang.indices.to_numpy()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                own = as_bytes(texts.take(pa.array(np.flatnonzero(codes == code))))
                size, group = 0, []
                for text in own:
                    for x in _cut(text, BATCH_BYTES):
                        if group and size + len(x) > BATCH_BYTES:
                            yield name, group
                            size, group = 0, []
                        group.append(x)
                        size += len(x)
                yield name, group
        give_back()


def _language_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return word_hashes(data, np.array([len(data)], np.int64))[0] if len(data) else U64(0)


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes * ODD) >> U64(64 - bits)).astype(np.int64)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _word_keys(hashes: np.ndarray, lang: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + _language_hash(lang))


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * ODD + second)


def tiles(first: np.ndarray, second: np.ndarray, block: int = BLOCK, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of ranks, as first << 32 | second, and how often each occurs.

    Tiles of block by block ranks with as many pairs as a `dense`-th of their cells are counted by address, the others in order of their coordinates.
    """
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = int(second.max()) // block + 1
    tile = (first // block) * wide + second // block
    full = np.zeros(0, np.int64)
    if wide * (int(first.max()) // block + 1) <= 1 << 20:
        full = np.flatnonzero(np.bincount(tile) * dense >= block * block)
    codes, counts, rest = [], [], np.ones(len(first), bool)
    for t in full.tolist():
        own = np.flatnonzero(tile == t)
        rest[own] = False
        cells = np.bincount((first[own] % block) * block + second[own] % block, minlength=block * block)
        at = np.flatnonzero(cells)
        codes.append((t // wide * block + at // block) << 32 | (t % wide * block + at % block))
        counts.append(cells[at])
    rest = np.flatnonzero(rest)
    code = np.sort(first[rest].astype(np.int64) << 32 | second[rest])
    edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    codes.append(code[edge])
    counts.append(np.diff(np.r_[edge, len(code)]))
    return np.concatenate(codes), np.concatenate(counts)


@dataclass
class _Known:
    """What tasks know of the frequent words or pairs: names of the head by rank (word and language, or the code of two ranks), counts, and the bit map of the others."""

    names: pa.Array | np.ndarray
    counts: np.ndarray
    bits: np.ndarray
    map_bits: int

    def seen(self, keys: np.ndarray) -> np.ndarray:
        return _set(self.bits, _bit(keys, self.map_bits))


class _Ids:
    """Of each distinct word of some texts: its rank (-1 where it has none), its key, and whether it is frequent or may be."""

    def __init__(self, texts: _Texts, lang: str, words: _Known) -> None:
        named = pc.binary_join_element_wise(texts.words, pa.scalar(lang.encode(), pa.binary()), pa.scalar(b" ", pa.binary()))
        self.rank = pc.fill_null(pc.index_in(named, words.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.key = _word_keys(texts.hashes(), lang)
        self.known = (self.rank >= 0) | words.seen(self.key)


def _emit(lang: str | None, codes: np.ndarray | None, phrases: pa.Array | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(n), OUT_ROWS):
        m = min(OUT_ROWS, len(n) - k)
        yield pa.record_batch(
            [pa.array(codes[k : k + m]) if codes is not None else pa.nulls(m, pa.int64()), pa.array([lang] * m, pa.string()), phrases.slice(k, m) if phrases is not None else pa.nulls(m, pa.binary()), pa.array(n[k : k + m])],
            names=["code", "lang", "phrase", "n"],
        )


def _named(lang: str, texts: _Texts, *at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of phrases of the words at these places, as words joined by a space."""
    if len(at[0]):
        words = [texts.words.take(pa.array(texts.of[x])) for x in at]
        counted = pc.value_counts(pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())))
        yield from _emit(lang, None, counted.field("values"), counted.field("counts").to_numpy())


WORDS, PHRASES = "lang string, word binary, n long", "code long, lang string, phrase binary, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n of each distinct word of a batch; with a null word that of all its words."""
    for lang, group in _by_language(batches):
        t = _Texts(group)
        n = np.bincount(t.of, minlength=len(t.words)).astype(np.int64)
        for k in range(0, len(n), OUT_ROWS):
            part = t.words.slice(k, OUT_ROWS)
            yield pa.record_batch([pa.array([lang] * len(part), pa.string()), part, pa.array(n[k : k + len(part)])], names=["lang", "word", "n"])
        yield pa.record_batch([pa.array([lang], pa.string()), pa.nulls(1, pa.binary()), pa.array([len(t.of)], pa.int64())], names=["lang", "word", "n"])


def _count_pairs(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: _Known = told.value
        for lang, group in _by_language(batches):
            t = _Texts(group)
            ids = _Ids(t, lang, words)
            at = np.flatnonzero(t.joined)
            a, b = t.of[at], t.of[at + 1]
            both = (ids.rank[a] >= 0) & (ids.rank[b] >= 0)
            yield from _emit(None, *_coded(*tiles(ids.rank[a[both]], ids.rank[b[both]])))
            other = at[~both & ids.known[a] & ids.known[b]]
            yield from _named(lang, t, other, other + 1)

    return run


def _coded(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, None, np.ndarray]:
    return codes, None, n.astype(np.int64)


def _pair_ranks(code: np.ndarray, pairs: _Known, order: np.ndarray) -> np.ndarray:
    """The ranks of pairs by their codes, -1 of those that have none; order sorts the names."""
    if not len(pairs.names):
        return np.full(len(code), -1)
    spot = np.minimum(np.searchsorted(pairs.names, code, sorter=order), len(order) - 1)
    return np.where(pairs.names[order[spot]] == code, order[spot], -1)


def _count_triples(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = told.value
        order = np.argsort(pairs.names)
        for lang, group in _by_language(batches):
            t = _Texts(group)
            ids = _Ids(t, lang, words)
            at = np.flatnonzero(t.joined)
            a, b = t.of[at], t.of[at + 1]
            at = at[ids.known[a] & ids.known[b]]
            a, b = t.of[at], t.of[at + 1]
            both = (ids.rank[a] >= 0) & (ids.rank[b] >= 0)
            rank = np.full(len(at), -1)
            rank[both] = _pair_ranks(ids.rank[a[both]] << 32 | ids.rank[b[both]], pairs, order)
            fine = rank >= 0
            open_ = np.flatnonzero(~fine)
            fine[open_] = pairs.seen(_pair_keys(ids.key[a[open_]], ids.key[b[open_]]))
            at, rank = at[fine], rank[fine]
            # a triple is two frequent pairs that begin one after the other
            two = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
            first, p, w = at[two], rank[two], ids.rank[t.of[at[two] + 2]]
            both = (p >= 0) & (w >= 0)
            yield from _emit(None, *_coded(*tiles(p[both], w[both])))
            other = first[~both]
            yield from _named(lang, t, other, other + 1, other + 2)

    return run


def _head(rows: DataFrame, most: int, size: Column, most_bytes: int) -> int:
    """The smallest level of counts such that all rows from it on are `most` rows and `most_bytes` at most; levels grow by some twentieth."""
    levels = rows.groupBy(_level().alias("level")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy(F.desc("level")).collect()
    n = total = 0
    level = 1 << 30
    for r in levels:
        n, total = n + r["n"], total + r["bytes"]
        if n > most or total > most_bytes:
            break
        level = r["level"]
    return level


def _level() -> Column:
    return F.floor(F.log(2.0, F.col("n").cast("double")) * 16).cast("int")


def _bit_map(rows: DataFrame, keys, bits: int) -> np.ndarray:
    """The bits of the keys of all rows; keys: of a batch. What comes to the driver is the map, not the rows."""
    slot = min(SLOT_BITS, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(keys(batch), bits))
            cut = np.flatnonzero(np.diff(at >> slot)) + 1
            for part in np.split(at, cut):
                if len(part):
                    yield pa.record_batch([pa.array([int(part[0] >> slot)], pa.int64()), pa.array([(part & ((1 << slot) - 1)).astype(np.uint16).tobytes()], pa.binary())], names=["slot", "at"])

    def merge(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << slot, bool)
        for x in table["at"].to_pylist():
            flags[np.frombuffer(x, np.uint16)] = True
        return pa.table({"slot": table["slot"].slice(0, 1), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for r in rows.mapInArrow(send, "slot long, at binary").groupBy("slot").applyInArrow(merge, "slot long, flags binary").collect():
        own = np.frombuffer(r["flags"], np.uint8)
        out[r["slot"] * len(own) : (r["slot"] + 1) * len(own)] = own
    return out


def _keys_by_language(langs: pa.Array, hashes: np.ndarray) -> np.ndarray:
    coded, out = langs.dictionary_encode(), np.zeros(len(langs), U64)
    codes = coded.indices.to_numpy()
    for k, name in enumerate(coded.dictionary.to_pylist()):
        out[codes == k] = _word_keys(hashes[codes == k], name)
    return out


def _hashes(words: pa.Array) -> np.ndarray:
    data = words.to_pylist()
    return word_hashes(np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64))


def _row_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Keys of rows (lang, word) or (lang, w1, w2)."""
    langs = batch.column("lang")
    if "word" in batch.schema.names:
        return _keys_by_language(langs, _hashes(batch.column("word")))
    return _pair_keys(*(_keys_by_language(langs, _hashes(batch.column(c))) for c in ("w1", "w2")))


def _spelled(rows: DataFrame, told, parts: int) -> DataFrame:
    """Rows (code, lang, phrase, n) with the words w1 to wN instead, codes by ranks told, phrases by their spaces."""
    ready_workers(rows.sparkSession)
    names = [f"w{k + 1}" for k in range(parts)]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = told.value
        words, pairs = value if isinstance(value, tuple) else (value, None)
        for batch in batches:
            code = batch.column("code").to_numpy()
            ids = [code >> 32, code & 0xFFFFFFFF]
            if pairs is not None:
                pair = pairs.names[ids[0]]
                ids = [pair >> 32, pair & 0xFFFFFFFF, ids[1]]
            cols = [pc.split_pattern(words.names.take(pa.array(i)), b" ", max_splits=1) for i in ids]
            found = [pc.list_element(c, 0) for c in cols]
            yield pa.record_batch([pc.list_element(cols[0], 1).cast(pa.string()), *found, batch.column("n"), batch.column("code")], names=["lang", *names, "n", "code"])

    schema = ", ".join(["lang string", *(f"{x} binary" for x in names), "n long", "code long"])
    by_rank = rows.where("code IS NOT NULL").select("code", "n").mapInArrow(spell, schema)
    split = F.split(F.col("phrase").cast("string"), " ")
    named = rows.where("code IS NULL").select("lang", *(split[k].cast("binary").alias(x) for k, x in enumerate(names)), "n", F.lit(None).cast("long").alias("code"))
    return by_rank.unionAll(named)


def phrases(docs: DataFrame, least: int = LEAST, head: int = HEAD, map_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Totals (lang, total), frequent words (lang, word, n), pairs (lang, w1, w2, n) and triples (lang, w1, w2, w3, n), each with n of `least` or more; all checkpointed."""
    spark = docs.sparkSession
    ready_workers(spark)
    ready_checkpoints(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("octet_length(text) > 0")
    counted = rows.mapInArrow(_count_words, WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least)).checkpoint()
    totals, words = counted.where("word IS NULL").select("lang", F.col("n").alias("total")), counted.where("word IS NOT NULL")

    level = _head(words, head, F.octet_length("word") + F.octet_length("lang") + 1, HEAD_BYTES)
    top = words.where(_level() >= level).select("word", "lang", "n").toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
    named = pc.binary_join_element_wise(_one(top["word"]), _one(top["lang"]).cast(pa.binary()), pa.scalar(b" ", pa.binary()))
    known = _Known(named, top["n"].to_numpy(), _bit_map(words.where(_level() < level).select("lang", "word"), _row_keys, map_bits), map_bits)
    told = spark.sparkContext.broadcast(known)

    def frequent(found: DataFrame, told, parts: int) -> DataFrame:
        # kept before it is read in two parts, else the texts would be read for each
        counted = found.groupBy("code", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).checkpoint()
        return _spelled(counted, told, parts).checkpoint()

    pairs = frequent(rows.mapInArrow(_count_pairs(told), PHRASES), told, 2)
    coded = pairs.where("code IS NOT NULL")
    level = _head(coded, head, F.lit(16), 1 << 40)
    top = coded.where(_level() >= level).select("code", "n").toArrow().sort_by([("n", "descending"), ("code", "ascending")])
    rest = pairs.where(F.col("code").isNull() | (_level() < level)).select("lang", "w1", "w2")
    known_pairs = _Known(top["code"].to_numpy(), top["n"].to_numpy(), _bit_map(rest, _row_keys, map_bits), map_bits)
    both = spark.sparkContext.broadcast((known, known_pairs))
    triples = frequent(rows.mapInArrow(_count_triples(both), PHRASES), both, 3)
    return totals, words, pairs.drop("code"), triples.drop("code")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _scored(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    wide = "decimal(16,0)"
    return F.call_function("div", (a.cast(wide) * a.cast(wide)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), left.cast(wide) * right.cast(wide))


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, share: int = 50, head: int = HEAD, map_bits: int = MAP_BITS) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    docs: lang, text; other columns, whatever their names, are not read. Texts are lower-cased (A-Z) and cut to pieces at
    `.,;:!?` and line breaks (LF, VT, FF, CR), pieces to words at spaces and tabs. n: words of the language; a: how often the
    phrase occurs within pieces, overlaps included, `least` at least; score: floor(1000000 a a / (l r)) of the cut with the
    smallest one, of equal ones the earlier, l and r being how often the two parts occur. A phrase whose words lie within a longer
    one with at least `share` hundredths of its occurrences is left out. Of each language the first `top`, by score, a
    (both falling) and phrase (bytes, rising).

    A null language is `und`, an empty one is a language of its own; null and empty texts and those of separators only have no words. A very long text is cut
    at the ends of pieces, a piece without any is worked on whole. Repeated rows count as often as they stand there. An empty
    table, and a language without a frequent phrase, gives no rows. Whole numbers of up to 38 digits hold the products, for
    up to 10^15 occurrences.
    """
    totals, words, pairs, triples = phrases(docs, least, head, map_bits)

    def of(word: str, name: str) -> DataFrame:
        return words.select("lang", F.col("word").alias(word), F.col("n").alias(name))

    def of_pair(first: str, second: str, name: str) -> DataFrame:
        return pairs.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("n").alias(name))

    two = pairs.join(of("w1", "l"), ["lang", "w1"]).join(of("w2", "r"), ["lang", "w2"])
    two = two.select("lang", "w1", "w2", F.col("n").alias("a"), "l", "r", _scored(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    three = triples.join(of("w1", "f1"), ["lang", "w1"]).join(of("w3", "f3"), ["lang", "w3"])
    three = three.join(of_pair("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(of_pair("w2", "w3", "f23"), ["lang", "w2", "w3"]).checkpoint()

    def within(first: str, second: str, f: str) -> DataFrame:
        return three.where(F.col("n") * 100 >= F.col(f) * share).select("lang", F.col(first).alias("w1"), F.col(second).alias("w2"))

    inside = within("w1", "w2", "f12").unionAll(within("w2", "w3", "f23")).distinct()
    two = two.join(inside, ["lang", "w1", "w2"], "left_anti").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    cuts = [F.struct(_scored(F.col("n"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f1", "f23"), ("f12", "f3")))]
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.least(*cuts).alias("cut"))
    found = two.unionByName(three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, ws, len(ws) AS k FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p)),
one AS (SELECT lang, unnest(ws) AS phrase FROM w WHERE k > 0),
two AS (SELECT lang, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT lang, ws, unnest(range(1, k)) AS i FROM w WHERE k > 1)),
three AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, k - 1)) AS i FROM w WHERE k > 2)),
n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
f AS (SELECT lang, phrase, count(*) AS f FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY lang, phrase HAVING count(*) >= 10),
t AS (SELECT lang, w1, w2, w3, count(*) AS a FROM three GROUP BY ALL HAVING count(*) >= 10),
t2 AS (SELECT t.*, a1.f AS f1, a3.f AS f3, a12.f AS f12, a23.f AS f23 FROM t
  JOIN f a1 ON a1.lang = t.lang AND a1.phrase = w1 JOIN f a3 ON a3.lang = t.lang AND a3.phrase = w3
  JOIN f a12 ON a12.lang = t.lang AND a12.phrase = w1 || ' ' || w2 JOIN f a23 ON a23.lang = t.lang AND a23.phrase = w2 || ' ' || w3),
t3 AS (SELECT *, (1000000::HUGEINT * a * a) // (f1::HUGEINT * f23) AS s1, (1000000::HUGEINT * a * a) // (f12::HUGEINT * f3) AS s2 FROM t2),
gone AS (SELECT lang, w1 || ' ' || w2 AS phrase FROM t2 WHERE 100 * a >= 50 * f12 UNION SELECT lang, w2 || ' ' || w3 FROM t2 WHERE 100 * a >= 50 * f23),
b AS (SELECT f.lang, f.phrase, f.f AS a, x.f AS l, y.f AS r FROM f
  JOIN f x ON x.lang = f.lang AND x.phrase = split_part(f.phrase, ' ', 1) JOIN f y ON y.lang = f.lang AND y.phrase = split_part(f.phrase, ' ', 2)
  WHERE contains(f.phrase, ' ')),
c AS (SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM b ANTI JOIN gone USING (lang, phrase)
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, least(s1, s2) FROM t3),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
