"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is over words and built by the workers that use it; what goes to the executors as a broadcast is the text of the
items, whose bytes are summed first. Beyond BLOCK_WORDS words the items are dealt to parts, and each part has a pass over the
texts with its own broadcast, so what the driver and a worker hold is bounded however many items there are. A text's words stream through the automaton, which tracks the longest match that ends at each word;
stretches in which no two adjacent words are adjacent in an item are skipped, as no match there is longer than a word.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litgrid.llm import exchange as X
from litgrid.llm.batches import map_texts
from litgrid.llm.bytesops import ODD, Words, as_bytes, is_alnum_byte, mix

WINDOW = 10
#: Words of items in one automaton, about; a few hundred MB of Python objects at most.
BLOCK_WORDS = 1_000_000
HITS = "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>, clean_text string"
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("clean_text", pa.string())])


def item_words(texts: list[bytes]) -> Words:
    return Words(texts, is_alnum_byte(), lower=True)


class Automaton:
    """Generalised suffix automaton of sequences of word numbers; windows and short whole items are its accepting places."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int) -> None:
        items = list(items)
        w = item_words([t for _, t in items])
        self.window = window
        self.vocab = np.unique(w.hash)
        ids = np.searchsorted(self.vocab, w.hash)
        seqs = [ids[a:b].tolist() for a, b in zip(w.first, w.first[1:], strict=False)]
        same = w.doc[1:] == w.doc[:-1] if len(ids) else np.zeros(0, bool)
        self.pairs = np.unique(pair_keys(ids[:-1], ids[1:])[same]) if len(ids) > 1 else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in seqs:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.least = min([min(len(s), window) for s in seqs if s], default=0)
        self._label([x for x, _ in items], seqs)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, moves: dict[int, int], length: int, link: int = 0) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _label(self, names: list[str], seqs: list[list[int]]) -> None:
        """owners: of each state as long as a window, the items with its strings. whole: of each state, lengths and names of short items that are its strings or suffixes of them."""
        self.names = names
        self.owners: dict[int, set[int]] = {}
        own: dict[int, dict[int, list[int]]] = {}
        for k, s in enumerate(seqs):
            state = 0
            for c in s:
                state = self.next[state][c]
                q = state
                while q > 0 and self.length[q] >= self.window and k not in self.owners.setdefault(q, set()):
                    self.owners[q].add(k)
                    q = self.link[q]
            if 0 < len(s) < self.window:
                while self.length[self.link[state]] >= len(s):
                    state = self.link[state]
                own.setdefault(state, {}).setdefault(len(s), []).append(k)
        self.whole: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        if own:
            for q in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                found = self.whole.get(self.link[q], []) + [(n, tuple(ks)) for n, ks in own.get(q, {}).items()]
                if found:
                    self.whole[q] = found

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Matched intervals of this stretch of word numbers, and the items with a window in it."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = match = 0
        found: list[tuple[int, int]] = []
        at: set[int] = set()
        items: set[int] = set()
        for j, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                match = length[state]
            if c not in nxt[state]:
                match = 0
                continue
            state = nxt[state][c]
            match += 1
            if match >= window:
                found.append((j - match + 1, j + 1))
                q = state
                while length[link[q]] >= window:
                    q = link[q]
                at.add(q)
            for n, ks in self.whole.get(state, ()):
                if n <= match:
                    found.append((j - n + 1, j + 1))
                    items.update(ks)
        for q in at:
            items |= self.owners[q]
        return found, items


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * ODD + b.astype(np.uint64))


def hits(texts: list[bytes], automata: list[Automaton]) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of these texts, flags of those inside an occurrence, and each text's items."""
    w = item_words(texts)
    step, items = np.zeros(len(w.starts) + 1, np.int64), [set() for _ in texts]
    for m in automata:
        if not len(m.vocab) or not len(w.starts):
            continue
        ids = np.minimum(np.searchsorted(m.vocab, w.hash), len(m.vocab) - 1)
        known = m.vocab[ids] == w.hash
        joined = known[:-1] & known[1:] & (w.doc[:-1] == w.doc[1:])
        if len(m.pairs):
            p = np.flatnonzero(joined)
            key = pair_keys(ids[p], ids[p + 1])
            joined[p] = m.pairs[np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)] == key
        else:
            joined[:] = False
        # stretches: words chained by known pairs, or known words alone
        chain = np.flatnonzero(known & ~np.r_[False, joined])
        ends = np.flatnonzero(known & ~np.r_[joined, False]) + 1
        long = ends - chain >= m.least
        for a, b in zip(chain[long].tolist(), ends[long].tolist(), strict=True):
            found, own = m.stream(ids[a:b].tolist())
            for s, e in found:
                step[a + s] += 1
                step[a + e] -= 1
            if own:
                items[w.doc[a]].update(m.names[k] for k in own)
    return w, np.cumsum(step[:-1]) > 0, items


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Occurrences of benchmark items in texts.

    docs: doc_id, text; items: item_id, text; other columns, whatever their names, are not read. Texts and items are
    lower-cased (A-Z) and split into runs of ASCII letters, digits and characters beyond ASCII. A window is `window`
    consecutive words of an item, or the whole of an item that is shorter. Returns for each document n_words, n_hit (words
    inside any occurrence of a window), spans (maximal runs of those words), items (ids, as sorted distinct strings, of items
    with an occurring window) and clean_text (the text without the bytes of the spans).

    Null and empty texts have no words and give a row without hits; a very long text streams through whole in one task, with
    some 60 bytes of memory for each of its bytes. Items without words match nothing; an empty items table gives rows without
    hits, an empty table of documents gives none. Repeated documents each give a row. An item with a null id is matched as
    'null'.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _applied(docs, items, window, block_words, _row, HITS)


def _applied(docs: DataFrame, items: DataFrame, window: int, block_words: int, f: Callable[..., pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """f of pieces of docs, their words, flags of the words hit and each row's items. docs: doc_id, text and more."""
    spark = docs.sparkSession
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a word has two bytes at least with its separator
    parts = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / (2 * block_words)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("k", "text"), F.lit(parts)))

    def shared(part: int):
        """One part's items, of about 2 * block_words bytes or a single longer item."""
        return spark.sparkContext.broadcast([(r["k"], r["text"].encode()) for r in rows.where(F.col("part") == part).orderBy("k", "text").collect()])

    if parts == 1:
        own = shared(0)
        return map_texts(docs, lambda batch, m: f(batch, *hits(as_bytes(batch.column("text")), [m])), schema, lambda: _worker_automaton(own, window))
    names_of = docs.columns
    rest = [c for c in names_of if c not in ("doc_id", "text")]
    texts = X.in_batches(docs, X.text_bytes(docs), X.BATCH_BYTES, *rest)
    found = None
    for part in range(parts):
        own = shared(part)

        def ask(name: int, payload: bytes, own=own, part=part) -> pa.Table:
            _, hit, names = hits(as_bytes(X.texts_of(payload)["text"]), [_worker_automaton(own, window)])
            listed = json.dumps([[i, sorted(x)] for i, x in enumerate(names) if x]).encode()
            return X.messages([(name, part, 0, 0, X.pack(np.packbits(hit), np.frombuffer(listed, np.uint8)))])

        said = X.mapped(texts, ask, X.MESSAGE).checkpoint()
        found = said if found is None else found.unionAll(said)
        own.destroy()

    def last(_: int, payload: bytes, replies: dict) -> pa.Table:
        table = X.texts_of(payload)
        w = item_words(as_bytes(table["text"]))
        hit, names = np.zeros(len(w.starts), bool), [set() for _ in range(table.num_rows)]
        for said in replies[0].values():
            bits, listed = X.unpack(said)
            hit |= np.unpackbits(bits, count=len(hit)).astype(bool)
            for i, x in json.loads(listed.tobytes()):
                names[i].update(x)
        order = table["order"].to_numpy()
        columns = {"doc_id": pa.array(order, pa.int64(), mask=order == X.LAST), "text": table["text"].combine_chunks()} | {c: table[f"keep{i}"].combine_chunks() for i, c in enumerate(rest)}
        batch = pa.RecordBatch.from_arrays([columns[c] for c in names_of], names=names_of)
        return pa.Table.from_batches([f(batch, w, hit, names)])

    text = schema if isinstance(schema, str) else ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
    return X.paired(texts, found, last, text)


_BUILT: dict[int, tuple[object, Automaton]] = {}


def _worker_automaton(shared, window: int) -> Automaton:
    """The automaton of these items in this Python worker, built when a task first needs it."""
    if 0 not in _BUILT or _BUILT[0][0] is not shared.value or _BUILT[0][1].window != window:
        _BUILT[0] = (shared.value, Automaton(shared.value, window))
    return _BUILT[0][1]


def _row(batch: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    n = batch.num_rows
    total = np.r_[0, np.cumsum(hit)]
    n_hit = np.diff(total[w.first])
    same = np.r_[False, w.doc[1:] == w.doc[:-1]] if len(hit) else hit
    s = np.flatnonzero(hit & ~(np.r_[False, hit[:-1]] & same)) if len(hit) else np.zeros(0, np.int64)
    e = np.flatnonzero(hit & ~(np.r_[hit[1:], False] & np.r_[same[1:], False])) + 1 if len(hit) else np.zeros(0, np.int64)
    own = w.doc[s]
    spans = pa.StructArray.from_arrays([pa.array((s - w.first[own]).astype(np.int32)), pa.array((e - w.first[own]).astype(np.int32))], ["start", "end"])
    offsets = np.r_[0, np.cumsum(np.bincount(own, minlength=n))].astype(np.int32)
    text = batch.column("text")
    clean = text.to_pylist() if n_hit.any() else None
    if clean is not None:
        for d in np.flatnonzero(n_hit):
            raw, base, out, last = clean[d].encode(), w.bounds[d], [], 0
            for k in range(offsets[d], offsets[d + 1]):
                out.append(raw[last : w.starts[s[k]] - base])
                last = w.ends[e[k] - 1] - base
            clean[d] = b"".join([*out, raw[last:]]).decode()
    return pa.record_batch(
        [batch.column("doc_id").cast(pa.int64()), pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array([sorted(x) for x in items], pa.list_(pa.string())), text.cast(pa.string()) if clean is None else pa.array(clean, pa.string())],
        schema=_HITS,
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, without the spans found in their texts; rows of which the spans are more than max_coverage of the words are left out. Other texts stay as they are."""

    def run(batch: pa.RecordBatch, w: Words, hit: np.ndarray, own: list[set[str]]) -> pa.RecordBatch:
        if not hit.any():
            return batch
        found = _row(pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"]), w, hit, own)
        n, n_hit = (found.column(x).to_numpy() for x in ("n_words", "n_hit"))
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), found.column("clean_text").cast(batch.schema.field(at).type)).filter(pa.array(n_hit <= n * max_coverage))

    return _applied(docs, items, window, block_words, run, docs.schema)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
p AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n)),
m AS (SELECT doc_id, p.n, i, item_id FROM p JOIN bg ON p.n = bg.n AND p.g = bg.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
