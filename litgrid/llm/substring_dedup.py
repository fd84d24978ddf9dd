"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window.

Every window of `size` words of every text is hashed and counted in Spark by hash bucket; a window whose word sequence
also starts in a document with a smaller id is repeated. Repeated windows merge into maximal removal intervals. Windows are
named by two independent hashes (see exchange.py for the odds).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.llm import exchange as X
from litgrid.llm.bytesops import ODD2, Words, as_bytes, covered, is_word_byte, windows, word_hashes

SIZE = 13
#: Mean bytes a word takes with its white space, at least; only bucket numbers follow from it.
WORD_BYTES = 4
OUT = {"doc_id": "long", "n_words": "long", "n_removed": "long", "spans": "array<struct<start:int,end:int>>", "kept_text": "string", "clean_text": "string", "kept_sha256": "string"}


def _windows(table: pa.Table, size: int, buckets: X.Buckets) -> tuple[Words, np.ndarray, X.Distinct]:
    w = Words(as_bytes(table["text"]))
    h = windows(w.hash, size)
    starts = np.flatnonzero(w.doc[: len(h)] == w.doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    order, more = table["order"].to_numpy(), None
    if buckets.second:
        more = windows(word_hashes(w.buf[is_word_byte()[w.buf]], w.lens, second=True), size, ODD2)[starts] if len(h) else h
    return w, starts, X.Distinct(h[starts], order[w.doc[starts]], buckets, more)


def remove_repeats(docs: DataFrame, size: int = SIZE, batch_bytes: int = X.BATCH_BYTES, keep: tuple[str, ...] = (), columns: tuple[str, ...] = tuple(OUT), bucket_bytes: int = X.BUCKET_BYTES, hop_bits: int = X.HOP_BITS) -> DataFrame:
    """Texts without the words that repeat an earlier document.

    docs: doc_id, text; other columns, whatever their names, are not read. Words are maximal runs without ASCII white space,
    unchanged. A word is removed if a window of `size` words of its document covers it whose words also follow each other in
    a document with a smaller doc_id; windows are judged on the input. Returns for each row doc_id, n_words, n_removed,
    spans (maximal removed runs of words, end exclusive), kept_text (kept words joined by one space), clean_text (the text
    as it is but for the removed words and the white space after them), the sha256 of kept_text, and the columns named in
    `keep`; `columns`: which of those are wanted.

    Null and empty texts have no words and come back empty. Texts shorter than a window stay whole. A very long text is a
    batch of its own, worked on whole in one task with some 50 bytes of memory for each of its bytes. A null doc_id counts
    as later than every id; rows that share an id never remove from each other. Repeated rows each give a row; an empty
    table gives none.
    """
    total = X.text_bytes(docs)
    buckets = X.Buckets(total // WORD_BYTES, X.hashed_bits(total), hop_bits, bucket_bytes)
    carried = [k for k in keep if k != "text"]
    texts = X.in_batches(docs, total, batch_bytes, *carried)
    extra = {f"keep{i}": dict(docs.dtypes)[k] for i, k in enumerate(carried)} | ({"text": "string"} if "text" in keep else {})
    schema = ", ".join(f"{n} {t}" for n, t in ({k: v for k, v in OUT.items() if k in columns} | extra).items())

    def send(name: int, payload: bytes) -> pa.Table:
        return X.messages(_windows(X.texts_of(payload), size, buckets)[2].ask(name, 0))

    def last(_: int, payload: bytes, replies: dict) -> pa.Table:
        table = X.texts_of(payload)
        w, starts, distinct = _windows(table, size, buckets)
        hit = starts[distinct.read(replies.get(0, {}), X.EARLIER)[0]]
        out = _kept(table, w, covered(hit, size, len(w.starts)), columns)
        for n in extra:
            out = out.append_column(n, table[n])
        return out

    replies = X.answered(X.mapped(texts, send, X.MESSAGE), buckets, X.EARLIER, total // WORD_BYTES)
    return X.paired(texts, replies, last, schema).withColumnsRenamed({f"keep{i}": k for i, k in enumerate(carried)})


def _cut(buf: np.ndarray, keep: np.ndarray, bounds: np.ndarray, drop_last: int) -> list[bytes]:
    """Each text's kept bytes, without drop_last of them at its end."""
    sizes = np.add.reduceat(keep, bounds[:-1], dtype=np.int64)
    packed = buf[keep].tobytes()
    return [packed[e - n : max(e - n, e - drop_last)] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]


def _kept(table: pa.Table, w: Words, gone: np.ndarray, columns: tuple[str, ...]) -> pa.Table:
    """Rows of the result; gone: flags of the words that go. Words keep their bytes and one byte of what follows, as a space."""
    stays = np.flatnonzero(~gone)
    mask = np.zeros(len(w.buf) + 1, np.int8)
    mask[w.starts[stays]] += 1
    mask[np.minimum(w.ends[stays] + 1, len(w.buf))] -= 1
    spaced = w.buf.copy()
    spaced[w.ends] = 0x20
    texts = _cut(spaced, np.cumsum(mask[:-1]) > 0, w.bounds, 1)
    total = np.r_[0, np.cumsum(gone)]
    # runs of removed words within one document
    cut = np.zeros(len(gone) + 1, bool)
    cut[w.first] = True
    on = gone & ~np.r_[False, gone[:-1] & ~cut[1:-1]] if len(gone) else gone
    s = np.flatnonzero(on)
    off = gone & ~np.r_[gone[1:] & ~cut[1:-1], False] if len(gone) else gone
    e = np.flatnonzero(off) + 1
    own = w.doc[s]
    order = table["order"].to_numpy()
    out = {"doc_id": pa.array(order, pa.int64(), mask=order == X.LAST), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(np.diff(total[w.first]), pa.int64())}
    spans = pa.StructArray.from_arrays([pa.array((s - w.first[own]).astype(np.int32)), pa.array((e - w.first[own]).astype(np.int32))], ["start", "end"])
    out["spans"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(own, minlength=table.num_rows))].astype(np.int32)), spans)
    out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
    if "clean_text" in columns:
        # a removed run ends where the next word of the text begins, the last one of a text with its last word
        until = np.where(cut[e], w.ends[e - 1], np.append(w.starts, 0)[e]) if len(e) else e
        step = np.zeros(len(w.buf) + 1, np.int32)
        np.add.at(step, w.starts[s], 1)
        np.add.at(step, until, -1)
        out["clean_text"] = pa.array(_cut(w.buf, np.cumsum(step[:-1]) == 0, w.bounds, 1), pa.binary()).cast(pa.string())
    out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
    return pa.table({k: out[k] for k in OUT if k in columns})


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, columns=("doc_id", "n_words", "n_removed", "spans", "kept_sha256"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM t),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT g.doc_id, g.i + o AS i FROM g JOIN m USING (h), range(13) r(o) WHERE g.doc_id > m.first),
bad AS (SELECT doc_id, list(i ORDER BY i) AS gone, count(*) AS n,
               count(*) FILTER (WHERE brk) AS n_spans
        FROM (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM 1 AS brk FROM hit) GROUP BY doc_id),
p AS (SELECT w.doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN hit USING (doc_id, i) WHERE hit.doc_id IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM w LEFT JOIN bad USING (doc_id) LEFT JOIN k USING (doc_id)
"""
