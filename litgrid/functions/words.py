"""Words of texts, counted a piece of the rows at a time in Arrow, so that no row is made of a word's single occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.session import ready_workers

#: Words of a piece, or bytes of text.
PIECE_WORDS, PIECE_BYTES = 1 << 20, 4 << 20


def runs(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """How many words each text has, and the words, text after text: runs of the letters a to z. A null text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    letter = (data >= 97) & (data <= 122)
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    first = at[:-1][np.diff(at) > 0]
    starts[first] = letter[first]  # a word does not go on in the next text
    where = np.flatnonzero(starts)
    letters = data[letter]
    begin = np.cumsum(letter)[where] - 1 if len(where) else np.zeros(0, np.int64)
    offsets = np.append(begin, len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(letters))
    return np.diff(np.searchsorted(where, at)), words


def _cut(batch: pa.RecordBatch, size: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    cut = (np.cumsum(size) - size) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Slices of the batches, how many words each of their rows has, and all of these words. Rows have `terms`, lists of words, or `text` in small letters."""
    for batch in batches:
        lists = "terms" in batch.schema.names
        column = batch.column("terms" if lists else "text")
        size = column.value_lengths() if lists else pc.binary_length(column)
        for piece in _cut(batch, size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), PIECE_WORDS if lists else PIECE_BYTES):
            if not lists:
                yield piece, *runs(piece.column("text"))
                continue
            own = piece.column("terms")
            yield piece, own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own.flatten()


def vocabulary(texts: DataFrame) -> DataFrame:
    """entry, n: how often each word occurs in the small letters of `text`."""
    ready_workers(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words in pieces(batches):
            found = words.value_counts()
            yield pa.record_batch([found.field("values"), found.field("counts")], names=["entry", "n"])

    rows = texts.select(F.lower("text").alias("text")).mapInArrow(run, "entry string, n long")
    return rows.groupBy("entry").agg(F.sum("n").alias("n"))
