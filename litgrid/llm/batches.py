"""Whole texts in pieces of bounded size, for work that needs no exchange between documents."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from litgrid.session import ready_workers

PIECE_BYTES = 2 << 20


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Return freed memory to the machine, which executors share with idle Python workers."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about `limit` bytes of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    cut = (np.cumsum(size) - size) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(docs: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, prepare: Callable[[], object] | None = None) -> DataFrame:
    """f over pieces of the rows. With `prepare`, its result, made once a task, is the second argument of f."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = (prepare(),) if prepare else ()
        for batch in batches:
            for piece in pieces(batch):
                yield f(piece, *extra)

    return docs.mapInArrow(run, schema)
