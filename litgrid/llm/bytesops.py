"""Vectorised work on whole texts as bytes: words, hashes, rolling windows.

A batch of texts is one buffer in which every text is followed by a single separator byte (a space),
so words and windows found in the buffer never cross texts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEED = 20240611
ODD = U64(0x9E3779B97F4A7C15)
ODD2 = U64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@cache
def byte_table(places: int = 64) -> np.ndarray:
    """A random 64-bit value for each place in a word and byte."""
    return np.random.default_rng(SEED).integers(0, 2**64, places * 256, dtype=np.uint64)


@cache
def is_word_byte() -> np.ndarray:
    """Bytes of words that are runs of anything but the six ASCII white-space bytes."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


@cache
def is_alnum_byte() -> np.ndarray:
    """Bytes of words made of ASCII digits, ASCII lower-case letters and everything beyond ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


@cache
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer, and where each text starts in it; the last entry of the starts is the buffer's length."""
    buf = np.frombuffer(b" ".join(texts) + b" " if texts else b"", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return buf, starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    edge = np.concatenate(([0] if flags[0] else [], edge, [len(flags)] if flags[-1] else [])).astype(np.int64)
    return edge[0::2], edge[1::2]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative starts of groups with these counts, and the total as a further entry; the place of each member in its group."""
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return starts, np.arange(starts[-1], dtype=np.int64) - np.repeat(starts[:-1], counts)


class Words:
    """The words of a batch of texts: where they are, whose they are and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes], table: np.ndarray | None = None, lower: bool = False, hashes: bool = True) -> None:
        self.buf, self.bounds = joined(texts)
        if lower:
            self.buf = lower_table()[self.buf]
        inside = (is_word_byte() if table is None else table)[self.buf]
        self.starts, self.ends = runs(inside)
        self.lens = self.ends - self.starts
        self.first = np.searchsorted(self.starts, self.bounds)  # the first word of each text, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = word_hashes(self.buf[inside], self.lens) if hashes else None


def word_hashes(packed: np.ndarray, lens: np.ndarray, second: bool = False) -> np.ndarray:
    """A hash of each word; packed: the words' bytes without anything between. second: another one, of other random values."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    starts, place = spread(lens)
    value = (byte_table(128)[64 * 256 :] if second else byte_table())[((place & 63) << 8) | packed]
    if lens.max() > 64:
        far = np.flatnonzero(place > 63)
        powers = np.cumprod(np.full(int(lens.max() >> 6) + 1, ODD2))
        value[far] *= powers[place[far] >> 6]
    return mix(np.add.reduceat(value, starts[:-1]) + lens.astype(np.uint64) * ODD)


def windows(values: np.ndarray, size: int, base: np.uint64 = ODD) -> np.ndarray:
    """Rabin-Karp hashes of every window of `size` values: the polynomial with the values as coefficients, in arithmetic modulo 2**64.

    Equal windows differ in no hash; the values must be random enough to tell different ones apart.
    The polynomial of a long window is put together from those of windows of half its length.
    """
    if len(values) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, length, half = None, 0, U64(base), 1, values
        while True:
            if size & length:
                if out is None:
                    out = half
                else:
                    n = min(len(out), len(half) - done)
                    out = out[:n] * power + half[done : done + n]
                done += length
            if done == size:
                return mix(out[: len(values) - size + 1])
            half = half[:-length] * power + half[length:]
            power, length = power * power, length * 2


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of every window of `size` values."""
    n, length = len(values) - size + 1, 1
    if n <= 0:
        return values[:0]
    while length * 2 <= size:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[:n], values[size - length : size - length + n])


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Flags of the places that a window of `size` from one of these starts covers."""
    step = np.zeros(total + 1, np.int32)
    step += np.bincount(starts, minlength=total + 1).astype(np.int32)
    ends = np.minimum(starts + size, total)
    step -= np.bincount(ends, minlength=total + 1).astype(np.int32)
    return np.cumsum(step[:-1]) > 0
