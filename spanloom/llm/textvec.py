"""Words, word hashes and k-gram hashes of many texts at once, on arrays instead of Python strings."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
#: Bytes whose hashes are summed at once.
PIECE = 1 << 18

_libc = None


def trim() -> None:
    """Gives memory that this process no longer uses back to the system; an idle worker keeps its process."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        _libc = ctypes.CDLL(None)
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: What a worker keeps from one task to the next, by operator.
kept: dict[str, object] = {}


def forget(but: str = "") -> None:
    """Drops what other operators have kept in this worker."""
    if others := [k for k in kept if k != but]:
        for k in others:
            del kept[k]
        gc.collect()
        trim()


def trimmed(run: Callable[[Iterator], Iterator], own: str = "") -> Callable[[Iterator], Iterator]:
    """run over batches, without what other operators than own have kept, and with a trim() at the end of the task."""

    def whole(batches: Iterator) -> Iterator:
        forget(own)
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trimmed_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """work on two tables, then a trim()."""

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        forget()
        try:
            return work(a, b)
        finally:
            trim()

    return one


def trimmed_one(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """work on a table, then a trim()."""

    def one(a: pa.Table) -> pa.Table:
        forget()
        try:
            return work(a)
        finally:
            trim()

    return one


GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_KBASE = np.uint64(0xA0761D6478BD642F)
_KBASE_INV = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))

#: Bytes that separate words: space and the controls from tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def gold(n: int) -> np.uint64:
    """n times an odd constant, modulo 2 ** 64."""
    return np.uint64(n * int(GOLD) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept, as long as the longest asked for."""
    had = _powers.get(int(base))
    if had is None or len(had) < n:
        had = np.full(max(n, 1 << 16), base, np.uint64)
        had[0] = 1
        _powers[int(base)] = had = np.multiply.accumulate(had)
    return had[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), texts.offset
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """starts, ends: byte places of all words, text by text. first: where each text's words begin, and their number at last.
    hash: a hash of each word's bytes."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> Words:
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = np.empty(n + 1, bool)
    np.logical_not(white[raw], out=inside[:n])
    inside[n] = False
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    closes = inside[:n] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    ends = np.flatnonzero(closes) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, offsets), _word_hashes(raw, starts, ends))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of raw[starts:ends], piece by piece, so that the sums take little memory whatever the texts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + PIECE)))
        s, e = starts[i:j] - a, ends[i:j] - a
        size = int(e[-1])
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((raw[a : a + size].astype(np.uint64) + np.uint64(1)) * powers(_BASE, size), out=total[1:])
        out[i:j] = (total[e] - total[s]) * powers(_BASE_INV, size + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * GOLD)


def grams_of(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values; also across texts' ends, which the caller leaves out."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + gold(seed)) * powers(_KBASE, len(values)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_KBASE_INV, n) + np.uint64(k))


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """For each of the grams of grams_of, whether it lies in one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:n] == doc[k - 1 :]


def text_hash(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of a digest of each whole text, as two numbers a row."""
    found = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of lengths[0] in number, then those of the next."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
