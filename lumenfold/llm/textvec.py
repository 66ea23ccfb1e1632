"""Whole-batch text kernels over Arrow string buffers.

Texts stay UTF-8 bytes in one buffer; words, hashes and shingles come from numpy passes
over slices of that buffer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Any odd multiplier works; this is the golden-ratio constant of Fibonacci hashing.
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, a bijection on 64 bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _SLICE + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", inverse)):
                    p = np.full(size, base, dtype=U64)
                    p[0] = 1
                    setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


@dataclass
class Slice:
    """Some consecutive rows of a batch: their bytes and row offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = _SLICE) -> Iterator[Slice]:
    """Runs of rows of at most ``limit`` bytes each; one row alone may be longer."""
    if len(column) == 0:
        return
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """Word bounds in a slice, in order, and how many words each row has."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes b with ``inside[b]``, never across rows."""
    if len(data) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, np.zeros(len(offsets) - 1, dtype=np.int64))
    here = inside[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(here[1:], here[:-1], out=edge[1:])
    at = offsets[:-1]
    edge[at[at < len(data)]] = True
    changes = np.flatnonzero(edge)
    stops = np.append(changes[1:], len(data))
    word = here[changes]
    starts, ends = changes[word], stops[word]
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(starts, ends, counts)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: polynomial prefix sums, then a bijective finalizer."""
    up, down = _Powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def ngram_hashes(words: np.ndarray, counts: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of every run of n words within a row. With ``short``, a row of fewer
    words, but not none, gives its whole sequence as one."""
    total = len(words)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    with np.errstate(over="ignore"):
        if total >= n:
            h = np.full(total - n + 1, n, dtype=U64)
            for j in range(n):
                h *= U64(0xD6E8FEB86659FD93)
                h += words[j : total - n + 1 + j]
            keep = row[: total - n + 1] == row[n - 1 :]
            h, of = mix(h[keep]), row[: total - n + 1][keep]
        else:
            h, of = np.zeros(0, U64), np.zeros(0, np.int32)
        if short:
            few = np.flatnonzero((counts > 0) & (counts < n))
            if len(few):
                start = np.concatenate([[0], np.cumsum(counts)])[few]
                own = counts[few].astype(U64)
                for j in range(n - 1):
                    there = counts[few] > j
                    own[there] = own[there] * U64(0xD6E8FEB86659FD93) + words[start[there] + j]
                h, of = np.concatenate([h, mix(own)]), np.concatenate([of, few.astype(np.int32)])
    return h, of


def order_by_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Permutation that sorts by row, then value; rows are small integers."""
    first = np.argsort(values)
    r = row[first]
    if len(r) and r.max() < 1 << 16:
        r = r.astype(np.uint16)
    return first[np.argsort(r, kind="stable")]


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and offsets of the rows into them."""
    o = order_by_row(values, row)
    v, r = values[o], row[o]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new) > 1:
        np.logical_or.reduce([c[1:] != c[:-1] for c in columns], out=new[1:])
    return new


def blocks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal rows of sorted columns."""
    begin = np.flatnonzero(firsts(*columns))
    return begin, np.append(begin[1:], len(columns[0])) if len(begin) else begin
