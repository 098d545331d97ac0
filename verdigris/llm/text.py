"""Vectorised scanning of Arrow string columns: word boundaries and 64-bit word hashes without Python strings.

A column's UTF-8 buffer is scanned in slices of about a megabyte that end between words, so memory doesn't follow the
length of a text. Hashes are polynomial prefix sums over a table of random byte values, mixed at the end; equal words
have equal hashes in every task, and different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 19
#: Rows of a batch are handed on in runs of about this many bytes of text.
RUN = 2 << 20


def _class(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: `[^\x20\x09-\x0D]+` on UTF-8 bytes.
SPACED = _class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = _class(b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_FOLDED = _VALUES[LOWER]
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    size = SLICE + 1
    while size < n:
        size *= 2
    if size not in _powers:
        with np.errstate(over="ignore"):
            one = [np.concatenate([[U(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (U(_BASE), U(_INVERSE))]
        _powers.clear()
        _powers[size] = (one[0], one[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a run of documents: those of document i are ``at[i]:at[i + 1]`` of ``hash``, ``start``, ``end``."""

    __slots__ = ("at", "end", "hash", "start")

    def __init__(self, at: np.ndarray, start: np.ndarray, end: np.ndarray, hash: np.ndarray):
        self.at, self.start, self.end, self.hash = at, start, end, hash

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> Words:
    """Words (longest runs of bytes in ``table``) of each document; with ``fold`` A-Z hash as a-z."""
    values = _FOLDED if fold else _VALUES
    starts, ends, hashes = [], [], []
    inner = np.unique(offsets)
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + SLICE)
        if stop < n:
            # back to a byte between words or a document's start; on, where one word fills the slice
            gap = np.flatnonzero(~table[data[at:stop]])
            edge = inner[np.searchsorted(inner, stop, "right") - 1]
            last = max(at + int(gap[-1]) + 1 if len(gap) else at, int(edge))
            while last <= at:
                more = np.flatnonzero(~table[data[stop : stop + SLICE]])
                after = inner[min(np.searchsorted(inner, stop, "left"), len(inner) - 1)]
                last = min(stop + int(more[0]) if len(more) else stop + SLICE if stop + SLICE < n else n, int(after) if after > at else n)
                if not len(more) and last == stop + SLICE:
                    stop, last = last, at
            stop = last
        s, e, h = _slice(data[at:stop], inner[(inner > at) & (inner < stop)] - at if len(inner) < 64 else inner[np.searchsorted(inner, at, "right") : np.searchsorted(inner, stop, "left")] - at, table, values)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(np.searchsorted(start, offsets, "left"), start, end, hash)


def _slice(data: np.ndarray, inner: np.ndarray, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[inner] = inside[inner]
    final = inside.copy()
    final[:-1] &= ~inside[1:]
    final[inner - 1] = inside[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(final) + 1
    power, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data] * power[: len(data)], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        return s, e, mix(h + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hash(word: str) -> int:
    """The hash that :func:`words` gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_slice(raw, np.zeros(0, np.int64), np.ones(256, bool), _FOLDED)[2][0]) if len(raw) else 0


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = RUN) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def scan(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", size: int = RUN) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``work`` to runs of rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, column, size):
            if (out := work(run)) is not None:
                yield out

    return each


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return h.view(np.int64)
