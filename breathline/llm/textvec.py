"""Vectorised text scanning over Arrow batches: words, word hashes and shingles with numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass covers; a longer text gets a pass of its own.
PASS_BYTES = 2 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER_BYTES = bytes(LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()  # read in place: a batch may hold many megabytes
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(column: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``most`` bytes."""
    data, offsets = text_buffer(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers


def _give_back() -> None:
    """Return freed memory to the system, and the powers of all but ordinary passes."""
    if len(_powers[0]) > 2 * PASS_BYTES:
        _powers[:] = [p[:1].copy() for p in _powers]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, giving its memory back at the end of a task: a worker stays for the tasks of later steps."""

    @functools.wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return whole


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words end at separators and at the end of a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~is_sep[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    after = before.copy()  # after[i]: whether byte i - 1 is in a word that goes on at i
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    after[inner] = False
    starts = np.flatnonzero(inside & ~after[:-1])
    goes_on = np.zeros(len(data), bool)
    goes_on[:-1] = inside[1:]
    goes_on[inner - 1] = False
    ends = np.flatnonzero(inside & ~goes_on) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (already lower-cased) word, from prefix sums of a polynomial."""
    up, down = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct k-word shingles of each row, sorted by row, then hash.

    A row with fewer than k words but at least one has its whole sequence as its
    single shingle; a row without words has none.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.searchsorted(rows, np.arange(n_rows), "left")
    count = np.searchsorted(rows, np.arange(n_rows), "right") - first
    found, owner = [], []
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled = rolled * _BASE + hashes[j : n - k + 1 + j]
        whole = rows[: n - k + 1] == rows[k - 1 :]
        found.append(mix(rolled[whole]))
        owner.append(rows[: n - k + 1][whole])
    for r in np.flatnonzero((count > 0) & (count < k)):
        x = _U(int(count[r]))
        for h in hashes[first[r] : first[r] + count[r]]:
            x = mix(np.array([x * _BASE + h]))[0]
        found.append(np.array([x], np.uint64))
        owner.append(np.array([r], np.int64))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[fresh], owner[fresh]
