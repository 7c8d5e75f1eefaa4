"""Vectorised text primitives shared by the operators.

A batch of texts is one byte buffer plus offsets, so that tokenising, hashing and
window minima are a few numpy passes over the buffer and not Python per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: A fixed random code per byte value, so that small bytes are not small numbers.
BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (at least); the longest so far is kept, up to 2 million."""
    if n <= len(_POWERS[0]):
        return _POWERS[0], _POWERS[1]
    size = 1 << max(16, int(n).bit_length())
    up, down = np.ones(size, U64), np.ones(size, U64)
    with np.errstate(over="ignore"):
        up[1:], down[1:] = U64(BASE), U64(INVERSE)
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 1 << 21:
        _POWERS[:] = [up, down]
    return up, down


def give_back() -> None:
    """Returns memory that is free to the system; a worker that waits for its next task else keeps its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives memory back when it ends."""

    @wraps(run)
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


class Poly:
    """Polynomial prefix sums over codes; ``span`` hashes any [start, end) in O(1)."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + U64(BASE))


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about ``max_bytes`` of text, or one longer row.

    Null texts are empty.
    """
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    if column.offset:
        column = pa.concat_arrays([column])
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: The white space that ends a word: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each text plus the total); words never cross texts."""
    space = IS_SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = False
    n = len(data)
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    before |= starts_text[:n]
    start = np.flatnonzero(~space & before)
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after |= starts_text[1:]
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(start, offsets)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` neighbours (len(x) - width + 1 of them)."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if rest := width - have:
        out = np.minimum(out[:-rest], out[rest:])
    return out


def minimizer_runs(hashes: np.ndarray, width: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their minimum: (position of the minimum, first window, last window).

    ``ok`` marks the windows to use (those inside one text). The least hash wins, of
    equal ones the leftmost, so equal windows pick the same place.
    """
    if not len(ok) or not ok.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    keys = (hashes >> U64(32) << U64(32)) | np.arange(len(hashes), dtype=U64)
    at = (window_min(keys, width)[: len(ok)] & U64(0xFFFFFFFF)).astype(np.int64)
    use = np.flatnonzero(ok)
    place = at[use]
    new = np.ones(len(use), bool)
    new[1:] = (place[1:] != place[:-1]) | (use[1:] != use[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(use)) - 1
    return place[first], use[first], use[last]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index within owner) for ``counts[i]`` items of each owner i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - start[owner]
