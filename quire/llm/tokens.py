"""Hashes of words and word shingles, computed for whole Arrow batches at once, without a Python object per word.

Words are runs of bytes other than the six ASCII white space bytes, with A-Z lower-cased. A word's hash is a polynomial
over random 64-bit values of its bytes, modulo 2**64, mixed with its length; prefix sums give all words of a block.
Equal words have equal hashes everywhere; different ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=_U, endpoint=False)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES), base, dtype=_U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _block(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts that lie one after another in data, hashes of the words' last two bytes, and how many
    words come before each bound."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True  # a text begins: no word runs on from the one before
    starts = word & (first[:-1] | ~np.r_[False, word[:-1]])
    ends = word & (first[1:] | ~np.r_[word[1:], False])
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUE[data] * _power(_INVERSE, len(data))[: len(data)], out=sums[1:])
    hashes = (sums[e] - sums[s]) * _power(_BASE, len(data))[s]
    ending = mix(_VALUE[data[e - 1]] * _U(3) + np.where(e - s > 1, _VALUE[data[e - 2]], _U(1)))
    return mix(hashes + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)), ending, np.searchsorted(s, bounds)


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows of a string column without nulls: first row, word hashes, hashes of the words' endings, and
    the rows' bounds among them."""
    large = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        yield row, *_block(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes (int64) of its `size`-word shingles: its whole word sequence, if that is
    shorter; none without words."""
    factor = [_U(pow(_BASE, 2 * k + 1, 1 << 64)) for k in range(size)]
    for _, h, _, bounds in words(column):
        run = np.zeros(max(0, len(h) - size + 1), _U)
        for k in range(size):
            run += mix(h[k : len(h) - size + 1 + k] * factor[k])
        run = mix(run)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(run[a : b - size + 1].view(np.int64))
            elif b > a:
                yield mix(np.array([sum(int(x) * int(f) for x, f in zip(h[a:b], factor, strict=False)) + int(b - a) & (1 << 64) - 1], _U)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
