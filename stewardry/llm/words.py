"""Words, lines and 64-bit hashes of whole Arrow text batches, in numpy.

A batch is taken as one byte buffer with document bounds, so that the work per byte is done by
a few array operations. Byte classes are enough for the word patterns in use: bytes of
multi-byte characters never fall into the ASCII classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Word characters: anything but space and the controls \t to \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

# A to Z folded to a to z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the batch and the bounds of its texts; a null is an empty text."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return found[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes together; a longer text comes alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def find_words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each bound the number of words before it."""
    inside = is_word[data]
    fresh, last = inside.copy(), inside.copy()
    if len(data):
        breaks = np.zeros(len(data) + 1, dtype=bool)
        breaks[bounds] = True
        fresh[1:] &= ~inside[:-1] | breaks[1:-1]
        last[:-1] &= ~inside[1:] | breaks[1:-1]
    starts = np.flatnonzero(fresh)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        steps = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        steps[0] = back[0] = 1
        _powers.clear()
        _powers[size] = (np.multiply.accumulate(steps), np.multiply.accumulate(back))
    return _powers[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers, from which :func:`span_hashes` takes any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal for equal bytes wherever they stand."""
    back = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every ``width`` consecutive words of a text: position of the first word, text, hash."""
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    m = len(hashes) - width + 1
    at = np.flatnonzero(text[:m] == text[width - 1 :])
    joint = np.zeros(len(at), np.uint64)
    for k in range(width):
        joint = joint * np.uint64(0x9FB21C651E98DF25) + hashes[at + k]
    return at, text[at], mix(joint)


def in_pieces(texts: pa.Array, fn, limit: int = 1 << 18) -> pa.Array:
    """``fn(data, bounds)`` for pieces of the batch, its struct arrays put together."""
    data, bounds = text_bytes(texts)
    done = [fn(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in pieces(bounds, limit)]
    if not done:
        return fn(data, bounds)
    return pa.concat_arrays(done)
