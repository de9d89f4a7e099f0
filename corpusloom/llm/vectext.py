"""Words and shingles of many texts at once in numpy: no Python work for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_RNG = np.random.default_rng(20240517)
BYTE_KEYS = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
PLACE_KEYS = _RNG.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and doubled as needed."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.empty(size, np.uint64)
        held[0], done = 1, 1
        while done < size:
            held[done : 2 * done] = held[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = held
    return held[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; null is empty."""
    arr = pa.compute.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and each text's first word."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c such that (c[z] - c[a]) * INVERSE**a depends on data[a:z] alone."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * powers(MULTIPLIER, len(data)), out=c[1:]) if len(data) else None
    return c


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = prefix_hash(data)
    return mix64((c[ends] - c[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of hashed shingles of width lower-cased words; fewer words make one shingle, none an empty set."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += h[k : n + k] * PLACE_KEYS[k]
    rolled = mix64(rolled + np.uint64(width))
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= width:
            out.append(np.unique(rolled[a : z - width + 1]))
        elif z > a:
            out.append(mix64(np.array([np.sum(h[a:z] * PLACE_KEYS[: z - a]) + np.uint64(z - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
