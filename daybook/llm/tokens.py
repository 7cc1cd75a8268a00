"""Words and shingles of Arrow text columns as 64-bit hashes, by whole-array numpy operations inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that are hashed at a time: bounds a task's memory (one longer text is a chunk of its own).
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[ord("A") : ord("Z") + 1] += 32
_BASE = U(0x9E3779B97F4A7C15)
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUE = mix(np.arange(1, 257, dtype=U) * _BASE)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK * 2, 1 << max(n, 1).bit_length())
    if not _powers or next(iter(_powers)) < n:
        up, down = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        up[0] = down[0] = U(1)
        _powers.clear()
        _powers[size] = (np.cumprod(up), np.cumprod(down))
    return next(iter(_powers.values()))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts with about CHUNK bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of the chunk, and where each text's words begin (one more at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    starts[begins] = solid[begins]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = solid[last]
    at, to = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    up, down = power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(VALUE[LOWER_BYTES[raw] if lower else raw] * up[:n], out=sums[1:])
    return mix((sums[to] - sums[at]) * down[at] + (to - at).astype(U)), np.searchsorted(at, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text; with fewer words the whole sequence is one shingle."""
    for first, last, raw, offsets in text_chunks(texts):
        h, cuts = word_hashes(raw, offsets)
        s = np.zeros(max(0, len(h) - width + 1), U)
        for k in range(width):
            s += h[k : len(h) - width + 1 + k] * STEPS[k % 5] ** U(k // 5 + 1) if len(s) else U(0)
        s = mix(s)
        for i in range(last - first):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if b - a >= width:
                yield first + i, np.unique(s[a : b - width + 1])
            elif b > a:
                few = np.array([b - a], U)
                for k in range(a, b):
                    few = mix(few * STEPS[0] + h[k : k + 1])
                yield first + i, few
            else:
                yield first + i, np.zeros(0, U)
