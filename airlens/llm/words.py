"""Words of whole Arrow text columns as 64-bit hashes, computed on the UTF-8 bytes without a Python object per word.

A word is a maximal run of word bytes; A-Z count as a-z. The hash of a word is the sum of T[byte] * R**offset modulo
2**64 (T: 256 drawn numbers, R odd), taken from one running sum per block, then mixed. Text is handled in blocks of
`BLOCK` bytes that end at text borders, so memory is bounded by the block or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _table(word_byte) -> np.ndarray:
    drawn = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
    drawn[65:91] = drawn[97:123]
    return np.where([word_byte(b) for b in range(256)], drawn, np.uint64(0))


#: word classes: what the byte table is zero for separates words
ALNUM = "alnum"  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
SPACED = "spaced"  # [^\x20\x09-\x0D]+
_TABLES = {
    ALNUM: _table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122),
    SPACED: _table(lambda b: b != 32 and not 9 <= b <= 13),
}
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n at least, grown by doubling and kept by the worker."""
    for name, base in (("up", _R), ("down", _R_INVERSE)):
        p = _powers.get(name)
        if p is None:
            p = np.array([1], dtype=np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        _powers[name] = p
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA9B0C7EBA1DA115)
    return h ^ (h >> np.uint64(32))


def _block(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    t = _TABLES[kind][data]
    inside = t != 0
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = len(data) > 0 and inside[0]
    edge[-1] = len(data) > 0 and inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    # a text border inside a run ends one word and begins the next
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    start, end = at[0::2], at[1::2]
    up, down = _power(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(t * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start]), np.searchsorted(start, offsets, "left")


_BYTES = _table(lambda b: True)
_BYTES[65:91] = np.random.Generator(np.random.PCG64(20250301)).integers(1, 1 << 63, 26, dtype=np.uint64)


def hashed_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, every byte with its case."""
    up, down = _power(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n+1 offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def hashed(column: pa.Array, kind: str = ALNUM, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first row, end row, word hashes, bounds): words of row i of the block are hashes[bounds[i]:bounds[i+1]]."""
    n = len(column)
    if not n:
        return
    data, offsets = text_buffers(column)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = int(offsets[row]), int(offsets[end])
        h, bounds = _block(data[lo:hi], offsets[row : end + 1] - lo, kind)
        yield row, end, h, bounds
        row = end


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words that stay inside a row, and their bounds by row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix(g * _GOLD + h[k : len(h) - n + 1 + k])
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(bounds[:-1], counts) + (np.arange(ends[-1]) - np.repeat(ends[:-1], counts))
    return g[start], ends
