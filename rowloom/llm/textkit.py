"""Whole-batch text primitives over Arrow string columns: words, hashes, byte windows.

Everything works on the UTF-8 bytes of many texts at once, so the cost is a few numpy passes
a byte and no Python object a word. Texts are never cut; a chunk holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit words from a counter."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0xA0761D6478BD642F) + mix64(np.array([seed], dtype=_U))[0])


_BYTE_CODE = stream(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES)
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)]
    return _POWERS[0], _POWERS[1]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and each text's first word index."""
    n = len(data)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    gap = blank[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[1:], before[0] = gap[:-1], True
    after[:-1], after[-1] = gap[1:], True
    cut = offs[1:-1]
    before[cut[cut < n]] = True
    after[cut[cut > 0] - 1] = True
    ink = ~gap
    starts, ends = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, from one running sum over the chunk."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9FB21C651E98DF25) + _U(seed))


def shingle_sets(words: np.ndarray, firsts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text counts whole as one."""
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), dtype=_U)
    for i in range(k):
        rolled = mix64(rolled + _U(i + 1)) + words[i : n - k + 1 + i] if len(rolled) else rolled
    rolled = mix64(rolled)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = np.array([b - a], dtype=_U)
            for w in words[a:b]:
                whole = mix64(whole) + w
            yield mix64(whole ^ _U(0x51ED270B8D5C3A97))
        else:
            yield np.empty(0, dtype=_U)
