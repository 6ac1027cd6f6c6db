"""Word shingles of whole texts as 64-bit hashes, with numpy over Arrow's bytes.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. A word's
hash is a polynomial over its bytes modulo 2**64, mixed; a shingle's one over its words' hashes.
Two different shingles share a hash with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_P = _U(0x9E3779B97F4A7C15 | 3)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(max(n, CHUNK + 1) - 1, b)]).astype(np.uint64)) for b in (_P, _P_INVERSE)]
    return _powers


def pieces(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) of runs of rows of about `most` bytes; a null row is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each row's first word's index (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SEP[data]
    rows = offsets[:-1][offsets[:-1] < n]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[rows] = word[rows]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = rows[rows > 0] - 1
    last[ends] = word[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        h = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _P)
    return h, np.searchsorted(start, offsets)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` hashes."""
    n = max(0, len(h) - width + 1)
    with np.errstate(over="ignore"):
        x = np.zeros(n, np.uint64)
        for k in range(width):
            x += mixed(h[k : k + n] ^ _PLACE[k]) * _PLACE[63 - k]
    return mixed(x)


def sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row; fewer words than width are one shingle, none an empty set."""
    for at, data, offsets in pieces(texts):
        h, words = word_hashes(data, offsets)
        all_of = windows(h, width)
        for i, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True)):
            if b - a >= width:
                yield at + i, np.unique(all_of[a : b - width + 1])
            elif b > a:
                yield at + i, windows(h[a:b], b - a) ^ _U(b - a)
            else:
                yield at + i, np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        x = mixed(np.array([mixed(s).sum(dtype=np.uint64) * _P + _U(len(s))], np.uint64))
    return int(x.view(np.int64)[0])
