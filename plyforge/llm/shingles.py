"""Distinct word shingles of texts as 64-bit hashes, a buffer of many texts at a time."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
#: Bytes of text hashed at once; a longer text is a buffer of its own.
BUFFER = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, _U(b & _MASK), dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _hashes(bodies: list[bytes]) -> list[np.ndarray]:
    joined = b"\n".join(bodies) + b"\n"
    data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    n = len(data)
    up, down = _powers(1 << max(n - 1, BUFFER).bit_length())
    blank = _SPACE[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1])))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    edges = np.zeros(len(bodies) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in bodies], out=edges[1:])
    at = np.searchsorted(starts, edges)  # each text's words: at[k] to at[k + 1]
    last = len(words) - WORDS + 1
    if last > 0:
        rolled = words[:last].copy()
        for k in range(1, WORDS):
            rolled = rolled * _U(0x100000001B3) + words[k : k + last]
        rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            h = _U(b - a)
            for w in words[a:b]:
                h = np.array([h], dtype=np.uint64) * _U(0x100000001B3) + w
            out.append(mix(h.reshape(-1) ^ _U(0x5BD1E995)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A-Z are lower-cased; words are runs of bytes other than blank and 9 to 13. A text of fewer
    words than a shingle has its whole sequence as one; null and texts without words have none.
    """
    out, held, size = [], [], 0
    for text in texts:
        body = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(body) > BUFFER:
            out += _hashes(held)
            held, size = [], 0
        held.append(body)
        size += len(body) + 1
    return out + _hashes(held) if held else out
