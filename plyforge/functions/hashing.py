"""Keyed hashes that order samples, as lower-case hex text, so that text order is their unsigned order.

Two profiles: RECORD hashes as the record format prescribes (BLAKE3 over length-prefixed parts, the first
eight bytes read as a little-endian number, 16 hex digits); TEXT is sha2-256 over "seed:key" and stays
within the JVM. Both are functions of their arguments alone: no partitioning or retry changes an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD, TEXT = "record", "text"

# Fixed values of the published BLAKE3 specification.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
_PERMUTED = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_BLOCK, _CHUNK = 64, 1024


def _mixed(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for word, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + word
        turned = v[d] ^ v[a]
        v[d] = (turned >> np.uint32(first)) | (turned << np.uint32(32 - first))
        v[c] = v[c] + v[d]
        turned = v[b] ^ v[c]
        v[b] = (turned >> np.uint32(second)) | (turned << np.uint32(32 - second))


def _compressed(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The chaining values (n, 8) after one block each: words (n, 16), counter, length and flags (n,)."""
    v = [chain[:, i] for i in range(8)] + [np.full(len(chain), _IV[i], dtype=np.uint32) for i in range(4)]
    v += [(counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length, flags]
    m = [words[:, i] for i in range(16)]
    for _ in range(7):
        for i in range(4):
            _mixed(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mixed(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in _PERMUTED]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def _chunks(parts: list[bytes], counters: list[int], root: list[bool]) -> np.ndarray:
    """Chaining values of chunks of at most 1024 bytes, all blocks of one position at once."""
    n = len(parts)
    blocks = np.array([max(1, -(-len(p) // _BLOCK)) for p in parts])
    sizes = np.array([len(p) for p in parts])
    most = int(blocks.max())
    data = np.frombuffer(b"".join(p.ljust(most * _BLOCK, b"\0") for p in parts), dtype="<u4").reshape(n, most, 16)
    chain = np.repeat(_IV[None, :], n, axis=0)
    at_root, counter = np.array(root), np.array(counters, dtype=np.uint64)
    for k in range(most):
        live = np.flatnonzero(blocks > k)
        last = blocks[live] == k + 1
        flags = np.where(last, _CHUNK_END, 0) | (_CHUNK_START if k == 0 else 0) | np.where(last & at_root[live], _ROOT, 0)
        length = np.minimum(sizes[live] - k * _BLOCK, _BLOCK)
        chain[live] = _compressed(chain[live], data[live, k].astype(np.uint32), counter[live], length.astype(np.uint32), flags.astype(np.uint32))
    return chain


def _long(message: bytes) -> np.ndarray:
    """The root chaining value of a message of several chunks."""
    pieces = [message[i : i + _CHUNK] for i in range(0, len(message), _CHUNK)]
    level = _chunks(pieces, list(range(len(pieces))), [False] * len(pieces))
    # The left subtree of every parent is the largest complete one, so pairs join level by level.
    while len(level) > 1:
        pairs = len(level) // 2
        words = level[: 2 * pairs].reshape(pairs, 16)
        root = _ROOT if len(level) == 2 else 0
        joined = _compressed(
            np.repeat(_IV[None, :], pairs, axis=0),
            words,
            np.zeros(pairs, dtype=np.uint64),
            np.full(pairs, _BLOCK, dtype=np.uint32),
            np.full(pairs, _PARENT | root, dtype=np.uint32),
        )
        level = np.concatenate([joined, level[2 * pairs :]])
    return level[0]


def blake3(messages: list[bytes]) -> list[bytes]:
    """The 32-byte BLAKE3 digests of the messages; those of one chunk are hashed together."""
    out: list[bytes] = [b""] * len(messages)
    short = [i for i, m in enumerate(messages) if len(m) <= _CHUNK]
    for k in range(0, len(short), 4096):
        part = short[k : k + 4096]
        made = _chunks([messages[i] for i in part], [0] * len(part), [True] * len(part))
        for i, value in zip(part, made, strict=True):
            out[i] = value.astype("<u4").tobytes()
    for i, message in enumerate(messages):
        if len(message) > _CHUNK:
            out[i] = _long(message).astype("<u4").tobytes()
    return out


def framed(*parts: bytes) -> bytes:
    """The parts, each after its length as eight little-endian bytes."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _number_hex(digest: bytes) -> str:
    return digest[:8][::-1].hex()


def seeded_hash(seed: int, key: Column, profile: str = RECORD) -> Column:
    """The hash of a text key under a seed, as hex text; null for a null key."""
    if profile == TEXT:
        return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)

    @F.pandas_udf("string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeded = seed.to_bytes(8, "little")
        for keys in batches:
            known = keys.dropna()
            values = [_number_hex(d) for d in blake3([framed(seeded, k.encode()) for k in known])]
            yield pd.Series(values, index=known.index, dtype=object).reindex(keys.index)

    return hashed(key)


def sample_id(sfen: Column, path: Column, ply: Column, profile: str = RECORD) -> Column:
    """The identity of a record for orders over whole data sets; null if a part is."""
    if profile == TEXT:
        return F.sha2(F.concat(sfen, F.lit("\n"), path, F.lit("\n"), ply.cast("string")), 256)

    @F.pandas_udf("string")
    def hashed(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for states, paths, plies in parts:
            known = states.notna() & paths.notna() & plies.notna()
            rows = zip(states[known], paths[known], plies[known], strict=True)
            values = [d.hex() for d in blake3([framed(s.encode(), p.encode(), int(n).to_bytes(4, "little")) for s, p, n in rows])]
            yield pd.Series(values, index=states.index[known], dtype=object).reindex(states.index)

    return hashed(sfen, path, ply)


def _options(options: list[tuple[str, str]]) -> bytes:
    return blake3([framed(*[part.encode() for pair in sorted(options) for part in pair])])[0]


def engine_options_hash(options: list[tuple[str, str]]) -> int:
    """A number for an engine's options that does not depend on their order."""
    return int.from_bytes(_options(options)[:8], "little")


def engine_options_hash_hex(options: list[tuple[str, str]]) -> str:
    """The whole digest that engine_options_hash takes its number from."""
    return _options(options).hex()
