"""BLAKE3 hashes and the deterministic ids that are made of them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the published BLAKE3 specification
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, MASK = 64, 1024, 0xFFFFFFFF
# ----------------------------------------------------
_MIX = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv: tuple[int, ...], block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, BLOCK, 4)]
    v = [*cv, *IV[:4], counter & MASK, counter >> 32 & MASK, size, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIX):
            va, vb, vc, vd = v[a], v[b], v[c], v[d]
            for x, r, q in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                va = va + vb + x & MASK
                vd ^= va
                vd = (vd >> r | vd << 32 - r) & MASK
                vc = vc + vd & MASK
                vb ^= vc
                vb = (vb >> q | vb << 32 - q) & MASK
            v[a], v[b], v[c], v[d] = va, vb, vc, vd
        m = [m[i] for i in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: bool) -> list[int]:
    cv: list[int] = list(IV)
    n = max(1, -(-len(data) // BLOCK))
    for i in range(n):
        part = data[i * BLOCK : (i + 1) * BLOCK]
        flags = (CHUNK_START if i == 0 else 0) | ((CHUNK_END | (ROOT if root else 0)) if i == n - 1 else 0)
        cv = _compress(tuple(cv), part.ljust(BLOCK, b"\0"), counter, len(part), flags)
    return cv


def _parent(left: list[int], right: list[int], root: bool) -> list[int]:
    block = b"".join(x.to_bytes(4, "little") for x in (*left, *right))
    return _compress(IV, block, 0, BLOCK, PARENT | (ROOT if root else 0))


def _chunk_values(data: bytes, first: int) -> list[list[int]]:
    """Chaining values of whole chunks, none of them the root; many at once."""
    n = len(data) // CHUNK
    if n < 8:
        return [_chunk(data[i * CHUNK : (i + 1) * CHUNK], first + i, False) for i in range(n)]
    out: list[list[int]] = []
    for at in range(0, n, 8192):
        k = min(8192, n - at)
        words = np.frombuffer(data, "<u4", k * 256, at * CHUNK).reshape(k, 16, 16)
        cv = np.repeat(np.array(IV, np.uint32)[:, None], k, axis=1)
        counter = np.arange(first + at, first + at + k, dtype=np.uint64)
        for b in range(16):
            flags = np.full(k, CHUNK_START if b == 0 else CHUNK_END if b == 15 else 0)
            cv = _compress_many(cv, words[:, b].T, counter, np.full(k, BLOCK), flags)
        out += cv.T.tolist()
    return out


class Blake3:
    """Streaming BLAKE3 of 32 bytes; memory grows with the logarithm of the input."""

    def __init__(self) -> None:
        self._stack: list[list[int]] = []
        self._buffer = bytearray()
        self._chunks = 0

    def update(self, data: bytes) -> Blake3:
        self._buffer += data
        full = (len(self._buffer) - 1) // CHUNK  # the last chunk waits, as it may be the root
        if full < 1:
            return self
        for cv in _chunk_values(bytes(self._buffer[: full * CHUNK]), self._chunks):
            self._chunks += 1
            n = self._chunks
            while n & 1 == 0:
                cv = _parent(self._stack.pop(), cv, False)
                n >>= 1
            self._stack.append(cv)
        del self._buffer[: full * CHUNK]
        return self

    def hexdigest(self) -> str:
        cv = _chunk(bytes(self._buffer), self._chunks, not self._stack)
        for i in range(len(self._stack) - 1, -1, -1):
            cv = _parent(self._stack[i], cv, i == 0)
        return b"".join(x.to_bytes(4, "little") for x in cv).hex()


def blake3_hex(data: bytes | str) -> str:
    data = data.encode() if isinstance(data, str) else data
    return Blake3().update(data).hexdigest() if len(data) <= 2 * CHUNK else blake3_many([data])[0]


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def _compress_many(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression function over many lanes: cv (8, n), message words (16, n); counter, size and flags (n)."""
    v = [*cv]
    v += [np.full(cv.shape[1], x, np.uint32) for x in IV[:4]]
    v += [counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    order = list(range(16))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIX):
            for x, r, q in ((m[order[2 * k]], 16, 12), (m[order[2 * k + 1]], 8, 7)):
                v[a] = v[a] + v[b] + x
                v[d] = _rotate(v[d] ^ v[a], r)
                v[c] = v[c] + v[d]
                v[b] = _rotate(v[b] ^ v[c], q)
        order = [order[i] for i in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3_many(items: list[bytes]) -> list[str]:
    """BLAKE3 of many texts at once: all their chunks are lanes of one vector, then all parents of a level."""
    pieces = [(f, i, d[i * CHUNK : (i + 1) * CHUNK]) for f, d in enumerate(items) for i in range(max(1, -(-len(d) // CHUNK)))]
    done: list[list[np.ndarray]] = [[] for _ in items]
    n_chunks = [max(1, -(-len(d) // CHUNK)) for d in items]
    for at in range(0, len(pieces), 8192):
        part = pieces[at : at + 8192]
        n = len(part)
        data = np.frombuffer(b"".join(p.ljust(CHUNK, b"\0") for _, _, p in part), "<u4").reshape(n, 16, 16)
        length = np.fromiter((len(p) for _, _, p in part), np.int64, n)
        blocks = np.maximum(1, -(-length // BLOCK))
        counter = np.fromiter((i for _, i, _ in part), np.uint64, n)
        root = np.fromiter((n_chunks[f] == 1 for f, _, _ in part), bool, n)
        cv = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
        for b in range(int(blocks.max())):
            on = np.nonzero(blocks > b)[0]
            last = blocks[on] == b + 1
            size = np.where(last, length[on] - b * BLOCK, BLOCK)
            flags = (CHUNK_START if b == 0 else 0) | np.where(last, CHUNK_END, 0) | np.where(last & root[on], ROOT, 0)
            cv[:, on] = _compress_many(cv[:, on], data[on, b].T, counter[on], size, flags)
        for k, (f, _, _) in enumerate(part):
            done[f].append(cv[:, k])
    while True:
        # neighbours are joined level by level; an odd last node moves up as it is
        pairs = [(f, i) for f, nodes in enumerate(done) for i in range(0, len(nodes) - 1, 2)]
        if not pairs:
            break
        left = np.stack([done[f][i] for f, i in pairs], 1)
        right = np.stack([done[f][i + 1] for f, i in pairs], 1)
        n = len(pairs)
        flags = np.array([PARENT | (ROOT if len(done[f]) == 2 else 0) for f, _ in pairs])
        up = _compress_many(np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1), np.concatenate([left, right]), np.zeros(n, np.uint64), np.full(n, BLOCK), flags)
        joined: dict[int, list[np.ndarray]] = {}
        for k, (f, _) in enumerate(pairs):
            joined.setdefault(f, []).append(up[:, k])
        for f, nodes in joined.items():
            done[f] = nodes + done[f][len(nodes) * 2 :]
    return [nodes[0].astype("<u4").tobytes().hex() for nodes in done]


def make_id(prefix: str, text: str) -> str:
    """`prefix_` and the first 16 hexadecimal digits of the BLAKE3 of the text."""
    return f"{prefix}_{blake3_hex(text)[:16]}"


def _blake3_series(s: pd.Series) -> pd.Series:
    there = s.notna()
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    out[there] = blake3_many([x.encode() for x in s[there]])
    return out


def blake3(col: Column) -> Column:
    """BLAKE3 of a string column as hexadecimal text; null stays null."""
    return F.pandas_udf(_blake3_series, T.StringType())(col)


def id_column(prefix: str, parts: Iterable[Column]) -> Column:
    """Deterministic id of a record from the texts that identify it, joined by colons."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(blake3(F.concat_ws(":", *parts)), 1, 16))
