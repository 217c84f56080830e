"""Vectorised word hashing over Arrow text columns.

All operators of this subpackage that work on words share one definition: A-Z
are lower-cased, words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text.  A batch
is handled as one byte array: word boundaries come from comparing neighbouring
bytes, 64-bit word hashes from differences of one running polynomial sum, so no
Python code runs per word.  Batches are cut into slices of about 1 MB, which
bounds the memory of a task whatever the batch size; one document is never cut.

Null texts read as empty.  Equal words always have equal hashes; two different
words share a 64-bit hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1024 * 1024

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

WS = np.zeros(256, dtype=bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_CHAR = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grow(n: int) -> None:
    """Make the tables of powers of the base (and its inverse) at least n long."""
    have = len(_powers["up"])
    if n > have:
        n = max(n, 2 * have)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first_row, end_row, bytes, offsets)`` of consecutive rows with
    at most ``limit`` bytes of text (one row at least); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs_buf, data_buf = column.buffers()
    offs = np.frombuffer(offs_buf, dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


class Words:
    """Words of the documents of one slice.

    ``start``/``end``: byte positions; ``bound``: document ``d`` owns the words
    ``bound[d]:bound[d+1]``; ``hash``: 64-bit word hashes; ``low``: the bytes,
    A-Z lower-cased.  ``separators`` marks the bytes between words.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, hashes: bool = True, separators: np.ndarray = WS):
        n = len(data)
        self.low = low = LOWER[data]
        ws = separators[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        begin = ~ws
        begin[1:] &= ws[:-1] | cut[1:-1]
        stop = ~ws
        stop[:-1] &= ws[1:] | cut[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.bound = np.searchsorted(self.start, offs)
        self.hash = self.span_hash(self.start, self.end) if hashes else None

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_run"):
            n = len(self.low)
            _grow(n + 1)
            run = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_CHAR[self.low] * _powers["up"][:n], out=run[1:])
            self._run = run
        return self._run

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans (lower-cased); equal bytes give equal hashes."""
        run = self._sums()
        return mix((run[end] - run[start]) * _powers["down"][start] + (end - start).astype(np.uint64))

    def shingles(self, d: int, k: int) -> np.ndarray:
        """Sorted distinct hashes of the ``k``-word shingles of document ``d``
        (with fewer words the whole sequence as one; without words none)."""
        return shingle_set(self.hash[self.bound[d]:self.bound[d + 1]], k)


def sequence_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive items of ``h``."""
    n = len(h) - k + 1
    acc = np.zeros(max(n, 0), dtype=np.uint64)
    if n <= 0:
        return acc
    for j in range(k):
        acc = acc * _SHINGLE + h[j:j + n]
    return mix(acc + np.uint64(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-shingle hashes of a word-hash sequence."""
    if len(h) == 0:
        return np.zeros(0, dtype=np.uint64)
    out = sequence_hash(h, min(k, len(h)))
    out.sort()
    keep = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]
