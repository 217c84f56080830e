"""Hashed word and character n-gram counts of texts, a slice at a time.

Features are lower-cased words, the byte n-grams of ``" word "`` (so starts and
ends of words count) and, as the one word bigram, a word that equals the word
before it; each is hashed to one of ``2**bits`` buckets.  White
space runs read as one boundary; a null or empty text has no features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terrascope.llm.textvec import LOWER, WS, Words, mix, text_slices


_SAME = 0x9D3F5A61C2B47E08  # hash of "the same word again"


def slice_features(data: np.ndarray, offs: np.ndarray, bits: int, orders: tuple[int, ...], words: bool = True):
    """``(bucket, document)`` of every feature occurrence in a slice."""
    shift = np.uint64(64 - bits)
    bucket, owner = [], []
    if words:
        w = Words(data, offs)
        bucket.append((w.hash >> shift).astype(np.int32))
        owner.append(np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(w.bound)))
        again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (owner[0][1:] == owner[0][:-1])) + 1
        bucket.append(np.full(len(again), _SAME >> (64 - bits), dtype=np.int32))
        owner.append(owner[0][again])
    if orders:
        spaced = np.insert(LOWER[data], offs, 0x20)  # a space before each text and at the end
        ws = WS[spaced]
        spaced[ws] = 0x20
        of = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs) + 1)
        inner = np.concatenate(([0], np.cumsum(ws, dtype=np.int32)))
        for n in orders:
            m = len(spaced) - n + 1
            if m <= 0:
                continue
            # white space at the first or last place only, and not at both
            p = np.flatnonzero((inner[n - 1:n - 1 + m] == inner[1:1 + m]) & ~(ws[:m] & ws[n - 1:n - 1 + m]))
            code = np.zeros(len(p), dtype=np.uint64)
            for j in range(n):
                code = (code << np.uint64(8)) | spaced[p + j]
            bucket.append((mix(code + np.uint64(n << 56)) >> shift).astype(np.int32))
            owner.append(of[p])
    if not bucket:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(bucket), np.concatenate(owner)


def mean_scores(column: pa.Array, weights: np.ndarray, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Per text the mean over its features of ``weights[bucket]`` (``weights``:
    buckets x outputs); zeros for a text without features."""
    weights = np.ascontiguousarray(weights.reshape(1 << bits, -1).T)
    out = np.zeros((len(column), len(weights)))
    for a, b, data, offs in text_slices(column, 1 << 20):
        bucket, owner = slice_features(data, offs, bits, orders)
        n = np.maximum(np.bincount(owner, minlength=b - a), 1)
        for k, w in enumerate(weights):
            out[a:b, k] = np.bincount(owner, weights=w[bucket], minlength=b - a) / n
    return out


def sparse_rows(column: pa.Array, bits: int, orders: tuple[int, ...]) -> list[tuple[bytes, bytes]]:
    """Per text its distinct buckets (int32) and their shares (float32), as bytes."""
    out = []
    for a, b, data, offs in text_slices(column, 1 << 20):
        bucket, owner = slice_features(data, offs, bits, orders)
        code, count = np.unique(owner.astype(np.int64) << bits | bucket, return_counts=True)
        edge = np.searchsorted(code, np.arange(b - a + 1, dtype=np.int64) << bits)
        mask = (1 << bits) - 1
        for d in range(b - a):
            c = count[edge[d]:edge[d + 1]]
            out.append(((code[edge[d]:edge[d + 1]] & mask).astype("<i4").tobytes(),
                        (c / max(c.sum(), 1)).astype("<f4").tobytes()))
    return out


def dense(rows: list[tuple[bytes, bytes]], bits: int) -> np.ndarray:
    """A dense matrix of sparse rows."""
    x = np.zeros((len(rows), 1 << bits), dtype=np.float32)
    for i, (b, w) in enumerate(rows):
        x[i, np.frombuffer(b, "<i4")] = np.frombuffer(w, "<f4")
    return x
