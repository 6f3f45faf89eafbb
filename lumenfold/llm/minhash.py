"""Shingle sets and circulant MinHash signatures of Arrow batches of texts."""

from __future__ import annotations

import numpy as np

from . import text as tx

_CELLS = 1 << 15


def shingle_sets(data, offsets, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, first hash of each document and the total): each document's distinct
    word shingles, sorted, A-Z lower-cased; a text with fewer words is one shingle."""
    starts, ends, first = tx.words(data, offsets)
    h = tx.span_hash(data, starts, ends, lower=True)
    count = np.diff(first)
    n_docs = len(count)
    g = tx.grams(h, size)
    doc = tx.owner(first)
    keep = doc[: len(g)] == doc[size - 1 :] if len(g) else np.zeros(0, bool)
    owner, keys = doc[: len(g)][keep], g[keep]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for n in range(1, size):
            some = np.flatnonzero(count[short] == n)
            runs = h[first[short[some]][:, None] + np.arange(n)]
            code = np.full(len(some), n, np.uint64)
            for j in range(n):
                code = tx.mix64(code * np.uint64(0xD1342543DE82EF95) + runs[:, j])
            own[some] = code
        owner, keys = np.concatenate([owner, short]), np.concatenate([keys, own])
    order = np.argsort(keys)
    order = order[np.argsort(owner[order], kind="stable")]
    owner, keys = owner[order], keys[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        owner, keys = owner[new], keys[new]
    return keys, np.searchsorted(owner, np.arange(n_docs + 1))


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each whole set, whatever the order of its members: shape (n, 2)."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    for j, salt in enumerate((0x51ED270B76F1D2A3, 0xC2B2AE3D27D4EB4F)):
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(tx.mix64(sets ^ np.uint64(salt)), out=total[1:])
        out[:, j] = tx.mix64(total[at[1:]] - total[at[:-1]])
    return out


def circulant(sets: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Signatures, shape (documents, k); rows of empty sets are all ones.

    Two permutations of the 32-bit words make all coordinates: sigma scatters a
    set once, and coordinate j is the least value that pi, shifted circularly by
    j times an odd constant (so that neighbouring shifts share no short pattern), gives to a member of sigma's image.
    """
    out = np.full((len(at) - 1, k), 0xFFFFFFFF, np.uint32)
    sigma = (tx.mix64(sets ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
    docs = np.flatnonzero(np.diff(at))
    i = 0
    while i < len(docs):
        to = max(i + 1, int(np.searchsorted(at[docs + 1], at[docs[i]] + _CELLS, "right")))
        low, high = at[docs[i]], at[docs[to - 1] + 1]
        begin = at[docs[i:to]] - low
        for lo in range(low, high, 1 << 20) if to == i + 1 else (low,):
            x = sigma[lo : min(high, lo + (1 << 20))] if to == i + 1 else sigma[low:high]
            v, w = np.empty_like(x), np.empty_like(x)
            for j in range(k):
                np.add(x, np.uint32((j * 0x9E3779B1) & 0xFFFFFFFF), out=v)
                v *= np.uint32(0x85EBCA6B)
                np.right_shift(v, 15, out=w)
                v ^= w
                v *= np.uint32(0xC2B2AE35)
                np.right_shift(v, 16, out=w)
                v ^= w
                if to == i + 1:
                    out[docs[i], j] = min(out[docs[i], j], v.min())
                else:
                    out[docs[i:to], j] = np.minimum.reduceat(v, begin)
        i = to
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of so many coordinates, shape (documents, bands)."""
    n, k = signatures.shape
    bands = k // rows
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        code = np.full(n, b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            code = tx.mix64(code * np.uint64(0xD1342543DE82EF95) + signatures[:, j].astype(np.uint64))
        out[:, b] = code
    return out
