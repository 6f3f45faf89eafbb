"""Anchors: a sample of positions by which any repeated window can be found exactly.

A sequence of symbols (bytes, or hashes of words) is sampled at the positions that hold the
least hash of k symbols (the first of equal ones) in some window of W symbols.  Which
position a window chooses depends on the window alone, so equal windows choose anchors at
the same place inside them.  Around an anchor all its windows lie in a *context*: at most
W - k symbols to the left and W to the right, cut at the document's ends.  A window is
repeated if and only if its anchor's context shares it, at the same offset, with the
context of another anchor of equal hash.  About 2 / (W - k + 2) of the positions are
anchors.

Neighbouring anchors of a document with equal hash and context (periodic text) make one
row, so a long run of one symbol costs a row and not one for each position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import text as tx

_STEP = 1 << 21
_MASK = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Anchors:
    doc: np.ndarray  # row number in the batch
    hash: np.ndarray  # of k symbols
    context: np.ndarray  # hash of the whole context
    first: np.ndarray  # position in the document of the first anchor of the row
    last: np.ndarray  # and of the last
    count: np.ndarray
    left: np.ndarray  # symbols of the context before the anchor
    right: np.ndarray  # and from it on


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive bytes; k is a power of two."""
    h, span = tx._BYTE[data], 1
    factor = 0xD1342543DE82EF95
    while span < k:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    return tx.mix64(h)


def find(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Anchors:
    """The anchors of documents symbols[offsets[i]:offsets[i + 1]]."""
    is_byte = symbols.dtype == np.uint8
    wide = window - k + 1
    lengths = np.diff(offsets)
    chosen, hashes = [], []
    for lo in range(0, max(0, len(symbols) - window + 1), _STEP):
        part = symbols[lo : lo + _STEP + window - 1]
        g = byte_grams(part, k) if is_byte else tx.grams(part, k)
        packed = (g & ~_MASK) | np.arange(len(g), dtype=np.uint64)
        least = tx.window_min(packed, wide)
        # windows inside one document
        a = np.searchsorted(offsets, lo, "right") - 1
        b = np.searchsorted(offsets, lo + len(least), "left")
        over = np.zeros(len(least) + 1, np.int32)
        ends = offsets[a + 1 : b + 1] - lo
        np.add.at(over, np.clip(np.maximum(ends - window + 1, offsets[a:b][: len(ends)] - lo), 0, len(least)), 1)
        np.add.at(over, np.clip(ends, 0, len(least)), -1)
        at = (least[np.cumsum(over[:-1]) == 0] & _MASK).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        chosen.append(at + lo)
        hashes.append(g[at])
    if not sum(map(len, chosen)):
        z = np.zeros(0, np.int64)
        return Anchors(z, z.view(np.uint64), z.view(np.uint64), z, z, z, z, z)
    at, h = np.concatenate(chosen), np.concatenate(hashes)
    fresh = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
    at, h = at[fresh], h[fresh]
    doc = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(at - offsets[doc], window - k)
    right = np.minimum(offsets[doc] + lengths[doc] - at, window)
    context = _overlapping(symbols, at - left, at + right)
    context = tx.mix64(context + (left * 512 + right).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])
    row = np.flatnonzero(new)
    end = np.append(row[1:], len(at)) - 1
    base = offsets[doc[row]]
    return Anchors(doc[row], h[row], context[row], at[row] - base, at[end] - base, end - row + 1, left[row], right[row])


def _overlapping(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash for spans of bytes or of 64-bit symbols; starts and ends ascend."""
    if symbols.dtype == np.uint8:
        return tx.span_hash(symbols, starts, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + tx._CHUNK, "right")))
        seen = symbols[base : ends[to - 1]] * tx._POW[: ends[to - 1] - base]
        total = np.zeros(len(seen) + 1, np.uint64)
        np.cumsum(seen, out=total[1:])
        s = starts[at:to] - base
        out[at:to] = (total[ends[at:to] - base] - total[s]) * tx._INV[s]
        at = to
    return tx.mix64(out)
