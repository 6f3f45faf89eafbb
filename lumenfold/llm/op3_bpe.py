"""Byte-level BPE encoding and decoding with segment trees.

A text is split by the tokenizer's pattern; each match is merged on its own.  A segment tree
stands over the byte positions of a match.  Its leaves hold the rank of the pair that starts
there (none: infinite), its nodes the leftmost least of their leaves, so the root is the next
merge.  A merge kills one leaf and changes the pair of the merged part and of its live left
neighbour: three point updates of logarithmic cost.

Matches of up to `SHORT` bytes are merged together, a round of all their trees at a time in
arrays (`Forest`); longer ones one by one (`Tree`), in O(n log n) whatever they hold.  A
worker keeps the ids of at most `KEPT` short matches.

Null and empty texts have no ids.  Every row gives a row; null ids of rows are kept.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

SHORT = 64
KEPT = 400_000
_NONE = np.int64(1) << 40


class Vocabulary:
    """Ranks of byte strings, and of the pairs of them that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for token, rank in self.rank.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it doesn't merge (or right is negative)."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (right >= 0) & (left >= 0), self._ranks[at], _NONE)


class Tree:
    """The merges of one string."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes):
        n = len(piece)
        self.width = width = 1 << max(0, (n - 1).bit_length())
        self.ids = vocabulary.single[np.frombuffer(piece, np.uint8)].tolist()
        self.next = list(range(1, n)) + [-1]
        self.before = list(range(-1, n - 1))
        self.pairs = vocabulary.pairs
        none = (1 << 62, 0)
        self.node = [none] * (2 * width)
        self.none = none
        for p in range(n):
            self.node[width + p] = self._leaf(p)
        for i in range(width - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def _leaf(self, p: int) -> tuple[int, int]:
        q = self.next[p]
        rank = self.pairs.get(self.ids[p] << 20 | self.ids[q]) if q >= 0 else None
        return self.none if rank is None else (rank, p)

    def _set(self, p: int, value: tuple[int, int]) -> None:
        node, i = self.node, self.width + p
        node[i] = value
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a <= b else b
            if node[i] == low:
                break
            node[i] = low
            i >>= 1

    def merged(self) -> list[int]:
        while self.node[1] is not self.none and self.node[1] != self.none:
            rank, p = self.node[1]
            q = self.next[p]
            after = self.next[q]
            self.ids[p], self.ids[q] = rank, -1
            self.next[p] = after
            if after >= 0:
                self.before[after] = p
            self._set(q, self.none)
            self._set(p, self._leaf(p))
            if self.before[p] >= 0:
                self._set(self.before[p], self._leaf(self.before[p]))
        return [i for i in self.ids if i >= 0]


class Forest:
    """The merges of many strings of up to `width` bytes (a power of two) at once."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[bytes], width: int):
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        column = np.arange(width)
        self.vocabulary, self.width = vocabulary, width
        self.ids = np.where(column < lengths[:, None], vocabulary.single[data], -1)
        self.next = np.where(column + 1 < lengths[:, None], column + 1, -1)
        self.before = np.broadcast_to(column - 1, (m, width)).copy()
        # key of a leaf: rank, then place, so that the least is the leftmost of the least rank
        self.tree = np.full((m, 2 * width), _NONE << 8)
        right = np.where(self.next >= 0, np.roll(self.ids, -1, axis=1), -1)
        self.tree[:, width:] = vocabulary.pair_ranks(self.ids, right) << 8 | column
        for i in range(width - 1, 0, -1):
            self.tree[:, i] = np.minimum(self.tree[:, 2 * i], self.tree[:, 2 * i + 1])

    def _pair(self, row: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = self.next[row, p]
        right = np.where(q >= 0, self.ids[row, q], -1)
        return self.vocabulary.pair_ranks(self.ids[row, p], right) << 8 | p

    def merged(self) -> list[list[int]]:
        tree, width = self.tree, self.width
        row = np.arange(len(tree))
        while True:
            row = row[tree[row, 1] < _NONE << 8]
            if not len(row):
                break
            root = tree[row, 1]
            p = root & 0xFF
            q = self.next[row, p]
            after = self.next[row, q]
            self.ids[row, p] = root >> 8
            self.ids[row, q] = -1
            self.next[row, p] = after
            live = after >= 0
            self.before[row[live], after[live]] = p[live]
            tree[row, width + q] = _NONE << 8
            tree[row, width + p] = self._pair(row, p)
            left = self.before[row, p]
            some = left >= 0
            tree[row[some], width + left[some]] = self._pair(row[some], left[some])
            rows = np.concatenate([row, row, row[some]])
            node = np.concatenate([q, p, left[some]]) + width
            while width > 1 and node[0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        kept = self.ids >= 0
        flat = self.ids[kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge(vocabulary: Vocabulary, pieces: list[bytes]) -> list[tuple[int, ...]]:
    """The ids of each string, a single one for a string that is a token."""
    out: list = [None] * len(pieces)
    widths: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocabulary.rank.get(piece)
        if whole is not None:
            out[i] = (whole,)
        elif len(piece) > SHORT:
            out[i] = tuple(Tree(vocabulary, piece).merged())
        else:
            widths.setdefault(1 << max(0, (len(piece) - 1).bit_length()), []).append(i)
    for width, some in widths.items():
        for at in range(0, len(some), 8192):
            part = some[at : at + 8192]
            for i, ids in zip(part, Forest(vocabulary, [pieces[i] for i in part], width).merged()):
                out[i] = tuple(ids)
    return out


class Codec:
    """Encodes and decodes texts by a file of ranks and the pattern that splits them."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        parts = [self.split(t) for t in texts]
        known = self.known
        new = {p for ps in parts for p in ps if p not in known}
        if len(known) + len(new) > KEPT:
            known.clear()
            new = {p for ps in parts for p in ps}
        fresh = list(new)
        ids = dict(zip(fresh, merge(self.vocabulary, [p.encode() for p in fresh])))
        long = [p for p in fresh if len(p) > SHORT]
        known.update(ids)
        out = [list(chain.from_iterable(map(known.__getitem__, ps))) for ps in parts]
        for p in long:
            del known[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec."""
    return common.held(("op3", path, pattern), lambda: Codec(path, pattern))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row of docs(doc_id, text)."""
    docs = common.named(docs, doc_id="doc_id", text="text")

    def run(batches):
        own = codec(path, pattern)
        for batch in common.slices(batches):
            ids = own.encode_all(_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.mapped(docs, run, "doc_id long, ids array<int>", keeps="op3")


def decoded(encoded_: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) of each row of encoded_(doc_id, ids)."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return common.mapped(encoded_.select("doc_id", "ids"), run, "doc_id long, data binary", keeps="op3")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text)."""
    docs = common.named(docs, doc_id="doc_id", text="text")

    def run(batches):
        own = codec(path, pattern)
        decimal = own.vocabulary.decimal.__getitem__
        for batch in common.slices(batches):
            count, ids_hash, data_hash = [], [], []
            for ids in own.encode_all(_texts(batch.column("text"))):
                count.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                data_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(data_hash)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.mapped(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps="op3")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
