"""Suffix-array dedup of bytes by a distributed merge sort that knows common prefixes.

The suffixes that are sorted start at anchors (anchors.py), so the array is sparse: about one
suffix in 85 bytes, and of these only suffixes whose first 32 bytes occur twice travel.

*   Each task sorts its suffixes (up to `window` bytes of each) into runs, one for each cell,
    and *front-codes* a run: the length of the prefix shared with the suffix before, and the
    rest.  Spark exchanges these runs.
*   A cell merges its runs with a *loser tree* whose players carry the length of the prefix
    they share with the last winner.  Two players are told apart by these lengths alone, or
    compared from that length on; no byte of a known prefix is read again.  The lengths that
    come out are the longest-common-prefix array of the merged suffix array.
*   With the classes of the bytes before the anchors, the intervals of that array tell which
    200-byte strings occur again (repeats.reaches).

Matches are within documents, strings are judged on the input, and each byte that a repeated
string covers is removed.  Null and empty texts have no bytes; every row gives a row, and
repeated rows repeat each other; null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, repeats
from . import text as tx

WINDOW = 200
ANCHOR = 32
#: Suffixes that a task holds before it sends its runs.
RUN = 50_000


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of x and y, which share `known` bytes."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return known + (8 * len(a) - differ.bit_length()) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefix, length, rests) of a sorted run."""
    shared = np.zeros(len(strings), np.uint8)
    rests, before = [], b""
    for i, s in enumerate(strings):
        n = common_prefix(before, s, 0) if i else 0
        shared[i] = n
        rests.append(s[n:])
        before = s
    return shared, np.array([len(s) for s in strings], np.uint8), b"".join(rests)


def decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared prefix, string) of a front-coded run, one at a time."""
    before, at = b"", 0
    for n, size in zip(shared.tolist(), lengths.tolist()):
        rest = rests[at : at + size - n]
        at += size - n
        before = before[:n] + rest
        yield n, before


class LoserTree:
    """Merges sorted runs of (shared prefix, string); gives (run, shared prefix with the
    string given before)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        self.k = len(runs)
        self.prefix = [0] * self.k
        self.string: list[bytes | None] = [next(r, (0, None))[1] for r in runs]
        self.loser = [0] * self.k
        winner = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            winner[node], self.loser[node] = self._play(winner[2 * node], winner[2 * node + 1])
        self.winner = winner[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then the one it shares with the winner."""
        x, y = self.string[a], self.string[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.prefix[a], self.prefix[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        n = common_prefix(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.prefix[b] = n
            return a, b
        self.prefix[a] = n
        return b, a

    def __iter__(self):
        string, prefix, loser = self.string, self.prefix, self.loser
        w = self.winner
        while self.k and string[w] is not None:
            yield w, prefix[w]
            prefix[w], string[w] = next(self.runs[w], (0, None))
            node = (self.k + w) >> 1
            while node:
                w, loser[node] = self._play(w, loser[node])
                node >>= 1


_OWN = ("h", "s", "c", "g")
_RUN = (
    "cell int, h array<long>, s array<long>, c array<long>, g array<long>, low binary, high binary, shared binary, lengths binary, rests binary, llen binary, left binary"
)


def _cells(window: int, k: int):
    before = window - k

    def cells(texts: DataFrame, n: int, text: str) -> DataFrame:
        def runs(batches):
            held: list[tuple] = []
            size = 0

            def flush():
                own_ = {x: np.concatenate([p[x] for p, _, _ in held]) for x in (*_OWN, "low", "high", "left")}
                right = [r for _, rs, _ in held for r in rs]
                left, llen = np.concatenate([x for _, _, x in held]), own_["left"].astype(np.int64)
                cell = (tx.mix64(own_["g"].view(np.uint64)) % np.uint64(n)).astype(np.int64)
                by_cell = np.argsort(cell, kind="stable")
                edges = np.flatnonzero(np.diff(cell[by_cell])) + 1
                for own in np.split(by_cell, edges):
                    own = np.array(sorted(own.tolist(), key=right.__getitem__))
                    shared, lengths, rests = front_coded([right[i] for i in own])
                    bytes_before = left[own][np.arange(before) < llen[own][:, None]]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "cell": pa.array([int(cell[own[0]])], pa.int32()),
                            **{x: pa.array([own_[x][own]], pa.list_(pa.int64())) for x in _OWN},
                            **{x: [own_[x][own].astype(np.uint8).tobytes()] for x in ("low", "high")},
                            "shared": [shared.tobytes()],
                            "lengths": [lengths.tobytes()],
                            "rests": [rests],
                            "llen": [llen[own].astype(np.uint8).tobytes()],
                            "left": [bytes_before.tobytes()],
                        }
                    )

            for batch in repeats.unpacked(batches, text):
                data, where, p = repeats.picked(batch, repeats.byte_symbols, text)
                raw = data.tobytes()
                right = [raw[a : a + m] for a, m in zip(where.tolist(), p["right"].tolist())]
                left = data[np.maximum(where[:, None] - 1 - np.arange(before), 0)] if len(data) else np.zeros((0, before), np.uint8)
                held.append((p, right, left))
                size += len(right)
                if size >= RUN:
                    yield from flush()
                    held.clear()
                    size = 0
            if size:
                yield from flush()

        def merge(table: pa.Table) -> pa.Table:
            columns = {name: table.column(name).to_pylist() for name in ("shared", "lengths", "rests", "llen", "left", "low", "high")}
            numbers = {name: [np.asarray(x.values) for x in table.column(name)] for name in _OWN}
            u8 = lambda b: np.frombuffer(b, np.uint8)
            tree = LoserTree(
                [decoded(u8(a), u8(b), r) for a, b, r in zip(columns["shared"], columns["lengths"], columns["rests"])]
            )
            merged = np.array(list(tree), np.int64).reshape(-1, 2)
            run, lcp = merged[:, 0], merged[:, 1]
            start = np.concatenate([[0], np.cumsum([len(x) for x in columns["llen"]])])
            place = np.empty(len(run), np.int64)  # of each merged suffix in the runs one after another
            by_run = np.argsort(run, kind="stable")
            place[by_run] = np.arange(len(run))
            assert start[-1] == len(run)
            h, s, c, g = (np.concatenate(numbers[name])[place] for name in _OWN)
            low, high = (np.concatenate([u8(x) for x in columns[name]]).astype(np.int64)[place] for name in ("low", "high"))
            rlen = np.concatenate([u8(x) for x in columns["lengths"]]).astype(np.int64)[place]
            llen = np.concatenate([u8(x) for x in columns["llen"]]).astype(np.int64)
            left = np.zeros((len(run), before), np.uint8)
            left[np.arange(before) < llen[:, None]] = np.concatenate([u8(x) for x in columns["left"]])
            back, ahead = repeats.reaches(lambda depth: repeats.classes_at(lcp, depth), rlen, llen[place], left[place], c, window, g, low, high)
            hit = back >= 0
            return pa.table({"h": h[hit], "s": s[hit], "back": back[hit], "ahead": ahead[hit]})

        return common.mapped(texts, runs, _RUN).groupBy("cell").applyInArrow(merge, "h long, s long, back long, ahead long")

    return cells


def repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of struct(a, b): the
    maximal removed runs) of each row of docs(doc_id, text).  window is 255 at most."""
    if window > 255 or k & (k - 1):
        raise ValueError("window must be at most 255 and k a power of two")
    docs = common.named(docs, doc_id="doc_id", text="text")
    marked = repeats.marked(docs, repeats.byte_symbols, window, k, _cells(window, k), **settings)
    run_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def digest(batches):
        for batch in repeats.unpacked(batches):
            data, offsets = tx.utf8(batch.column("text"))
            gone = repeats.covered(batch, offsets)
            digests, removed, runs = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = gone[a:b]
                if own.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    runs.append([{"a": x, "b": y} for x, y in edge.reshape(-1, 2).tolist()])
                    removed.append(int(own.sum()))
                    digests.append(hashlib.sha256(data[a:b][~own].tobytes()).hexdigest())
                else:
                    runs.append([])
                    removed.append(0)
                    digests.append(hashlib.sha256(data[a:b].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array([len(r) for r in runs], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(runs, run_type),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: long, b: long>>"
    return common.mapped(marked, digest, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS x FROM documents),
n AS (SELECT *, octet_length(x) AS n FROM t),
w AS (SELECT rid, i, md5(x[i+1:i+200]) AS g FROM (SELECT rid, x, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
m AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM m),
s AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY rid, run),
p AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS low FROM s),
h AS (SELECT p.rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(CASE WHEN a > low THEN hex(x[low+1:a]) ELSE '' END, '' ORDER BY a) AS head FROM p JOIN n ON n.rid = p.rid GROUP BY p.rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN coalesce(last, 0) < n THEN hex(x[coalesce(last, 0)+1:n]) ELSE '' END)) AS kept_sha256
FROM n LEFT JOIN h USING (rid)
"""
