"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes that can matter start at anchors (anchors.py).  They are split by prefixes of
variable length: first by the hash of the anchor's eight words; prefixes go together into
cells of bounded size, and one with more distinct suffixes than a cell may hold is extended
(repeats.py).  A cell's suffixes make a suffix tree; its
internal nodes at depth d are the word sequences of length d that repeat.  The highest nodes as deep as
a window less o words tell which suffixes agree that far, and those of one node that also agree over the
o words before the anchor repeat the window that starts there.  A suffix that
occurs several times with all its context is one leaf with its count.

Words are maximal runs outside 0x20 and 0x09-0x0D.  A removed word is one that a window of
`window` words covers whose sequence starts anywhere else too.  Null and empty texts have no
words.  Every row gives a row; repeated rows repeat each other; null ids are kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats
from . import text as tx

WINDOW = 35
ANCHOR = 8


@dataclass(frozen=True)
class SuffixTree:
    """A suffix tree as the intervals of its internal nodes over the sorted suffixes."""

    order: np.ndarray  # suffixes, sorted
    nodes: np.ndarray  # (depth, from, to, the parent's depth) of each: order[from:to] share depth symbols

    @staticmethod
    def build(suffixes: np.ndarray, lengths: np.ndarray) -> SuffixTree:
        """Of rows of symbols, padded beyond their lengths."""
        n, width = suffixes.shape
        padded = np.where(np.arange(width) < lengths[:, None], suffixes.astype(np.int64) + 1, 0)
        order = np.lexsort(padded.T[::-1]) if width else np.arange(n)
        rows = padded[order]
        lcp = np.zeros(n, np.int64)
        if n > 1:
            differ = rows[1:] != rows[:-1]
            common_ = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            lcp[1:] = np.minimum(common_, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
        nodes, stack, prefixes = [], [], [*lcp[1:].tolist(), 0]  # stack: (depth, from)
        for i, d in enumerate(prefixes, 1):
            begin = i - 1
            while stack and stack[-1][0] > d:
                depth, begin = stack.pop()
                nodes.append((depth, begin, i, max(d, stack[-1][0] if stack else 0)))
            if d and (not stack or stack[-1][0] < d):
                stack.append((d, begin))
        return SuffixTree(order, np.array(nodes, np.int64).reshape(-1, 4))

    def deep(self, depth: int) -> np.ndarray:
        """(from, to) of the highest nodes at this depth or deeper, in order: maximal sets of suffixes that share it."""
        high = self.nodes[(self.nodes[:, 0] >= depth) & (self.nodes[:, 3] < depth)]
        return high[np.argsort(high[:, 1]), 1:3]

    def under(self, depth: int) -> np.ndarray:
        """For each sorted suffix: the number of its node in deep(depth), or one of its own."""
        own = np.arange(len(self.order)) + len(self.order)
        spans = self.deep(depth)
        size = spans[:, 1] - spans[:, 0]
        own[np.repeat(spans[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(np.arange(len(spans)), size)
        return own


_OWN = ("h", "s", "c", "g")
_CELL = "cell int, h array<long>, s array<long>, c array<long>, g array<long>, low binary, high binary, llen binary, rlen binary, left binary, right binary"


def _cells(window: int, k: int):
    before = window - k

    def cells(texts: DataFrame, n: int, text: str) -> DataFrame:
        def gather(batches):
            for batch in repeats.unpacked(batches, text):
                values, where, p = repeats.picked(batch, repeats.word_symbols, text)
                codes = values if len(values) else np.zeros(1, np.uint64)
                cell = tx.mix64(p["g"].view(np.uint64)) % np.uint64(n)
                at = where[:, None]
                right = codes[np.minimum(at + np.arange(window), len(codes) - 1)]
                left = codes[np.maximum(at - 1 - np.arange(before), 0)]
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "cell": pa.array([int(c)], pa.int32()),
                            **{x: pa.array([p[x][own]], pa.list_(pa.int64())) for x in _OWN},
                            **{x: [p[x][own].astype(np.uint8).tobytes()] for x in ("low", "high")},
                            "llen": [p["left"][own].astype(np.uint8).tobytes()],
                            "rlen": [p["right"][own].astype(np.uint8).tobytes()],
                            "left": [left[own].tobytes()],
                            "right": [right[own].tobytes()],
                        }
                    )

        def solve(table: pa.Table) -> pa.Table:
            h, s, c, g = (np.concatenate([np.asarray(x.values) for x in table.column(name).combine_chunks()]) for name in _OWN)
            raw = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
            llen, rlen, low, high = (raw(x, np.uint8).astype(np.int64) for x in ("llen", "rlen", "low", "high"))
            # words are compared by all 64 bits of their hashes; ranks stand for them
            rank = np.unique(np.concatenate([raw("left", np.uint64), raw("right", np.uint64)]), return_inverse=True)[1]
            left, right = rank[: len(h) * before].reshape(-1, before), rank[len(h) * before :].reshape(-1, window)
            tree = SuffixTree.build(right, rlen)
            order = tree.order
            back, ahead = repeats.reaches(tree.under, rlen[order], llen[order], left[order], c[order], window, g[order], low[order], high[order])
            hit = back >= 0
            return pa.table({"h": h[order[hit]], "s": s[order[hit]], "back": back[hit], "ahead": ahead[hit]})

        return common.mapped(texts, gather, _CELL).groupBy("cell").applyInArrow(solve, "h long, s long, back long, ahead long")

    return cells


def _marked(docs: DataFrame, window: int, k: int, settings: dict) -> DataFrame:
    return repeats.marked(docs, repeats.word_symbols, window, k, _cells(window, k), **settings)


def repeated_words(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, **settings) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id, text)."""
    docs = common.named(docs, doc_id="doc_id", text="text")

    def digest(batches):
        for batch in repeats.unpacked(batches):
            data, offsets = tx.utf8(batch.column("text"))
            starts, ends, first = tx.words(data, offsets)
            gone = repeats.covered(batch, first)
            raw = data.tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])
            removed = removed[first[1:]] - removed[first[:-1]]
            digests = []
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                keep = np.flatnonzero(~gone[a:b]) + a
                if removed[i]:
                    own = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])
                else:
                    own = b" ".join(raw[offsets[i] : offsets[i + 1]].split())
                digests.append(hashlib.sha256(own).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(removed), pa.array(digests)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return common.mapped(_marked(docs, window, k, settings), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, **settings) -> DataFrame:
    """docs with the repeated words cut out of `text`, each with the white space before it
    (after it where a text begins with it); what remains, and every other column, is as it was."""
    schema, own_text = docs.schema, common.column(docs, "text")

    def cut(batches):
        for batch in repeats.unpacked(batches, own_text):
            rows = batch.select(list(range(batch.num_columns - 1)))
            at = rows.schema.get_field_index(own_text)
            texts = rows.column(at)
            data, offsets = tx.utf8(texts)
            starts, ends, first = tx.words(data, offsets)
            gone = repeats.covered(batch, first)
            if gone.any():
                keep = np.ones(len(data), bool)
                previous = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                own = tx.owner(first)
                low = np.maximum(previous, offsets[own])
                over = np.zeros(len(data) + 1, np.int32)
                np.add.at(over, low[gone], 1)
                np.add.at(over, ends[gone], -1)
                keep = np.cumsum(over[:-1]) == 0
                lead = np.flatnonzero(gone & (low == offsets[own]))
                for w in lead:  # a text that began with a removed word begins with its next kept one
                    stop = offsets[own[w] + 1]
                    x = ends[w]
                    while x < stop and tx._SPACE[data[x]]:
                        keep[x] = False
                        x += 1
                hit = np.unique(own[gone])
                values = texts.to_pylist()
                for i in hit.tolist():
                    part = slice(int(offsets[i]), int(offsets[i + 1]))
                    values[i] = data[part][keep[part]].tobytes().decode()
                rows = rows.set_column(at, rows.schema.field(at), pa.array(values, texts.type))
            yield rows

    return common.mapped(_marked(docs, window, k, settings), cut, schema)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, i, md5(array_to_string(w[i:i+34], ' ')) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM r, (SELECT unnest(range(0, 35)) AS k)),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
k AS (SELECT x.rid, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x
  LEFT JOIN gone ON gone.rid = x.rid AND gone.i = x.i WHERE gone.rid IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (rid)
"""
