"""Document fingerprints by locally consistent parsing.

A text is parsed level by level into phrases, until one is left:

* a stretch of one symbol repeated k times becomes one symbol, named by the symbol and k, so
  that neighbours differ;
* deterministic coin tossing labels each symbol by the lowest bit in which it differs from its
  left neighbour and by that bit.  64-bit names take four rounds to at most six labels; labels
  5, 4 and 3 then give way to the least one that no neighbour has;
* a phrase begins at each local maximum of the labels, every two to four symbols, and is
  named by a 64-bit hash of its symbols.

A label depends on a few neighbours only, so equal substrings of any two texts are parsed alike
but for some phrases at their ends, wherever they stand.  Names are hashes of what they stand for
and need no table that documents share.  All texts of a slice are parsed together in arrays;
no text's parse depends on the others.

A fingerprint holds the last phrase's name (the whole text's) and a sketch: the SKETCH least of the
32-bit hashes of its distinct phrases from level LOWEST up (of some six characters and more) and
of the whole.  `likeness` of two fingerprints estimates the Jaccard similarity of their phrase sets,
exactly where neither sketch is full, else with a standard error of at most 0.0625.

Null texts count as empty; an empty text has no phrase, and is like an empty text alone.  Every
row gives a row; further columns of the input don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .text import mix64

#: Hashes of a sketch at most, and the first level whose phrases it takes.
SKETCH = 64
LOWEST = 2
#: Code points that are parsed together (one text may have more).
PARSED = 1 << 17

_U = np.uint64
_RUN, _NEXT, _LEVEL = _U(0x9FB21C651E98DF25), _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)


#: The place of a lone bit b: b * _BITS takes another value in its top six bits for each.
_BITS = 0x03F79D71B4CB0A89
_PLACE = np.zeros(64, np.uint8)
_PLACE[[(_BITS << i & (1 << 64) - 1) >> 58 for i in range(64)]] = np.arange(64)


def _tossed(before: int, x: int) -> int:
    """Twice the place of the lowest bit in which both differ, and that bit of x."""
    low = (before ^ x) & -(before ^ x)
    return 2 * (low.bit_length() - 1) + bool(x & low)


#: The same for labels below 128, at 128 * before + x.
_TOSSED = np.array([_tossed(b, x) if b != x else 0 for b in range(128) for x in range(128)], np.uint8)


def labels(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A label of 0, 1 or 2 for each symbol, other than its neighbours'; symbols differ from their neighbours
    in their text, whose first and last are marked."""
    heads = np.flatnonzero(first)
    low = np.empty_like(symbols)
    np.bitwise_xor(symbols[1:], symbols[:-1], out=low[1:])
    low[heads] = 1  # a first symbol's label is its bit 0
    low &= ~low + _U(1)
    x = _PLACE[(low * _U(_BITS)) >> _U(58)]
    x <<= 1
    x |= (symbols & low) != 0
    for _ in range(3):
        pairs = x.astype(np.int16)
        pairs[1:] |= pairs[:-1] << 7
        pairs[heads] = x[heads].astype(np.int16) | (x[heads] ^ 1).astype(np.int16) << 7
        x = _TOSSED[pairs]
    x = x.astype(np.int8)
    for high in (5, 4, 3):
        at = np.flatnonzero(x == high)
        left = np.where(first[at], -1, x[at - 1])
        right = np.where(last[at], -1, x[np.minimum(at + 1, len(x) - 1)])
        none = (left != 0) & (right != 0)
        x[at] = np.where(none, 0, np.where((left != 1) & (right != 1), 1, 2))
    return x


def _level(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: the names of the phrases of all texts (none empty), and how many each has."""
    ends = np.cumsum(lengths)
    first = np.zeros(len(symbols), bool)
    first[ends - lengths] = True
    # stretches of one symbol
    begins = first.copy()
    begins[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(begins)
    times = np.diff(at, append=len(symbols))
    symbols, first = symbols[at], first[at]
    many = times > 1
    symbols[many] = mix64(symbols[many] * _RUN + times[many].astype(_U))
    # phrases
    last = np.empty_like(first)
    last[:-1], last[-1] = first[1:], True
    x = labels(symbols, first, last)
    begins = first.copy()
    begins[1:-1] |= (x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & ~first[1:-1] & ~last[1:-1] & ~first[:-2]
    at = np.flatnonzero(begins)
    size = np.diff(at, append=len(symbols))
    names = mix64(symbols[at] + _LEVEL)
    for j in range(1, int(size.max())):
        some = np.flatnonzero(size > j)
        names[some] = mix64(names[some] * _NEXT + symbols[at[some] + j])
    return names, np.add.reduceat(np.ones(len(at), np.int64), np.flatnonzero(first[at]))


def parsed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of each whole text, 0 if empty; text and name of every phrase from level LOWEST up)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    roots = np.zeros(len(texts), _U)
    owners, names = [], []
    live = np.flatnonzero(lengths)
    lengths, symbols, level = lengths[live], mix64(points.astype(_U) + _LEVEL), 0
    while len(live):
        symbols, lengths = _level(symbols, lengths)
        level += 1
        done = lengths == 1
        single = np.repeat(done, lengths)
        roots[live[done]] = symbols[single]
        keep = np.full(len(symbols), True) if level >= LOWEST else single
        owners.append(np.repeat(live, lengths)[keep])
        names.append(symbols[keep])
        symbols, live, lengths = symbols[~single], live[~done], lengths[~done]
    none = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    return roots, np.concatenate(owners or none[0]), np.concatenate(names or none[1])


def sketches(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(name, sketch in ascending order) of each text."""
    roots, owners, names = parsed(texts)
    keys = np.sort((owners.astype(_U) << _U(32)) | (mix64(names) >> _U(32)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=_U) << _U(32))
    low = keys.astype(np.uint32)
    return [(int(roots[i]), low[bounds[i] : min(bounds[i + 1], bounds[i] + SKETCH)]) for i in range(len(texts))]


def written_out(sketch: tuple[int, np.ndarray]) -> str:
    """A fingerprint: the name and the sketch in hexadecimal."""
    return f"{sketch[0]:016x}-{sketch[1].astype('>u4').tobytes().hex()}"


def read_in(fingerprint: str) -> tuple[int, np.ndarray]:
    name, _, rest = fingerprint.partition("-")
    return int(name, 16), np.frombuffer(bytes.fromhex(rest), ">u4").astype(np.uint32)


def sketch_likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of the least members of both sets together that are in both."""
    if a[0] == b[0]:
        return 1.0
    both = np.sort(np.concatenate([a[1], b[1]]))
    twice = np.flatnonzero(both[1:] == both[:-1])
    most = min(SKETCH, len(both) - len(twice))
    # a member in both stands at place p of `both` after p - (pairs before it) distinct ones
    return float((twice - np.arange(len(twice)) < most).sum()) / most


def likeness(a: str, b: str) -> float:
    """How much alike (0 to 1) the texts of two fingerprints are, by the fingerprints alone."""
    return sketch_likeness(read_in(a), read_in(b))


def _blocks(texts: list[str]):
    """Runs of texts of PARSED code points or one text."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= PARSED:
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def all_sketches(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    return [s for block in _blocks(texts) for s in sketches(block)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document."""

    def run(batches):
        for batch in batches:
            for part in common.slices(iter([batch])):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [written_out(s) for s in all_sketches(texts)]
                columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint"])

    named = common.named(docs, doc_id=doc_id, text=text)
    return common.mapped(named.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: kind: `row` has a result; a partition's `head` and `tail` wait for the next partition's and the one before.
_PASSED = f"kind string, part int, text string, {_RESULT}"


def _results(ids: list, texts: list[str], marks: list, following: list[str], following_marks: list) -> list[tuple]:
    """Rows of _RESULT."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    out = []
    for i, t, mark, c, change, after in zip(ids, texts, marks, changed, all_sketches(changed), following_marks):
        out.append((i, len(t), common.sha256(c.encode()), written_out(mark), written_out(change), sketch_likeness(mark, change), sketch_likeness(mark, after)))
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [field.split(" ") for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def _walk(batches):
    """Through one range of the ordered documents: a result for each that has a next one here."""
    number = TaskContext.get().partitionId()
    held: tuple | None = None  # the last row so far, with its sketch
    for batch in batches:
        for part in common.slices(iter([batch])):
            ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            marks = all_sketches(texts)
            out = []
            if held is None:
                out.append(("head", number, texts[0], None, None, None, written_out(marks[0]), None, None, None))
            else:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], [held[2], *marks]
            out += [("row", number, None, *r) for r in _results(ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:])]
            held = ids[-1], texts[-1], marks[-1]
            if out:
                yield _batch(out, _PASSED)
    if held is not None:
        yield _batch([("tail", number, held[1], held[0], None, None, written_out(held[2]), None, None, None)], _PASSED)


def _join(batches):
    """Results of the last rows of ranges, with the first row of the next range beside them."""
    for batch in batches:
        for part in common.slices(iter([batch])):
            ids, texts, marks, following, after = (part.column(i).to_pylist() for i in range(5))
            if ids:
                yield _batch(_results(ids, texts, list(map(read_in, marks)), following, list(map(read_in, after))), _RESULT)


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside the next one in descending order of ids (after the last, the first): its fingerprint,
    that of its edited text, and the likeness to the edited and to the next text.

    Documents are ranged by id; rows of one id follow each other by hashes of their texts, and rows alike in both
    by place, so that any number of repeated rows spreads over ranges.  Null ids come last.  Each range is walked
    in order, and its result written once with its first and last row, as another evaluation could draw other
    bounds.  The last rows then meet the first ones of the next ranges: two rows for each partition.
    """
    named = common.named(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("_one"), F.asc("_two"), F.asc("_place")]
    keyed = named.withColumns({"_one": F.xxhash64("text"), "_two": F.crc32("text"), "_place": F.xxhash64(F.monotonically_increasing_id())})
    ranged = keyed.repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = common.written(common.mapped(ranged, _walk, _PASSED))
    # as many numbers as partitions, whatever the documents
    numbers = sorted(r.part for r in walked.where("kind = 'head'").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "part int, after int")
    tails = walked.where("kind = 'tail'").join(F.broadcast(after), "part").select("doc_id", "text", "fingerprint", "after")
    heads = walked.where("kind = 'head'").select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("following_mark"))
    seams = tails.join(heads, "after").select("doc_id", "text", "fingerprint", "following", "following_mark")
    return walked.where("kind = 'row'").select(*[f.split(" ")[0] for f in _RESULT.split(", ")]).unionByName(common.mapped(seams, _join, _RESULT))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
