"""Repeated windows of a corpus, by anchors (anchors.py): the plan that two operators share.

    anchors of every text, written
    -> anchors whose hash occurs twice, written
    -> distinct contexts of each hash, with their number of occurrences
    -> one copy of each context goes to a cell of about `per_cell` contexts, dealt by the prefix
       that its windows must share: the anchor itself, at first
    -> where more than `most` contexts share a prefix, as many as a task may hold, the prefix is extended: the windows
       that start at nearly the same place before the anchor share a longer one, and those of
       each such range of starts are dealt by theirs, an eighth as many starts each time; a prefix that no other context shares goes
    -> contexts that share a prefix as long as the window, more than `most` of them, are dealt to several cells, and one
       of them goes to each of these: so each context meets one that shares its window
    -> in each cell the operator's own method finds how far each context is repeated
    -> spans of each document, joined to its row

Counts are aggregated before they are shuffled and only distinct contexts travel, so a
passage with a third of all rows costs its copies' short anchor rows.  Texts are shuffled
once: Spark reuses that exchange for the contexts and for the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common
from . import text as tx

_ANCHOR = "h long, s long, k1 long, k2 int, first int, last int, n int, left short, right short"
#: A context on its way: hash of its anchor, its own, occurrences, what it is dealt by, the range of
#: starts before the anchor that count, where it stands, and how far it reaches.
_NUMBERS = ("h", "s", "c", "g", "low", "high", "k1", "k2", "first", "left", "right")

#: symbols(data, offsets) -> (symbols, offsets in symbols): bytes, or a hash for each word
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.words(data, offsets)
    return tx.span_hash(data, starts, ends), first


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def _anchored(keyed: DataFrame, symbols: Symbols, window: int, k: int) -> DataFrame:
    def run(batches):
        for batch in common.slices(batches):
            a = anchors.find(*symbols(*tx.utf8(batch.column("text"))), window, k)
            at = pa.array(a.doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a.hash.view(np.int64)),
                    pa.array(a.context.view(np.int64)),
                    batch.column("k1").take(at),
                    batch.column("k2").take(at),
                    pa.array(a.first.astype(np.int32)),
                    pa.array(a.last.astype(np.int32)),
                    pa.array(a.count.astype(np.int32)),
                    pa.array(a.left.astype(np.int16)),
                    pa.array(a.right.astype(np.int16)),
                ],
                ["h", "s", "k1", "k2", "first", "last", "n", "left", "right"],
            )

    return common.mapped(keyed.select("k1", "k2", "text"), run, _ANCHOR)


def unpacked(batches, text: str = "text"):
    """Slices of batches whose column `row` is replaced by its fields; the other columns follow
    and are known by their place, as a field may have the same name."""
    for batch in batches:
        at = batch.schema.get_field_index("row")
        row = batch.column(at)
        fields = [f.name for f in row.type]
        others = [n for n in batch.schema.names if n != "row"]
        flat = pa.RecordBatch.from_arrays([*row.flatten(), *(batch.column(n) for n in others)], [*fields, *others])
        yield from common.slices(iter([flat]), text)


def picked(batch: pa.RecordBatch, symbols: Symbols, text: str):
    """For a batch of rows and their picks, with picks an array of structs of _NUMBERS:
    (symbols, position of each pick's anchor, arrays of the picks by name)."""
    values, offsets = symbols(*tx.utf8(batch.column(batch.schema.names.index(text))))
    picks = batch.column(batch.num_columns - 1)
    at = picks.offsets.to_numpy()
    flat = picks.values.slice(at[0], at[-1] - at[0])
    columns = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in _NUMBERS}
    where = np.repeat(offsets[:-1], np.diff(at)) + columns["first"]
    return values, where, columns


_PREFIX = "f1 long, f2 long, h long, s long, c long, low short, high short, k1 long, k2 int, first int, left short, right short"


def _prefixes(texts: DataFrame, symbols: Symbols, window: int, width: int, text: str) -> DataFrame:
    """For each pick and each range [low, high] of at most `width` of its starts: two hashes of
    what all windows that start so many symbols before the anchor share, where the context has it."""

    def run(batches):
        for batch in unpacked(batches, text):
            values, where, p = picked(batch, symbols, text)
            other = values ^ np.uint8(0xA5) if values.dtype == np.uint8 else tx.mix64(values + np.uint64(1))
            order = np.argsort(where, kind="stable")
            for lo in range(0, len(order), 20_000):
                some = order[lo : lo + 20_000]
                many = -(-(p["high"][some].astype(np.int64) - p["low"][some] + 1) // width)
                row = np.repeat(some, many)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                low = p["low"][row].astype(np.int64) + nth * width
                high = np.minimum(low + width - 1, p["high"][row])
                there = (p["left"][row] >= low) & (p["right"][row] >= window - high)
                row, low, high = row[there], low[there], high[there]
                start, end = where[row] - low, where[row] + window - high
                f1, f2 = (np.empty(len(row), np.uint64) for _ in range(2))
                for size in np.unique(end - start).tolist():  # equal lengths ascend together
                    own = np.flatnonzero(end - start == size)
                    own = own[np.argsort(start[own], kind="stable")]
                    f1[own] = anchors._overlapping(values, start[own], end[own])
                    f2[own] = anchors._overlapping(other, start[own], end[own])
                numbers = [pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), *(pa.array(p[x][row]) for x in ("k1", "k2", "first", "left", "right"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *(pa.array(p[x][row]) for x in ("h", "s", "c")), *numbers],
                    ["f1", "f2", "h", "s", "c", "low", "high", "k1", "k2", "first", "left", "right"],
                )

    return common.mapped(texts, run, _PREFIX)


def marked(docs: DataFrame, symbols: Symbols, window: int, k: int, cells: Callable[[DataFrame, int, str], DataFrame], per_cell: int = 4_000, most: int = 50_000) -> DataFrame:
    """Each row of docs (with a column text) as `row`, and `spans`: an array of
    struct(a, b), symbol positions [a, b) that repeated windows cover (null: none).

    cells(texts, n, text) gets (row, picks) and the name of row's text, and gives (h, s, back, ahead): how far windows that
    are repeated reach before and after the anchors of this hash and context.
    """
    spark = common.narrow(docs).sparkSession
    doc_id, text = common.column(docs, "doc_id"), common.column(docs, "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keys = [F.col("row")[c] for c in ([doc_id, text] if doc_id in docs.columns else [text])]
    rows = rows.select(F.xxhash64(*keys).alias("k1"), F.hash(*reversed(keys)).alias("k2"), "row")
    found = common.written(_anchored(rows.select("k1", "k2", F.col("row")[text].alias("text")), symbols, window, k))
    # joins with written tables can be split where a hash is hot; an aggregation below a join can't
    twice = common.written(found.groupBy("h").agg(F.sum("n").alias("c")).where("c > 1").select("h"))
    again = common.written(found.join(twice.hint("merge"), "h", "left_semi"))
    common.dropped(found, twice)
    contexts = again.groupBy("h", "s", "left", "right").agg(F.sum("n").alias("c"), F.min(F.struct("k1", "k2", "first")).alias("at"))
    contexts = common.written(contexts.where(f"left + right >= {window}").select("h", "s", "c", "left", "right", "at.*"))
    several = common.written(contexts.groupBy("h").agg(F.count("*").alias("d"), F.sum("c").alias("all")).where("all > 1").select("h", "d"))
    small = lambda n: F.lit(n).cast("short")
    open_ = contexts.join(several.hint("merge"), "h").withColumns({"g": F.col("h"), "low": small(0), "high": small(window - k)})

    # both uses of this exchange take the whole row, so that they stay one exchange
    texts = rows.repartition(common.partitions(spark), "k1", "k2")

    def picks(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("k1", "k2").agg(F.collect_list(F.struct(*_NUMBERS)).alias("picks"))
        return texts.join(wanted.hint("merge"), ["k1", "k2"]).select("row", "picks")

    reach = None
    width = window - k + 1
    used = [contexts, several]
    while True:
        open_ = common.written(open_)
        common.dropped(*used)
        fit, width = open_.where(F.col("d") <= most), max(1, width // 8)
        n = fit.count()
        if n:
            own = cells(picks(fit), -(-n // per_cell), text)
            reach = own if reach is None else reach.union(own)
        hot = open_.where(F.col("d") > most)
        if hot.isEmpty():
            break
        longer = common.written(_prefixes(picks(hot), symbols, window, width, text))
        same = ["h", "low", "f1", "f2"]
        shared = common.written(longer.groupBy(*same).agg(F.count("*").alias("d"), F.sum("c").alias("all")).where("all > 1").drop("all"))
        open_, used = longer.join(shared.hint("merge"), same), [longer, shared]
        if width == 1:
            n, own = _of_whole_windows(open_, same, most)
            used.append(own)
            if n:
                found_ = cells(picks(own), -(-n // per_cell), text)
                reach = found_ if reach is None else reach.union(found_)
            break
        open_ = open_.withColumn("g", F.xxhash64("h", "low", "f1")).drop("f1", "f2")
    if reach is None:
        return texts.select("row", F.lit(None).cast("array<struct<a: long, b: long>>").alias("spans"))
    spans = (
        again.join(reach.hint("merge"), ["h", "s"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct((F.col("first") - F.col("back")).alias("a"), (F.col("last") + F.col("ahead")).alias("b"))).alias("spans"))
    )
    return texts.join(spans.hint("merge"), ["k1", "k2"], "left").select("row", "spans")


def _of_whole_windows(shared: DataFrame, same: list[str], most: int) -> tuple[int, DataFrame]:
    """Contexts that share a whole window with others of the same `same`: (their number, those dealt by groups of up to about
    `most`, with the least one in each group)."""
    parts = F.ceil(F.col("d") / most).cast("int")
    others = [c for c in shared.columns if c not in (*same, "d")]
    one = shared.groupBy(*same, "d").agg(F.min(F.struct("s", *[c for c in others if c != "s"])).alias("one"))
    everywhere = one.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*same, "d", "one.*", "part")
    dealt = shared.withColumn("part", F.pmod(F.xxhash64("s"), parts).cast("int")).unionByName(everywhere)
    dealt = common.written(dealt.withColumn("g", F.xxhash64("h", "low", "f1", "part")).drop("f1", "f2", "part"))
    return dealt.count(), dealt


def covered(batch: pa.RecordBatch, offsets: np.ndarray) -> np.ndarray:
    """Which symbols the batch's spans cover, for documents at these offsets in symbols."""
    spans = batch.column(batch.num_columns - 1)
    n = int(offsets[-1])
    over = np.zeros(n + 1, np.int32)
    at = spans.offsets.to_numpy()
    flat = spans.values.slice(at[0], at[-1] - at[0])
    base = np.repeat(offsets[:-1], np.diff(at))
    np.add.at(over, base + flat.field("a").to_numpy(zero_copy_only=False), 1)
    np.add.at(over, base + flat.field("b").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(over[:-1]) > 0


def classes_at(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Of sorted strings with these common prefixes: the class of each at this depth."""
    return np.cumsum(lcp < depth)


def reaches(classes: Callable[[int], np.ndarray], right, left, left_symbols, count, window: int, group, low, high) -> tuple[np.ndarray, np.ndarray]:
    """(back, ahead) of contexts sorted by what follows their anchor; back is -1 if no window
    is repeated.  classes(depth): a number below 2 n for each context, the same for those that agree so far
    after the anchor (contexts with less after it may have any); right, left: lengths;
    left_symbols[i, j]: symbol j + 1 places before the anchor; count: occurrences; group: only
    contexts of one group are compared; low, high: which starts before the anchor count.

    The window that starts o before the anchor is a node at depth window - o of the tree of
    the right sides, met with a class of the left sides that agree over o symbols.
    """
    n = len(right)
    back, ahead = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    before = np.unique(group, return_inverse=True)[1]
    for o in range(int(np.minimum(left, high).max(initial=-1)) + 1):
        if o:
            cells = before * (1 << 32) + left_symbols[:, o - 1].astype(np.int64)
            before = np.unique(cells, return_inverse=True)[1]
        fit = np.flatnonzero((left >= o) & (right >= window - o) & (low <= o) & (o <= high))
        if not len(fit):
            continue
        after = classes(window - o)
        keys = before[fit] * (2 * n + 1) + after[fit]
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:].copy()
        twice = np.zeros(len(k), bool)
        twice[order] = same
        hit = fit[twice | (count[fit] > 1)]
        back[hit] = o
        ahead[hit] = np.maximum(ahead[hit], window - o)
    return back, ahead
