"""Periodic runs of words after Kolpakov and Kucherov.

A run is a stretch of words with least period q and at least 2 q words that no neighbour extends.
Each document is searched on its own, in time linear in its words:

1. A suffix automaton over the words keeps, for each state, where its words end first.  Walking
   it from a place gives the longest factor that also starts earlier; factor by factor this is
   the Lempel-Ziv factorisation, with an earlier occurrence of each.
2. A run that touches a boundary of factors is found at it by Main's algorithm: for every
   period, how far words one period apart agree to both sides of the boundary (Z functions over
   the factor and a stretch before it).  `_crossing` says why that stretch is long enough.
3. A run that lies, with both its neighbours, inside a factor is a copy of one in the factor's
   earlier occurrence, and is taken from there.

A word that occurs once in a document is in no run, as each word of a run has its like one
period away.  Such words part the document, and stretches are searched one by one; a stretch
shorter than the least run has none.

Null texts have no words.  A null id hashes as an empty one and stays null.  Every row gives a
row; further columns of the input don't matter.  Memory is a few hundred bytes a word of one
document at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the shortest run that counts.
LEAST = 12

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def factors(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, distance to an earlier occurrence; 0 for a new word) of each Lempel-Ziv factor."""
    # A state's first move stands in two lists, as most states have no other.
    link, size, first, symbol, target = [-1], [0], [-1], [-1], [-1]
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(ids):
        made = len(size)
        link.append(0)
        size.append(i + 1)
        first.append(i)
        symbol.append(-1)
        target.append(-1)
        p, met = last, -1
        while p >= 0:
            if symbol[p] == c:
                met = target[p]
                break
            if symbol[p] < 0:
                symbol[p], target[p] = c, made
            else:
                moves = more.get(p)
                if moves is None:
                    more[p] = {c: made}
                elif c in moves:
                    met = moves[c]
                    break
                else:
                    moves[c] = made
            p = link[p]
        if met >= 0:
            if size[p] + 1 == size[met]:
                link[made] = met
            else:
                copy = len(size)
                link.append(link[met])
                size.append(size[p] + 1)
                first.append(first[met])
                symbol.append(symbol[met])
                target.append(target[met])
                if met in more:
                    more[copy] = dict(more[met])
                link[met] = link[made] = copy
                while p >= 0:
                    if symbol[p] == c:
                        if target[p] != met:
                            break
                        target[p] = copy
                    else:
                        moves = more.get(p)
                        if moves is None or moves.get(c) != met:
                            break
                        moves[c] = copy
                    p = link[p]
        last = made

    out, n, at = [], len(ids), 0
    while at < n:
        state, to = 0, at
        while to < n:
            c = ids[to]
            step = target[state] if symbol[state] == c else more[state][c]
            if first[step] >= to:
                break
            state, to = step, to + 1
        if to == at:
            out.append((at, at + 1, 0))
        else:
            out.append((at, to, to - 1 - first[state]))
        at = out[-1][1]
    return out


def _agreement(s: list[int]) -> list[int]:
    """For each place of s, how many of its first members follow there (the Z function)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def _crossing(ids: list[int], before: int, at: int, end: int, least: int, found: dict[int, dict[int, int]]) -> None:
    """Adds the runs that touch the boundary `at` of the factors [before, at) and [at, end).

    Take a run of period p that ends after `at`, but not after `end` (a later boundary has the others).
    If it began p or more words before `before`, the words from `before` to its end would also occur p
    earlier, and the factor that starts there would be longer.  So it begins less than p before
    `before`, which makes p less than both factors together, and it reaches back from `at` by
    less than the second factor and twice the first.  One that ends at `at` without touching
    `before` lies in the first factor.
    """
    one, two = at - before, end - at
    if 2 * (one + two) - 1 < least:
        return
    low = max(0, at - two - 2 * one)
    left, right = ids[low:at], ids[at:end]
    back = left[::-1]
    # how far the words that end at a place, and at the boundary, agree backwards; and forwards
    behind = _agreement([*back, -1, *right[::-1], *back])
    ahead = _agreement([*right, -1, *left, *right])
    n, m, k = len(ids), len(left), len(right)

    def keep(start: int, stop: int, period: int) -> None:
        if stop - start < least or stop - start < 2 * period:
            return
        if start and ids[start - 1] == ids[start - 1 + period] or stop < n and ids[stop] == ids[stop - period]:
            return
        ends = found.setdefault(start, {})
        ends[stop] = min(period, ends.get(stop, period))

    for p in range(1, min(one + two, k + 1)):  # a period to the right of the boundary
        forward = ahead[p] if p < k else 0
        keep(at - behind[m + 1 + k - p], at + p + forward, p)
    for p in range(1, min(one + two, m + 1)):  # a period to the left
        backward = behind[p] if p < m else 0
        keep(at - p - backward, at + ahead[k + 1 + m - p], p)


def runs_of(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` members, by start and period."""
    found: dict[int, dict[int, int]] = {}
    before = 0
    for start, end, distance in factors(ids):
        if start:
            _crossing(ids, before, start, end, least, found)
        if distance and end - start >= least + 2:
            for x in range(start + 1, end - least):  # in this order: an occurrence may reach into its own factor
                for stop, period in list(found.get(x - distance, {}).items()):
                    if stop + distance < end:
                        found.setdefault(x, {})[stop + distance] = period
        before = start
    if ids:
        _crossing(ids, before, len(ids), len(ids), least, found)
    return sorted(((start, stop - start, p) for start, ends in found.items() for stop, p in ends.items()), key=lambda r: (r[0], r[2]))


def runs_of_words(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """runs_of() for the stretches between words that occur once."""
    counts, out, at, n = Counter(words), [], 0, len(words)
    single = [i for i, w in enumerate(words) if counts[w] == 1]
    for stop in [*single, n]:
        if stop - at >= least:
            codes: dict[str, int] = {}
            ids = [codes.setdefault(w, len(codes)) for w in words[at:stop]]
            out += [(at + start, length, period) for start, length, period in runs_of(ids, least)]
        at = stop + 1
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, joined by one space."""
    step = [0] * (len(words) + 1)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept, depth = [], 0
    for word, s in zip(words, step):
        depth += s
        if not depth:
            kept.append(word)
    return " ".join(kept)


def periodic(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, altered: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start and period, and its text with each
    run cut to its first period.  `altered` gives the words to search in place of a document's own."""

    def run(batches):
        for batch in batches:
            for part in common.slices(iter([batch])):
                n, found, texts = [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = WORD.findall(t or "")
                    words = altered(i, words) if altered else words
                    runs = runs_of_words(words, least)
                    n.append(len(words))
                    found.append([{"start": s, "length": k, "period": p} for s, k, p in runs])
                    texts.append(collapsed(words, runs))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    named = common.named(docs, doc_id=doc_id, text=text)
    return common.mapped(named.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _SCHEMA)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of op12's documents: one in ten repeats a stretch to its end."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(spark.read.parquet(f"{sf_dir}/documents.parquet"), altered=planted)
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    # the longest; ties to the least start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
