"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one feature.  On a sample of whole documents from all
partitions (about `sample_rows`, drawn row by row, for the order only), less
those that the base rule rejects, each rule's time and its rejections are measured, the time
as the median of `REPEATS`; the rules then run by falling rejections per cost, and a rule
computes its feature only for documents that no earlier rule rejected.  The verdict is the
conjunction of all rules, so it doesn't depend on the order or the sample.

A feature is computed once for a document, whoever asks first.  `passing` computes what the
cascade needs and nothing else.  `quality` returns the five base features of every document,
so these are there before the cascade, their rules cost next to nothing, and the sample
measures them so.

The base rule runs first.  Null and empty texts have no words and fail it; null ids are kept
as they are; every row of the input gives one row.  Column names match in any case.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import text as tx

SAMPLE_ROWS, REPEATS = 400, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _per(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of mask are set in each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Texts:
    """Some documents' bytes and words, and their features: each computed when it is first read,
    and kept for documents picked out by only()."""

    FEATURES = ("n_symbols", "code_points", "line_counts", "n_repeats")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words=None):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = tx.words(data, offsets) if words is None else words
        self.n_words = np.diff(self.first)

    def only(self, docs: np.ndarray, features: bool = True) -> Texts:
        """These documents alone (ascending numbers); with the features that are known, if asked."""
        parts = [self.data[a:b] for a, b in zip(self.offsets[docs].tolist(), self.offsets[docs + 1].tolist())]
        offsets = np.concatenate([[0], np.cumsum(np.diff(self.offsets)[docs])])
        first = np.concatenate([[0], np.cumsum(self.n_words[docs])])
        word = np.arange(first[-1]) + np.repeat(self.first[docs] - first[:-1], self.n_words[docs])
        back = np.repeat(self.offsets[docs] - offsets[:-1], self.n_words[docs])
        data = np.concatenate(parts) if parts else self.data[:0]
        out = Texts(data, offsets, (self.starts[word] - back, self.ends[word] - back, first))
        if features:
            for name in self.FEATURES:
                if name in self.__dict__:
                    known = self.__dict__[name]
                    out.__dict__[name] = tuple(x[docs] for x in known) if isinstance(known, tuple) else known[docs]
        return out

    def hashes(self) -> np.ndarray:
        return tx.span_hash(self.data, self.starts, self.ends)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _per(_SYMBOL[self.data], self.offsets)

    @cached_property
    def code_points(self) -> np.ndarray:
        return _per(_HEAD[self.data], self.offsets) - _per(tx._SPACE[self.data], self.offsets)

    @cached_property
    def line_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those equal to an earlier line)"""
        return duplicate_lines(self)

    @cached_property
    def n_repeats(self) -> np.ndarray:
        return repeated_words(self)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, document) of all newline-split lines that hold a word."""
        breaks = np.flatnonzero(self.data == 10)
        marks = np.sort(np.concatenate([breaks + 1, self.offsets[:-1]]))
        ends = np.sort(np.concatenate([breaks, self.offsets[1:]]))
        doc = np.searchsorted(self.offsets, marks, "right") - 1
        word = np.searchsorted(self.starts, marks)
        full = np.zeros(len(marks), bool)
        inside = word < len(self.starts)
        full[inside] = self.starts[word[inside]] < ends[inside]
        return marks[full], ends[full], doc[full]


def duplicate_lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line) of each document."""
    starts, ends, doc = t.lines()
    n = len(t.n_words)
    total = np.bincount(doc, minlength=n)
    if not len(starts):
        return total, total.copy()
    keys = tx.mix64(tx.span_hash(t.data, starts, ends) ^ tx.mix64((ends - starts).astype(np.uint64)))
    order = np.lexsort((keys, doc))
    same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return total, np.bincount(doc[order][1:][same], minlength=n)


def repeated_words(t: Texts, window: int = 5) -> np.ndarray:
    """Words in a window of so many words that occurs twice or more in its document."""
    g = tx.grams(t.hashes(), window)
    doc = tx.owner(t.first)
    n = len(g)
    covered = np.zeros(len(doc) + 1, np.int64)
    if n:
        inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
        keys = tx.mix64(g[inside] + tx.mix64(doc[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(inside), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    hit = np.cumsum(covered)[:-1] > 0
    return _per(hit, t.first)


@dataclass(frozen=True)
class Rule:
    """Rejects documents: bad(texts) is a boolean for each document of texts."""

    name: str
    bad: Callable[[Texts], np.ndarray]


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > 3 * t.n_words


def _line_copies(t: Texts) -> np.ndarray:
    total, copies = t.line_counts
    return 10 * copies > 5 * total


def _capitals(t: Texts) -> np.ndarray:
    return 10 * _per(_UPPER[t.data], t.offsets) > 6 * np.maximum(_per(_LETTER[t.data] & _HEAD[t.data], t.offsets), 1)


def _word_length(t: Texts) -> np.ndarray:
    points = t.code_points
    return (points < 2 * t.n_words) | (points > 20 * t.n_words)


def _wordless(t: Texts) -> np.ndarray:
    letters = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LETTER[t.data], out=letters[1:])
    return 10 * _per(letters[t.ends] > letters[t.starts], t.first) < 6 * t.n_words


def _shouts(t: Texts) -> np.ndarray:
    loud = np.zeros(len(t.starts), bool)
    wide = np.flatnonzero(t.ends - t.starts > 2)
    loud[wide] = (t.data[t.ends[wide] - 1] == 33) & (t.data[t.ends[wide] - 2] == 33)
    return 10 * _per(loud, t.first) > 3 * t.n_words


RULES = (
    Rule("symbols", _symbols),
    Rule("line_copies", _line_copies),
    Rule("capitals", _capitals),
    Rule("word_length", _word_length),
    Rule("wordless", _wordless),
    Rule("shouts", _shouts),
)


#: What `quality` returns of every document.
BASE = ("n_symbols", "code_points", "line_counts")


def planned(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by falling rejections per cost, as measured on a sample of whole documents
    that pass the base rule, with the features `given` already there; one task measures them,
    and only its figures come to the driver."""
    total = docs.count()
    if not total:
        return list(rules)

    def measure(batches):
        for batch in common.slices(batches):
            t = Texts(*tx.utf8(batch.column("text")))
            live = np.flatnonzero(~verdict(t, [])[1])
            if not len(live):
                continue
            some = t.only(live)
            for name in given:
                getattr(some, name)
            every = np.arange(len(live))
            rejected, cost = [], []
            for rule in rules:
                took = []
                for _ in range(REPEATS):
                    fresh = some.only(every)
                    began = time.perf_counter_ns()
                    bad = rule.bad(fresh)
                    took.append(time.perf_counter_ns() - began)
                rejected.append(int(bad.sum()))
                cost.append(sorted(took)[REPEATS // 2])
            yield pa.RecordBatch.from_pydict({"rule": np.arange(len(rules)), "rejected": rejected, "cost": cost})

    # row by row: a hash would take or leave all copies of a text at once
    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed=1).repartition(1)
    seen = common.mapped(sample, measure, "rule long, rejected long, cost long").groupBy("rule").agg(F.sum("rejected"), F.sum("cost")).collect()
    gain = {rules[i].name: (rejected + 0.5) / max(1, cost) for i, rejected, cost in seen}
    return sorted(rules, key=lambda r: -gain[r.name]) if gain else list(rules)


_RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
)


def verdict(t: Texts, ordered: list[Rule]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeated words, base rule failed, kept) of each document, the rules run in this order."""
    repeats = t.n_repeats
    failed = (t.n_words < 10) | (100 * repeats > 20 * t.n_words)
    live = np.flatnonzero(~failed)
    some = t.only(live)
    for rule in ordered:
        if not len(live):
            break
        bad = rule.bad(some)
        if bad.any():
            live = live[~bad]
            some = some.only(np.flatnonzero(~bad))
    kept = np.zeros(len(failed), bool)
    kept[live] = True
    return repeats, failed, kept


def passing(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the base rule and all rules keep, with all their columns."""
    own = common.column(docs, "text")
    ordered = planned(docs.select(F.col(f"`{own}`").alias("text")), rules)

    def keep(batches):
        for batch in common.slices(batches, own):
            t = Texts(*tx.utf8(batch.column(batch.schema.get_field_index(own))))
            yield batch.filter(pa.array(verdict(t, ordered)[2]))

    return common.mapped(docs, keep, docs.schema)


def quality(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base features, base_failed and kept of each row of docs(doc_id, text)."""
    docs = common.named(docs, doc_id="doc_id", text="text")
    ordered = planned(docs, rules, sample_rows, BASE)

    def judge(batches):
        for batch in common.slices(batches):
            t = Texts(*tx.utf8(batch.column("text")))
            columns = [t.n_words, t.code_points, t.n_symbols, t.line_counts[1]]
            repeats, failed, kept = verdict(t, ordered)
            columns += [
                repeats,
                failed,
                kept,
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return common.mapped(docs, judge, _RESULT)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
f AS (SELECT t.rid, doc_id, text, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words FROM t LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines
  OR 10 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 6 * greatest(length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')), 1)
  OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) < 6 * n_words
  OR 10 * len(list_filter(w, lambda x: strlen(x) > 2 AND ends_with(x, '!!'))) > 3 * n_words AS bad FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b
"""
