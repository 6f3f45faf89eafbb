"""Secret scans: three base patterns and sliding-window entropy of candidate strings.

Base spans are leftmost, non-overlapping matches of the three patterns that pass their
length tests.  The entropy scan takes candidate strings (maximal runs of token characters,
and their parts between `=`, `/` and all other signs), gives each the smallest character
class that holds it and whose window fits, and slides that class's window over it: counts
are updated for the character that enters and the one that leaves, so each step costs O(1).
Windows at or above the class's entropy become spans (touching ones merge), unless the span or
the candidate has a public shape.  Of a span that holds an allowed word the word is taken out,
and what is left on its sides is judged again by itself.  Neither removes a base span.

A vectorised pass over the bytes finds documents that can hold a match at all; only those
are decoded.  Offsets are code points, end exclusive.  Null and empty texts have no spans;
null ids are kept; every row of the input gives one row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from . import text as tx

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARTS = (re.compile(r"[^=]{20,}"), re.compile(r"[^=/]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"))


@dataclass(frozen=True)
class Class:
    """Candidates of only these characters; windows of so many reach so many bits a character."""

    name: str
    pattern: re.Pattern
    window: int
    bits: float


CLASSES = (
    Class("hex", re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)"), 24, 3.0),
    Class("base32", re.compile(r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+"), 20, 3.4),
    Class("base36", re.compile(r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+"), 20, 3.4),
    Class("base64", re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+"), 24, 3.9),
    Class("letters", re.compile(r"(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+"), 24, 4.1),
)

#: Whole candidates that look random but are public: identifiers, words in a row, one character.
SHAPES = (
    re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)+(?:[-_/][0-9]{1,4})*"),
    re.compile(r"(.)\1*"),
)
#: Token characters that join what is left to an allowed word.
SIGNS = "=/_+-"
#: Words of examples and alphabets.
ALLOWED = re.compile(r"(?i)example|sample|placeholder|changeme|dummy|0123456789|abcdefghij")


def window_entropies(s: str, window: int):
    """Shannon entropy in bits a character of each window of s, by incremental counts."""
    n = min(window, len(s))
    log = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    for ch in s[:n]:
        counts[ch] = counts.get(ch, 0) + 1
    total = math.fsum(log[c] for c in counts.values())
    top = math.log2(n)
    out = [top - total / n]
    for i in range(n, len(s)):
        gone, come = s[i - n], s[i]
        if gone != come:
            c = counts[gone]
            total += log[c - 1] - log[c]
            counts[gone] = c - 1
            c = counts.get(come, 0)
            total += log[c + 1] - log[c]
            counts[come] = c + 1
        out.append(top - total / n)
    return out


def _class(s: str, classes) -> Class | None:
    """The smallest class that holds s and whose window fits into it."""
    return next((c for c in classes if len(s) >= c.window and c.pattern.fullmatch(s)), None)


def _dense(s: str, kind: Class) -> list[tuple[int, int]]:
    """Spans of s that windows at or above the class's entropy cover; touching ones merge."""
    spans = []
    begin = end = None
    for i, h in enumerate(window_entropies(s, kind.window)):
        if h >= kind.bits - 1e-9:
            if begin is None:
                begin = i
            elif i > end:
                spans.append((begin, end))
                begin = i
            end = i + kind.window
    if begin is not None:
        spans.append((begin, end))
    return spans


def _judged(s: str, classes, allowed: re.Pattern, shapes) -> list[tuple[int, int]]:
    """Spans of one candidate or part: those of its class, with allowed words taken out."""
    kind = _class(s, classes)
    if not kind or any(x.fullmatch(s) for x in shapes):
        return []
    out = []
    for a, b in _dense(s, kind):
        if any(x.fullmatch(s[a:b]) for x in shapes):
            continue
        words = [(a + m.start(), a + m.end()) for m in allowed.finditer(s[a:b])]
        if not words:
            out.append((a, b))
        for low, high in zip([a, *(end for _, end in words)], [*(start for start, _ in words), b]) if words else ():
            low += high - low - len(s[low:high].lstrip(SIGNS))
            out += [(low + x, low + y) for x, y in _judged(s[low:high].rstrip(SIGNS), classes, allowed, shapes)]
    return out


def entropy_spans(text: str, classes=CLASSES, allowed=ALLOWED, shapes=SHAPES) -> list[tuple[int, int]]:
    spans = []
    for m in CANDIDATE.finditer(text):
        if any(x.fullmatch(m.group()) for x in shapes):
            continue
        found = set()
        for at, s in {(0, m.group()), *((p.start(), p.group()) for cut in PARTS for p in cut.finditer(m.group()))}:
            found |= {(at + a, at + b) for a, b in _judged(s, classes, allowed, shapes)}
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans += [(m.start() + a, m.start() + b) for a, b in merged]
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return found


_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
#: Every class asks for one of these.
_NEEDED = np.zeros(256, bool)
_NEEDED[48:58] = _NEEDED[65:91] = True
_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True


def _long_runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of at least so many, each inside one document."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[offsets] = True
    before, after = np.concatenate([[False], mask]), np.concatenate([mask, [False]])
    starts, ends = np.flatnonzero(after & (cut | ~before)), np.flatnonzero(before & (cut | ~after))
    long = ends - starts >= least
    return starts[long], ends[long]


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that can hold a span: every other one has none."""
    marks = [np.flatnonzero((data == 58) | (data == 61))]
    starts, ends = _long_runs(_TOKEN[data], offsets, 18)
    needed = np.concatenate([[0], np.cumsum(_NEEDED[data])])
    marks.append(starts[needed[ends] > needed[starts]])
    heads = data[:-3] == 65  # AKIA
    for k, ch in enumerate(b"KIA", 1):
        heads = heads & (data[k : len(data) - 3 + k] == ch)
    marks.append(np.flatnonzero(heads))
    marks.append(_long_runs(_HEXES[data], offsets, 16)[0])
    at = np.concatenate(marks)
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base, spans of each row of docs(doc_id, text);
    base and spans are arrays of struct(kind, start, end) in order of start, then kind."""
    docs = common.named(docs, doc_id="doc_id", text="text")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = "array<struct<kind: string, start: long, end: long>>"

    def scan(batches):
        for batch in common.slices(batches):
            texts = batch.column("text")
            data, offsets = tx.utf8(texts)
            n = batch.num_rows
            base: list[list] = [[]] * n
            spans: list[list] = [[]] * n
            counts = np.zeros((len(KINDS), n), np.int64)
            for i in suspects(data, offsets).tolist():
                found = found_spans(bytes(data[offsets[i] : offsets[i + 1]]).decode())
                spans[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]
                base[i] = [s for s in spans[i] if s["kind"] != "entropy"]
                for _, k, _ in found:
                    counts[k, i] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(span))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans"],
            )

    return common.mapped(docs, scan, f"doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base {kinds}, spans {kinds}")


def found_spans(text: str) -> list[tuple[int, int, int]]:
    """All (start, kind's number, end) of one text, in order."""
    found = [(a, KINDS.index(k), b) for a, b, k in base_spans(text)]
    found += [(a, 3, b) for a, b in entropy_spans(text)]
    return sorted(found)


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each maximal run of span characters in `text` replaced by mask; other columns stay."""
    schema, own = docs.schema, common.column(docs, "text")

    def hide(batches):
        for batch in common.slices(batches, own):
            at = batch.schema.get_field_index(own)
            texts = batch.column(at)
            data, offsets = tx.utf8(texts)
            changed = {}
            for i in suspects(data, offsets).tolist():
                text = bytes(data[offsets[i] : offsets[i + 1]]).decode()
                parts, done = [], 0
                merged: list[list[int]] = []
                for a, _, b in found_spans(text):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    parts += [text[done:a], mask]
                    done = b
                if merged:
                    changed[i] = "".join([*parts, text[done:]])
            if changed:
                values = texts.to_pylist()
                for i, text in changed.items():
                    values[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, texts.type))
            yield batch

    return common.mapped(docs, hide, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    def listed(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )
