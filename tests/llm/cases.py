"""Documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row int, h string, key long, node string, spans string, lang string"


def words(text):
    return WORD.findall(text or "")


def documents(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéüñ") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(200)
    texts = [None, "", " \t\n ", "one", "two words", "Four words are here", base, base, base, prose(1), prose(35), prose(34)]
    for _ in range(12):  # near copies
        w = base.split(" ")
        for _ in range(r.randrange(1, 8)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    for i in range(14):  # a shared passage, at other places, and twice in one document
        a, b = prose(r.randrange(0, 50)), prose(r.randrange(0, 50))
        texts.append(" ".join([a, passage, b] + ([passage] if i % 5 == 0 else [])))
    texts += ["x" * 700, "ab " * 400, "word\n" * 300, "line one\nline one\n\n  \nline two\nline one", base.upper(), base.replace(" ", "\n\t ")]
    texts += [prose(20_000), "\0\x01 odd   bytes \U0001f600 " + prose(50), prose(120), prose(90) + " " + prose(90)]
    rows = [(i, t, i, "h", -i, None, "spans", "en") for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    rows.append((21, prose(70), 0, None, 0, None, None, None))  # a repeated id
    rows.append((None, base, 0, None, 0, None, None, None))  # a null id
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def repeated(sequences: list, window: int) -> list[list[bool]]:
    """For each sequence, which of its members a window that occurs twice covers."""
    seen = Counter(tuple(s[i : i + window]) if not isinstance(s, bytes) else s[i : i + window] for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        hit = [False] * len(s)
        for i in range(len(s) - window + 1):
            key = s[i : i + window] if isinstance(s, bytes) else tuple(s[i : i + window])
            if seen[key] > 1:
                hit[i : i + window] = [True] * window
        out.append(hit)
    return out


def same_rows(got, expected) -> None:
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert order([tuple(r) for r in got]) == order([tuple(r) for r in expected])
