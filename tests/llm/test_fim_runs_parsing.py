"""Operators 11, 12 and 13 against plain loops."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lumenfold.llm import op11_fim, op12_runs, op13_parsing
from lumenfold.llm.text import mix64

from . import cases

EXTRA = ["<P>", "a<S>b", "<M", "a\r\nb́\0é\U0001f600\U0001f1e9\U0001f1ea", "x" * 3000, "<" * 9, "S>M>", "퟿"]
ROWS = cases.documents() + [(1000 + i, EXTRA[i % len(EXTRA)] * (1 + i % 3), 0, None, 0, None, "", None) for i in range(120)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11


def brute_fim(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", a, b - a, sha(out), sha(text))


def test_fim(spark, sf, tmp_path):
    docs = cases.table(spark, ROWS)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    got = op11_fim.op11_fim(spark, path).collect()
    cases.same_rows(got, [brute_fim(r[0], r[1]) for r in ROWS])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sql = op11_fim.SQL.replace("FROM documents", f"FROM '{path}/documents.parquet/*.parquet'")
    names = ", ".join(f'"{c}"' for c in got[0].__fields__)
    cases.same_rows(got, duckdb.sql(f"SELECT {names} FROM ({sql})").fetchall())
    assert op11_fim.transformed(docs.where("false")).count() == 0
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    cases.same_rows(op11_fim.op11_fim(spark, sf).collect(), [brute_fim(*r) for r in rows])


def test_fim_restores_the_text_from_output_and_form(spark):
    docs = cases.table(spark, ROWS).selectExpr("doc_id AS id", "text AS Body", "row AS n", "h AS output")
    made = op11_fim.transformed(docs, "ID", "body")
    texts = [r[0] for r in made.select(op11_fim.restored()).collect()]
    assert sorted(texts) == sorted(r[1] or "" for r in ROWS)


def test_offsets_are_of_code_points():
    for text in [r[1] or "" for r in ROWS if len(r[1] or "") < 4000] + ["\U0001f600" * (op11_fim.BLOCK + 1), "é" * 2 * op11_fim.BLOCK]:
        units = op11_fim.Units(text)
        assert units.n == len(text)
        assert [units.start(i) for i in range(0, len(text) + 1, 7)] == [len(text[:i].encode()) for i in range(0, len(text) + 1, 7)]
        assert units.start(units.n) == len(text.encode())


# -- 12


def brute_runs(words, least):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 80), st.sampled_from([2, 5, 12]))
@example([0] * 60, 1, 12)
@example([0, 1] * 30, 60, 12)
def test_runs(ids, period, least):
    for s in (ids, [ids[i % min(period, len(ids))] for i in range(len(ids))], ids + ids[::-1] + ids):
        assert op12_runs.runs_of(s, least) == brute_runs(s, least)
        words = [str(x) for x in s] + ["once"] + [str(x) for x in ids]
        assert op12_runs.runs_of_words(words, least) == brute_runs(words, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_factors_are_the_longest_that_start_earlier(ids):
    at = 0
    for start, end, distance in op12_runs.factors(ids):
        longest = max([k for p in range(start) for k in range(len(ids) - start + 1) if ids[p : p + k] == ids[start : start + k]], default=0)
        assert start == at and end - start == max(longest, 1) and (distance > 0) == (longest > 0)
        assert ids[start - distance : end - distance] == ids[start:end] and distance <= start
        at = end
    assert at == len(ids)


def test_fibonacci_words_have_runs_inside_runs():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    assert op12_runs.runs_of_words(list(b[:800])) == brute_runs(b[:800], 12)
    assert len(op12_runs.runs_of_words(list(b))) > 100


def brute_periodic(doc_id, text):
    words = cases.words(text)
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), sha(lines), sha(kept))


def test_runs_query(spark, sf, tmp_path):
    rows = [r for r in ROWS if len(cases.words(r[1])) < 3000]
    rows += [(5000 + i, ("one two three " * (i % 9 + 1) + f"w{i} ") * (i % 4) + "end", 0, None, 0, None, "", None) for i in range(60)]
    cases.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_runs.op12_runs(spark, str(tmp_path)).collect()
    cases.same_rows(got, [brute_periodic(r[0], r[1]) for r in rows])
    assert sum(r.n_runs > 1 for r in got) > 5
    assert op12_runs.periodic(cases.table(spark, rows).where("false")).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(cases.words(r.text)) < 800}
    got = [r for r in op12_runs.op12_runs(spark, sf).collect() if r.doc_id in short]
    cases.same_rows(got, [brute_periodic(*r) for r in short.items()])


# -- 13


def plain_names(text):
    """The name of the whole text, and the names of all phrases from level LOWEST up, by loops."""
    mix = lambda v: int(mix64(np.array([v % 2**64], np.uint64))[0])
    run, step, salt = 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xA0761D6478BD642F
    symbols, level, names = [mix(ord(c) + salt) for c in text], 0, set()
    while symbols and (level == 0 or len(symbols) > 1):
        level += 1
        powers = []
        for s in symbols:
            if powers and powers[-1][0] == s:
                powers[-1][1] += 1
            else:
                powers.append([s, 1])
        s = [a if k == 1 else mix(a * run + k) for a, k in powers]
        label = s
        for _ in range(4):
            label = [op13_parsing._tossed(label[i - 1] if i else label[0] ^ 1, label[i]) for i in range(len(s))]
        for high in (5, 4, 3):
            for i in range(len(s)):
                if label[i] == high:
                    label[i] = min({0, 1, 2} - set(label[max(i - 1, 0) : i] + label[i + 1 : i + 2]))
        assert all(a != b for a, b in zip(label, label[1:])) and set(label) <= {0, 1, 2}
        begins = [i for i in range(len(s)) if i == 0 or 2 <= i < len(s) - 1 and label[i] > label[i - 1] and label[i] > label[i + 1]]
        symbols = []
        for a, b in zip(begins, [*begins[1:], len(s)]):
            name = mix(s[a] + salt)
            for j in range(a + 1, b):
                name = mix(name * step + s[j])
            symbols.append(name)
        if level >= op13_parsing.LOWEST or len(symbols) == 1:
            names |= set(symbols)
    return (symbols[0] if symbols else 0), {mix(n) >> 32 for n in names}


def plain_fingerprint(text):
    name, hashes = plain_names(text)
    return f"{name:016x}-" + "".join(f"{h:08x}" for h in sorted(hashes)[: op13_parsing.SKETCH])


def plain_likeness(a, b):
    if a[:16] == b[:16]:
        return 1.0
    x, y = ({v[17 + i : 25 + i] for i in range(0, len(v) - 17, 8)} for v in (a, b))
    least = sorted(x | y)[: op13_parsing.SKETCH]
    return sum(h in x and h in y for h in least) / len(least)


def plain_beside_next(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), np.int64(np.uint64(xxhash.xxh64(r[1].encode(), seed=42).intdigest())), zlib.crc32(r[1].encode()))
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=key)
    marks = {t: plain_fingerprint(t) for _, t in ordered}
    out = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 3
        change = t[: len(t) - k] + after[:k]
        mark = plain_fingerprint(change)
        out.append((i, len(t), sha(change), marks[t], mark, plain_likeness(marks[t], mark), plain_likeness(marks[t], marks[after])))
    return out


def test_beside_next(spark):
    rows = [r for r in ROWS if len(r[1] or "") < 6000] + [ROWS[8]] * 40  # one repeated row in many places
    expected = plain_beside_next(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            cases.same_rows(op13_parsing.beside_next(cases.table(spark, rows)).collect(), expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert op13_parsing.beside_next(cases.table(spark, rows).where("false")).count() == 0
    one = op13_parsing.beside_next(cases.table(spark, [(7, "abcdef", 0, "", 0, "", "", "")])).collect()
    cases.same_rows(one, plain_beside_next([(7, "abcdef")]))


def test_fingerprints(spark):
    rows = [r for r in ROWS if len(r[1] or "") < 6000]
    got = op13_parsing.fingerprints(cases.table(spark, rows))
    cases.same_rows(got.collect(), [(r[0], len(r[1] or ""), plain_fingerprint(r[1] or "")) for r in rows])


def test_query_columns(spark, sf):
    got = op13_parsing.op13_fingerprints(spark, sf)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = got.toPandas()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts) and set(rows.doc_id) == set(texts)
    for r in rows.itertuples():
        following = max((i for i in texts if i < r.doc_id), default=max(texts))
        assert r.edited_sha256 == sha(op13_parsing.edited(texts[r.doc_id] or "", texts[following] or ""))
        assert r.near_edited == op13_parsing.likeness(r.fingerprint, r.edited_fingerprint)
    assert rows.near_edited.median() > 0.4 and rows.near_next.median() < 0.05


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=1, max_size=300), st.text("abc", max_size=80), st.text("abc", max_size=80))
def test_equal_substrings_share_phrases_wherever_they_stand(middle, before, after):
    middle = middle + "".join(sha(str(i)) for i in range(12))
    a, b = (set(op13_parsing.parsed([t])[2].tolist()) for t in (before + middle, middle + after))
    inside = set(op13_parsing.parsed([middle])[2].tolist())
    assert len(a & b) > 0.75 * len(inside)
    assert op13_parsing.parsed(["x", before + middle, "", middle])[0][1] == op13_parsing.parsed([before + middle])[0][0]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_likeness_estimates_the_shared_part(share):
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, r.integers(2, 9))) for _ in range(9000)]
    a, b = words[:3000], words[: int(3000 * share)] + words[3000 : 3000 + int(3000 * (1 - share))]
    x, y = op13_parsing.all_sketches([" ".join(a), " ".join(b)])
    exact = share / (2 - share)
    assert abs(op13_parsing.sketch_likeness(x, y) - exact) < 0.2
    assert op13_parsing.sketch_likeness(x, x) == 1.0
