"""Operators 1 and 9 against counting all windows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import anchors, op1_suffix, op9_trees, repeats
from lumenfold.llm import text as tx

from . import cases

ROWS = cases.documents()


def brute_bytes(rows):
    raw = [(r[1] or "").encode() for r in rows]
    out = []
    for row, s, hit in zip(rows, raw, cases.repeated(raw, 200)):
        kept = bytes(b for b, h in zip(s, hit) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((row[0], len(s), sum(hit), runs, cases.sha(kept)))
    return out


def brute_words(rows):
    split = [cases.words(r[1]) for r in rows]
    out = []
    for row, w, hit in zip(rows, split, cases.repeated(split, 35)):
        out.append((row[0], len(w), sum(hit), cases.sha(" ".join(x for x, h in zip(w, hit) if not h).encode())))
    return out


@pytest.mark.parametrize("per_cell, most", [(4_000, 50_000), (3, 2), (1, 1)])
def test_bytes(spark, per_cell, most):
    got = op1_suffix.repeated_bytes(cases.table(spark, ROWS), per_cell=per_cell, most=most).drop("spans").collect()
    cases.same_rows(got, brute_bytes(ROWS))


@pytest.mark.parametrize("per_cell, most", [(4_000, 50_000), (3, 2), (1, 1)])
def test_words(spark, per_cell, most):
    got = op9_trees.repeated_words(cases.table(spark, ROWS), per_cell=per_cell, most=most).collect()
    cases.same_rows(got, brute_words(ROWS))


def test_benchmark_tables(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    cases.same_rows(op1_suffix.op1_suffix_dedup(spark, sf).collect(), brute_bytes(rows))
    cases.same_rows(op9_trees.op9_substrings(spark, sf).collect(), brute_words(rows))


def test_empty_table(spark):
    empty = cases.table(spark, ROWS).where("false")
    assert op1_suffix.repeated_bytes(empty).count() == 0
    assert op9_trees.repeated_words(empty).count() == 0


def test_cut_keeps_rows_and_columns(spark):
    docs = cases.table(spark, ROWS)
    cut = op9_trees.without_repeats(docs)
    assert cut.schema == docs.schema and cut.count() == len(ROWS)
    expected = {}
    for row, (_, _, _, digest) in zip(ROWS, brute_words(ROWS)):
        expected.setdefault((row[0], row[2]), set()).add(digest)
    for r in cut.collect():
        assert cases.sha(" ".join(cases.words(r.text)).encode()) in expected[(r.doc_id, r.row)]
        if r.doc_id == 11:  # a document without repeats stays as it is
            assert r.text == ROWS[11][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5))
def test_anchors_tell_windows(texts):
    """Windows are equal just when their anchors lie alike and their contexts agree there."""
    window, k = 12, 4
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    a = anchors.find(data, offsets, window, k)
    at = {(d, p) for d, f, n, l in zip(a.doc, a.first, a.count, a.last) for p in ([f] if n == 1 else range(f, l + 1))}
    for d, r in enumerate(raw):
        for i in range(len(r) - window + 1):
            assert any((d, i + o) in at for o in range(window - k + 1))


def test_loser_tree_merges_with_prefixes():
    r = random.Random(5)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 40))) for _ in range(7)]
    tree = op1_suffix.LoserTree([op1_suffix.decoded(*op1_suffix.front_coded(x)) for x in runs])
    at, out, before = [0] * len(runs), [], b""
    for run, shared in tree:
        s = runs[run][at[run]]
        at[run] += 1
        if out:
            assert shared == op1_suffix.common_prefix(before, s, 0)
        out.append(s)
        before = s
    assert out == sorted(x for run in runs for x in run)


def test_suffix_tree_nodes():
    rows = [b"banana"[i:] for i in range(6)]
    wide = np.zeros((6, 6), np.uint8)
    for i, s in enumerate(rows):
        wide[i, : len(s)] = np.frombuffer(s, np.uint8)
    tree = op9_trees.SuffixTree.build(wide, np.array([len(s) for s in rows]))
    found = {(d, tuple(sorted(rows[i] for i in tree.order[a:b]))) for d, a, b, _ in tree.nodes}
    assert found == {(1, (b"a", b"ana", b"anana")), (3, (b"ana", b"anana")), (2, (b"na", b"nana"))}
    assert tree.deep(2).tolist() == [[1, 3], [4, 6]] and tree.deep(3).tolist() == [[1, 3]] and tree.deep(1).tolist() == [[0, 3], [4, 6]]
    assert tree.under(2).tolist() == [6, 0, 0, 9, 1, 1]


def test_classes():
    assert repeats.classes_at(np.array([0, 3, 1, 5]), 2).tolist() == [1, 1, 2, 2]


def test_words_with_the_same_half_of_a_hash_differ(spark):
    """Two passages differ in one word each, whose hashes share their upper half."""
    words = [f"q{i}" for i in range(400_000)]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = tx.span_hash(raw, np.concatenate([[0], ends[:-1]]), ends) >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    assert len(same)
    around = [f"w{i}" for i in range(40)]
    texts = []
    for n, i in enumerate(same[:5]):
        for w in (words[order[i]], words[order[i + 1]]):
            passage = [f"{x}n{n}" for x in around]
            texts.append(" ".join([*passage[:20], w, *passage[20:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op9_trees.repeated_words(docs).collect()
    assert len(got) == len(texts) and all(r.n_words == 41 and r.n_removed == 0 for r in got)


def test_one_passage_in_every_document(spark):
    """Its anchors have more contexts than a cell may hold, so that their prefixes grow up to whole windows."""
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice("abcdefgh") * r.randrange(1, 6) + str(r.randrange(30)) for _ in range(n))
    passage, tail = prose(36), prose(20)
    texts = [" ".join([prose(r.randrange(40)), passage, tail if i % 3 else prose(12), prose(r.randrange(40))]) for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "Doc_Id long, TEXT string")
    cases.same_rows(op1_suffix.repeated_bytes(docs, per_cell=6, most=6).drop("spans").collect(), brute_bytes(rows))
    cases.same_rows(op9_trees.repeated_words(docs, per_cell=6, most=6).collect(), brute_words(rows))
    cut = op9_trees.without_repeats(docs, per_cell=6, most=6)
    assert cut.columns == docs.columns
    left = {i: cases.sha(" ".join(cases.words(t)).encode()) for i, t in cut.collect()}
    assert left == {i: digest for i, _, _, digest in brute_words(rows)}
