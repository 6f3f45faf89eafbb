"""Operators 3 and 10 against the libraries and plain packing."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import op3_bpe, op10_packing

from . import cases

ROWS = cases.documents()
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark, library):
    docs = cases.table(spark, ROWS)
    expected = []
    for r in ROWS:
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), cases.sha(" ".join(map(str, ids)).encode()), cases.sha((r[1] or "").encode())))
    cases.same_rows(op3_bpe.round_trip(docs, RANKS, tokenizers.PATTERN).collect(), expected)
    ids = op3_bpe.encoded(docs, RANKS, tokenizers.PATTERN)
    back = op3_bpe.decoded(ids, RANKS, tokenizers.PATTERN).collect()
    cases.same_rows([(r.doc_id, bytes(r.data)) for r in back], [(r[0], (r[1] or "").encode()) for r in ROWS])
    assert op3_bpe.round_trip(docs.where("false"), RANKS, tokenizers.PATTERN).count() == 0


def test_benchmark_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r[0], len(library.encode_ordinary(r[1] or ""))) for r in rows]
    cases.same_rows(op3_bpe.op3_bpe(spark, sf).select("doc_id", "n_tokens").collect(), expected)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_any_text(text):
    import tiktoken

    own = op3_bpe.codec(RANKS, tokenizers.PATTERN)
    if not hasattr(test_any_text, "library"):
        test_any_text.library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=own.vocabulary.rank, special_tokens={})
    ids = own.encode_all([text])[0]
    assert ids == test_any_text.library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_tree_and_forest_agree():
    v = op3_bpe.codec(RANKS, tokenizers.PATTERN).vocabulary
    r = random.Random(2)
    pieces = [bytes(r.choice(b"abcdeting") for _ in range(n)) for n in range(2, 65)]
    for p in pieces:
        width = 1 << (len(p) - 1).bit_length()
        assert op3_bpe.Forest(v, [p], width).merged()[0] == op3_bpe.Tree(v, p).merged()
    long = b"ab" * 20_000
    assert b"".join(v.bytes[i] for i in op3_bpe.Tree(v, long).merged()) == long


def check_packing(rows, pieces, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op10_packing.vocabulary())
    expected = []
    for r in rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((r[0], k, at, len(part), zlib.crc32(part.tobytes())))
    cases.same_rows([(p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces], expected)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("settings_", [{}, {"per_partition": 7, "fan": 2, "exchanged": 3}])
def test_packing(spark, settings_):
    docs = cases.table(spark, ROWS)
    pieces = op10_packing.packed(docs, op10_packing.vocabulary(), **settings_).collect()
    check_packing(ROWS, pieces)
    assert op10_packing.packed(docs.where("false"), op10_packing.vocabulary()).count() == 0


def test_packing_is_tight(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pieces = op10_packing.op10_packing(spark, sf).collect()
    n = check_packing(rows, pieces)
    assert n <= op10_packing.lower_bound(np.array([p.length for p in pieces])) + 1


def test_exchange_closes_gaps(spark):
    """Partitions with gaps hand pieces over: fewer bins than packing each partition alone."""
    r = random.Random(1)
    rows = [(i, r.choice([1400, 1500, 2600, 2700])) for i in range(300)]
    pieces = spark.createDataFrame(rows, "uid long, length long")
    n = op10_packing.pack(pieces, per_partition=20, fan=4, exchanged=8).select("sequence_id").distinct().count()
    alone = op10_packing.pack(pieces, per_partition=20, fan=1000, exchanged=0).select("sequence_id").distinct().count()
    assert op10_packing.lower_bound(np.array([x for _, x in rows])) <= n <= alone


def test_exchange_grows_with_the_gap(spark):
    """One bin for each bin above the bound: as few bins as packing all at once."""
    r = random.Random(2)
    rows = [(i, r.randrange(1000, 1800)) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "uid long, length long")
    got = op10_packing.pack(pieces, per_partition=100, fan=4, exchanged=1).collect()
    assert sorted(p.uid for p in got) == list(range(2000))
    bins = {}
    for p in got:
        bins.setdefault(p.sequence_id, []).append((p.offset, rows[p.uid][1]))
    assert all(a + x <= b for own in map(sorted, bins.values()) for (a, x), (b, _) in zip(own, [*own[1:], (op10_packing.CAPACITY, 0)]))
    assert len(bins) <= len(op10_packing.best_fit(np.array([x for _, x in rows]))[2])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_never_exceeds_the_optimum(lengths):
    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for i in range(len(bins)):
            if bins[i] >= rest[0]:
                best = min(best, optimum(rest[1:], bins[:i] + [bins[i] - rest[0]] + bins[i + 1 :]))
        return min(best, optimum(rest[1:], bins + [20 - rest[0]]))

    bound = op10_packing.lower_bound(np.array(lengths, np.int64), 20)
    assert bound <= (optimum(sorted(lengths, reverse=True), []) if len(lengths) < 7 else len(lengths))
    where, offset, space = op10_packing.best_fit(np.array(lengths, np.int64), 20)
    assert len(space) >= bound and all(s >= 0 for s in space)


def test_words_like_the_whole(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op10_packing.vocabulary())
    texts = ["abc<|endoftext|>def <|ENDOFTEXT|>. x", "it's THE'S don't. 'tis, e", "É école. ÜBER, straße; ſK Å", "1,234.5 a1b2. -- ... ,", "́e ́", "x\x1cy z w", "日本 hello!! wörld?? ñ."]
    for x in texts:
        assert np.frombuffer(op10_packing.encode(x.encode(), op10_packing.vocabulary()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_a_worker_keeps_one_operators_tables():
    from lumenfold.llm import common

    made = []
    first = common.held(("one", "x"), lambda: made.append(1) or {"x": 1})
    assert common.held(("one", "x"), lambda: made.append(2)) is first and made == [1]
    common._give_back("one")
    assert common.held(("one", "x"), lambda: made.append(3)) is first
    common._give_back("other")
    common.held(("one", "x"), lambda: made.append(4))
    assert made == [1, 4]
    common._give_back(None)
