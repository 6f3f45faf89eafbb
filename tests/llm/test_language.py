"""Operators 7 and 8, the pipeline and the SQL twins."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common, gru, op7_chat, op8_gru, queries

from . import cases

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    keys = [c for c in columns if ours[c].dtype != float]
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (ours, theirs))
    assert (a.fillna(-1).values == b.fillna(-1).values).all()


def test_preferences(spark):
    turn = lambda *x: [{"role": r, "text": t} for r, t in x]
    a, b = ("user", "hi"), ("assistant", "yes")
    pairs = [
        (1, turn(a, b, ("user", "more"), ("assistant", "good")), turn(a, b, ("user", "more"), ("assistant", "bad"))),
        (2, turn(a, b), turn(a, b)),
        (3, turn(a, b, ("user", "x")), turn(a, b)),
        (4, turn(("system", "s"), a), turn(("user", "other"))),
        (5, [], turn(a)),
    ]
    kind = "array<struct<role: string, text: string>>"
    df = spark.createDataFrame(pairs, f"pair_id long, chosen {kind}, rejected {kind}")
    got = {r.pair_id: r for r in op7_chat.preferences(df).collect()}
    text = lambda side: "".join(p.text for p in side)
    counted = lambda side: "".join(p.text for p in side if p.counts)
    assert got[1].shared == 3 and got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n"
    assert counted(got[1].chosen) == "good<|end|>\n" and text(got[1].rejected) == "<|assistant|>\nbad<|end|>\n"
    assert got[2].shared == 1 and text(got[2].chosen) == text(got[2].rejected) == "<|assistant|>\nyes<|end|>\n"
    assert got[3].shared == 1 and counted(got[3].chosen) == "yes<|end|>\n"
    assert got[4].shared == 0 and got[4].prompt == "" and counted(got[4].chosen) == ""
    assert got[5].shared == 0 and text(got[5].chosen) == ""


def test_conversation_edges(spark):
    rows = [
        (1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, None),
        (0, 0, "user", "q", "x"), (0, 1, "assistant", None, "x"), (2, 0, "user", "alone", "x"), (None, 0, "assistant", "lost", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string")
    said = {r.conv_id: [(t.turn, t.role, t.text) for t in r.said] for r in op7_chat.conversations(df).collect()}
    assert said == {1: [(None, None, None), (0, "user", "a"), (1, "assistant", "b")], 0: [(0, "user", "q"), (1, "assistant", None)], 2: [(0, "user", "alone")]}
    pairs = {r.pair_id: r for r in op7_chat.preferences(op7_chat.answer_pairs(df)).collect()}
    assert set(pairs) == {0, 1}
    assert "".join(p.text for p in pairs[0].rejected) == "<|assistant|>\nb<|end|>\n"
    assert op7_chat.preferences(op7_chat.answer_pairs(df.where("false"))).count() == 0
    plan = op7_chat.preferences(op7_chat.answer_pairs(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_scores(spark):
    rows = cases.documents() + [(1000 + i, cases.documents(i)[11][1], 0, "", 0, "", "", "") for i in range(30)]
    got = op8_gru.scores(cases.table(spark, rows), head_size=64, words=32, per_class=8, size=8).collect()
    split = [cases.words((r[1] or "").translate(cases.LOWER)) + [None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    c = Counter(w for s, h in zip(split, held) if not h for w in s)
    n, v = sum(c.values()), len(c)
    expected = [
        (r[0], h, len(s), sum(w in c for w in s), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), 6))
        for r, s, h in zip(rows, split, held)
    ]
    cases.same_rows([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], expected)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_scores_of_empty_tables(spark):
    docs = cases.table(spark, cases.documents())
    assert op8_gru.scores(docs.where("false")).count() == 0
    only = op8_gru.scores(docs.where("doc_id = 1"), words=32, per_class=8).collect()
    assert len(only) == 1 and only[0].n_tokens == 1


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = op8_gru.scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_a_thousand_words_have_context():
    w, c = np.arange(3000) * 7919, np.arange(3000, 0, -1)
    w[0] = op8_gru.END
    head = op8_gru.Head(w, c, op8_gru.WORDS, int(c.sum()), len(c))
    ids = head.inner_ids(w, op8_gru.WORDS)
    assert len(np.unique(ids[:1024])) == 1024 and (ids[:1024] < op8_gru.WORDS).all()
    assert gru.fresh(c[: op8_gru.WORDS].astype(float), 1.0, op8_gru.SIZE, op8_gru.PER_CLASS)["u"].shape[0] >= 16


def test_model_is_a_distribution():
    p = gru.fresh(np.array([5.0, 3, 2, 1, 1, 1, 1, 1]), 4.0, 6, 4)
    m = gru.Model(p)
    h = np.random.default_rng(0).standard_normal((3, 6)).astype(np.float32)
    total = sum(np.exp(m._output(h, np.full(3, w), False)[0]) for w in range(9))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradients_and_carried_state():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in gru.fresh(r.integers(1, 50, 8).astype(float), 10.0, 4, 4).items()}
    m = gru.Model(p)
    tokens, offsets = r.integers(0, 9, 30), np.array([0, 7, 7, 19, 30])
    given, wanted, first, place = next(iter(gru.windows(tokens, offsets, 2, 2, 40)))
    h = np.zeros((given.shape[1], 4))
    _, g, _ = m.loss_and_grad(h, given, wanted, first, place >= 0)
    for k in gru.KEYS:
        for _ in range(3):
            i = tuple(r.integers(0, s) for s in p[k].shape)
            old, e = p[k][i], 1e-3
            p[k][i] = old + e
            up = m.loss_and_grad(h, given, wanted, first, place >= 0)[0]
            p[k][i] = old - e
            down = m.loss_and_grad(h, given, wanted, first, place >= 0)[0]
            p[k][i] = old
            assert abs(g[k][i] - (up - down) / (2 * e)) < 1e-3
    whole = m.log_likelihood(tokens, offsets, 2, 1, 100)
    assert np.allclose(whole, m.log_likelihood(tokens, offsets, 2, 3, 2), atol=1e-6)


def test_pipeline(spark, sf):
    import corpus_pipeline

    from .test_neighbours import brute_classes
    from .test_quality_secrets import brute_quality, brute_spans
    from .test_tokens import check_packing

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in raw.collect()]
    docs, columns = raw, raw.columns
    kept = {x[0] for x in brute_quality(rows) if x[-1]}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r, c in zip(rows, brute_classes(rows)) if c[0] == c[2]]
    split = [cases.words(t) for _, t in rows]
    words = {r[0]: [w for w, h in zip(s, hit) if not h] for r, s, hit in zip(rows, split, cases.repeated(split, 35))}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.written(stage(spark, docs, sf))
        assert docs.columns == columns
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {i: cases.words(t) for i, t in before.items()} == words
    after = {r.doc_id: r.text for r in common.written(corpus_pipeline.secret_scan(spark, docs, sf)).collect()}
    for i, t in before.items():
        assert (after[i] == t) == (not brute_spans(t))
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in packed} == set(before)
    check_packing(list(after.items()), packed)


def test_pipeline_of_awkward_documents(spark, tmp_path):
    """Nulls, empty texts, null and repeated ids, repeated rows; and a table without rows."""
    import corpus_pipeline

    from .test_tokens import check_packing

    docs = cases.table(spark, cases.documents()).selectExpr("doc_id", "text", "lang", "h AS source", "length(text) AS n_chars")
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert packed
    last = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = common.written(stage(spark, last, ""))
    texts = [(r.doc_id, r.text) for r in last.collect()]
    assert len(texts) == sum(p.piece == 0 for p in packed)
    check_packing(texts, packed)
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: r.score for r in op8_gru.scores(docs.repartition(n), words=64, per_class=8, size=4).collect()} for n in (2, 7))
    assert one.keys() == other.keys()
    assert all(abs(one[i] - other[i]) <= 1e-4 * abs(one[i]) for i in one)
