"""Operators 4 and 6 against brute force."""

import numpy as np
import pytest

from lumenfold.llm import minhash, op4_hilbert, op6_minhash

from . import cases

ROWS = cases.documents()


def shingles(text):
    w = cases.words((text or "").translate(cases.LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    known = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for a in known:
        for b in known:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[find(b)] = find(a)
    least = {}
    for i in known:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return [(r[0], len(sets[i]), least[find(i)] if i in set(known) else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [2000, 3])
def test_classes(spark, block):
    got = op6_minhash.near_duplicates(cases.table(spark, ROWS), block=block).select("doc_id", "n_shingles", "component_id").collect()
    cases.same_rows(got, brute_classes(ROWS))


def test_one_of_each_class_stays(spark):
    docs = cases.table(spark, ROWS)
    kept = op6_minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    expected = {(c[0]) for c in brute_classes(ROWS) if c[0] is not None and c[0] == c[2]}
    rows = kept.collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == expected
    assert sum(r.doc_id is None for r in rows) == sum(r[0] is None for r in ROWS)
    assert op6_minhash.near_duplicates(docs.where("false")).count() == 0


def test_dedup_leaves_other_columns_alone(spark):
    """Columns named like the operator's own, names in any case, a class whose least id is shared."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:99], "x"]), " ".join([*base[:98], "y", "z"]), "other text altogether here now", None]
    rows = [(i, 70 + n, t, "r", "n", -n) for n, (i, t) in enumerate([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (4, texts[4]), (4, texts[4])])]
    docs = spark.createDataFrame(rows, "Doc_ID long, text_key long, TEXT string, row string, node string, root long")
    got = op6_minhash.deduplicated(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(r.Doc_ID for r in kept) == [1, 3, 4]
    assert all(tuple(r) in {tuple(x) for x in rows} for r in kept)


def test_more_rows_than_a_slice(spark):
    docs = spark.createDataFrame([(i, "ab" if i % 2 else "") for i in range(20_000)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    try:
        got = {r.component_id for r in op6_minhash.near_duplicates(docs).where("n_shingles > 0").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1}


def test_settings_of_sizes():
    from lumenfold.llm import common

    assert [common.byte_size(x) for x in ("4m", "64MB", "1048576", "8388608b", "2g", "none")] == [4 << 20, 64 << 20, 1 << 20, 8 << 20, 2 << 30, -1]


def test_links_around_the_threshold(spark):
    """Chains of copies that are linked to the next only, some exactly at the threshold."""
    base = [f"w{i}" for i in range(104)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(k):
            w[(j * 7) % 104] = f"x{j}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op6_minhash.near_duplicates(docs, block=5).select("doc_id", "n_shingles", "component_id").collect()
    cases.same_rows(got, brute_classes(rows))


@pytest.mark.parametrize("block, most", [(2000, 400), (60, 900)])
def test_pairs_of_a_group_are_about_its_members(spark, monkeypatch, block, most):
    """Near copies of one text that also share edits: not a pair for each of the buckets that a member is in."""
    r = np.random.default_rng(6)
    rows = []
    for k in range(200):
        w = [f"w{i}" for i in range(146)]
        for j in r.choice(6, 3, replace=False):
            w[20 * j + 5] = f"x{j}"
        rows.append((k, " ".join(w)))
    rows = [(k, f"{t} y{k}") for k, t in rows]
    counts, components = [], op6_minhash.common.components

    def counted(nodes, links):
        counts.append((nodes.count(), links.count()))
        return components(nodes, links)

    monkeypatch.setattr(op6_minhash.common, "components", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op6_minhash.near_duplicates(docs, block=block).select("doc_id", "n_shingles", "component_id").collect()
    cases.same_rows(got, brute_classes(rows))
    assert all(nodes == 200 and links <= most for nodes, links in counts), counts


def test_signature_estimates_similarity():
    from lumenfold.llm import text as tx
    import pyarrow as pa

    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" for i in range(400, 2000)) + " " + " ".join(f"v{i}" for i in range(400))
    sets, at = minhash.shingle_sets(*tx.utf8(pa.array([a, b])))
    s = minhash.circulant(sets, at, 1000)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def vectors(n=900, dim=16, seed=4):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((12, dim)) * 4
    x = (centers[r.integers(0, 12, n)] + r.standard_normal((n, dim))).astype(np.float32)
    rows = [(i, x[i].tolist(), "a", 1) for i in range(n)]
    for i in range(100, 160):
        rows[i] = (i, rows[0][1], "a", 1)  # many copies of one vector
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1)]
    for j, v in enumerate(bad):
        rows[200 + j] = (200 + j, v, None, None)
    rows.append(rows[5])
    rows.append((None, rows[6][1], "a", 1))
    rows.append((1000, [1.0, 2.0], "a", 1))  # of another length
    return rows


VECTORS = "vec_id long, embedding array<float>, curve string, block int"


def brute_nearest(rows, every, k=10):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q, x in good.items():
        if q % every == 0:
            d = [(float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(x, y)))), i) for i, y in good.items() if i != q and len(y) == len(x)]
            out[q] = sorted(d)[:k]
    return out


def test_exact_in_one_block(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS)
    expected = [(q, n, i, d) for q, best in brute_nearest(rows, 50).items() for n, (d, i) in enumerate(best, 1)]
    cases.same_rows(op4_hilbert.nearest(df, every=50).collect(), expected)
    assert op4_hilbert.nearest(df.where("false")).count() == 0


@pytest.mark.parametrize("queries", [20_000, 3])
def test_recall_over_blocks(spark, monkeypatch, queries):
    monkeypatch.setattr(op4_hilbert, "QUERIES", queries)  # 3: a block's queries go to several groups
    rows = vectors(3000)
    df = spark.createDataFrame(rows, VECTORS)
    expected = brute_nearest(rows, 50)
    found = {}
    for r in op4_hilbert.nearest(df, every=50, block=128).collect():
        found.setdefault(r.query_id, set()).add(r.score)
    hit = sum(len({d for d, _ in best} & found.get(q, set())) for q, best in expected.items())
    assert hit >= 0.9 * sum(len({d for d, _ in best}) for best in expected.values())


def test_index_prunes_clustered_vectors(spark):
    """The default block size; windows are a small share of the table, and most neighbours lie in them."""
    r = np.random.default_rng(2)
    centers = r.standard_normal((100, 32))
    x = centers[r.integers(0, 100, 12_000)] + 0.1 * r.standard_normal((12_000, 32))
    df = spark.createDataFrame([(i, v.tolist(), 32) for i, v in enumerate(x)], "vec_id long, embedding array<double>, dim int")
    index = op4_hilbert.fitted(df, 10, 4096, 0.94)[32]
    assert 0 < len(index.curves) <= 8 and index.share <= 0.15 and index.recall >= 0.94
    found = {}
    for row in op4_hilbert.nearest(df).collect():
        found.setdefault(row.query_id, []).append(row.vec_id)
    hit = 0
    for q, ids in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(ids) & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 120 and hit >= 0.9 * 1200


@pytest.mark.parametrize("size", [1e200, 1e-200, 1.0])
def test_any_finite_size_takes_part(spark, size):
    rows = [(i, [size * (1 + i), size * (i % 3), -size]) for i in range(12)] + [(100, [-size, 2 * size, size])]
    got = op4_hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    expected = []
    for q, x in rows:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(sum(((a - b) / size) ** 2 for a, b in zip(x, y)))), i) for i, y in rows if i != q)
            expected += [(q, n, i) for n, (_, i) in enumerate(d[:10], 1)]
            assert all(abs(r.score / size - d[r.rank - 1][0]) < 1e-9 for r in got if r.query_id == q)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(expected)


def test_hilbert_steps_to_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(op4_hilbert.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
