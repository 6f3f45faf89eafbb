"""Approximate nearest neighbours over shifted space-filling curves.

Each curve projects the vectors to at most `AXES` dimensions by its own random orthonormal
directions, shifts the grid by its own offset, and takes the Hilbert index of the cell; a hash
of the id spreads a cell's vectors.  A vector's *place* on a curve is the share of the table
before its key, interpolated between the keys of a sample.  Spark deals each curve's vectors
by ranges of places into blocks of about `block` rows.  A query asks for the vectors within a
window around its own place on every curve, in all blocks that the window meets; what the
windows find is merged and reranked by exact distance.

Blocks hold a byte for each component, scaled to the run of neighbouring vectors that it came
in.  The scaling bounds every distance from below and above, so a block gives all vectors that
can be among its window's k nearest, and only these are joined with their vectors.

How many curves and how wide a window: `PROBES` vectors of the sample get their true k nearest
by brute force over the whole table, one linear pass, and the number of curves is taken whose
windows together are the smallest share of the table at which the probes reach `recall`.  On
clustered vectors that is a few hundredths; random directions of 64 dimensions need many
curves and a third or more, as no ordering separates them well.  A table of one block, or one
where the windows would be the whole table, is one window.  The sample is about `SAMPLE`
vectors by a hash of their ids, of `SAMPLE_BYTES` together; every vector is indexed.

At most k + 1 copies of one vector, those with the least ids, are candidates: no further one
can be among a query's k nearest.  Vectors that are null, zero, or hold null or non-finite
components take no part; vectors of different length are never compared; rows with a null id
take no part.  Rows that repeat an id and its vector count once; of an id with several vectors
the nearest counts.  Distances whose squares leave the range of doubles are scaled by powers of
two.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import text as tx

SAMPLE, SAMPLE_BYTES, PROBES = 4096, 16 << 20, 128
AXES, KEY_BITS = 16, 48
CURVES = (1, 2, 4, 8, 16, 32)
#: Vectors that a task holds before it sends its runs.
RUN = 16_384
#: Queries of a block that a group takes.
QUERIES = 20_000
#: Windows that are together at most this share of a table need no further curves.
ENOUGH = 0.05


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned cell coordinates below 2 ** bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # from coordinates to the transposed index: undo the rotations from the coarsest bit down
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


class Curve:
    """One shifted ordering of vectors of one length."""

    def __init__(self, number: int, sample: np.ndarray, ids: np.ndarray):
        dim = sample.shape[1]
        rng = np.random.Generator(np.random.PCG64([dim, number]))
        axes = min(AXES, dim)
        self.bits = min(16, KEY_BITS // axes)
        self.directions = np.linalg.qr(rng.standard_normal((dim, axes)))[0]
        low, high = np.quantile(sample @ self.directions, [0.005, 0.995], axis=0)
        self.step = np.maximum((high - low) / ((1 << self.bits) - 1), 1e-300)
        self.origin = low - rng.random(axes) * self.step
        self.sample = np.sort(self._keys(sample, ids)).astype(np.float64)

    def _keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cells = np.clip((vectors @ self.directions - self.origin) / self.step, 0, (1 << self.bits) - 1)
        salt = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (hilbert(cells.astype(np.int64), self.bits) << 15) | (salt >> np.uint64(49)).astype(np.int64)

    def places(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The share of the table before each vector, in [0, 1)."""
        n = len(self.sample)
        return np.interp(self._keys(vectors, ids).astype(np.float64), self.sample, (np.arange(n) + 0.5) / n)


class Index:
    """Curves and windows for vectors of one length."""

    def __init__(self, total: int, block: int):
        self.total = total
        self.scale, self.curves, self.reach, self.recall = None, [], 1.0, 1.0
        self.blocks = max(1, -(-total // block))

    def tame(self, vectors: np.ndarray) -> np.ndarray:
        """The vectors in the sample's scale, where products stay finite."""
        return vectors if self.scale is None else np.clip(vectors / self.scale, -1e100, 1e100)

    def fit(self, sample: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, found: list, recall: float) -> None:
        """asked: the probes; found: (probe, id, vector) of their nearest in the whole table."""
        probe = np.array([p for p, _, _ in found], np.int64)
        near_ids, near = np.array([i for _, i, _ in found], np.int64), self.tame(np.array([x for _, _, x in found]))
        apart, best = np.full(len(found), 2.0), (1.0, 0, 1.0, 1.0)
        curves: list[Curve] = []
        for m in CURVES:
            while len(curves) < m:
                curves.append(Curve(len(curves), sample, ids))
                own, other = curves[-1].places(asked, asked_ids), curves[-1].places(near, near_ids)
                apart = np.minimum(apart, np.abs(self._centre(own[probe], 0.0) - other))
            reach = float(np.sort(apart)[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) + 1e-9
            if (share := 2 * m * reach) < best[0]:
                best = (share, m, reach, float((apart <= reach).mean()))
            if best[0] <= ENOUGH:
                break
        self.curves, self.reach, self.recall = curves[: best[1]], best[2], best[3]

    @staticmethod
    def _centre(place: np.ndarray, reach: float) -> np.ndarray:
        return np.clip(place, reach, 1 - reach)

    @property
    def whole(self) -> bool:
        return not self.curves

    @property
    def share(self) -> float:
        """The windows' part of the table, overlaps counted."""
        return 1.0 if self.whole else min(1.0, 2 * self.reach) * len(self.curves)

    def places(self, curve: int, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if self.whole:
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
            return salt.astype(np.float64) / (1 << 53)
        return self.curves[curve].places(vectors, ids)

    def block(self, place: np.ndarray) -> np.ndarray:
        return np.clip((place * self.blocks).astype(np.int64), 0, self.blocks - 1)


def exact(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query's number, row, distance) of each query's k nearest rows, those of its own id excepted; ties to the smaller id."""
    out_q, out_i, out_d = [], [], []
    for n, q in enumerate(queries):
        d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
        d[ids == own[n]] = np.inf
        best = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
        best = best[np.isfinite(d[best])]
        best = best[np.lexsort((ids[best], d[best]))][:k]
        out_q.append(np.full(len(best), n))
        out_i.append(best)
        out_d.append(d[best])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)


def _matrix(column: pa.Array) -> np.ndarray:
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64).reshape(len(column), -1)


def _by_length(batches, most: int):
    """(length, ids, vectors) of at most about `most` rows at a time."""
    held: dict[int, list] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            some = batch.filter(pa.array(dims == dim))
            held.setdefault(dim, []).append((some.column("vec_id").to_numpy(), _matrix(some.column("embedding"))))
            if sum(len(x) for x, _ in held[dim]) >= most:
                yield dim, *(np.concatenate(x) for x in zip(*held.pop(dim)))
    for dim, parts in held.items():
        yield dim, *(np.concatenate(x) for x in zip(*parts))


def _probed(candidates: DataFrame, probes: dict, k: int) -> dict:
    """{length: [(probe, id, vector)]}: the true k nearest of probes {length: (index, vectors, ids)}, by one pass."""
    held = candidates.sparkSession.sparkContext.broadcast(probes)

    def run(batches):
        for dim, ids, x in _by_length(batches, RUN):
            if dim not in held.value:
                continue
            index, asked, own = held.value[dim]
            q, row, d = exact(asked, index.tame(x), ids, own, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), dim, np.int32)), pa.array(q), pa.array(ids[row]), pa.array(d), common.lists(x[row].ravel(), np.arange(len(q) + 1) * dim)],
                ["dim", "probe", "vec_id", "d", "embedding"],
            )

    near = common.mapped(candidates, run, "dim int, probe long, vec_id long, d double, embedding array<double>")
    rank = F.row_number().over(Window.partitionBy("dim", "probe").orderBy("d", "vec_id"))
    out: dict[int, list] = {dim: [] for dim in probes}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= k).collect():  # PROBES * k rows of each length
        out[r.dim].append((r.probe, r.vec_id, r.embedding))
    return out


def fitted(candidates: DataFrame, k: int, block: int, recall: float) -> dict[int, Index]:
    """An index for each length of candidates(vec_id, embedding, dim) with more than a block of vectors."""
    totals = {r[0]: r[1] for r in candidates.groupBy("dim").count().where(F.col("count") > block).collect()}
    indexes, probes, samples = {}, {}, {}
    for dim, total in totals.items():
        n = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim * len(totals))))
        some = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // n))) == 0
        got = candidates.where((F.col("dim") == dim) & some).select("vec_id", "embedding").limit(2 * n).collect()
        indexes[dim] = index = Index(total, block)
        if len(got) < 2:
            continue
        ids, x = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)
        index.scale = float(np.median(np.abs(x).max(axis=1)))
        x = index.tame(x)
        step = max(1, len(got) // PROBES)
        samples[dim] = x, ids
        probes[dim] = index, x[::step][:PROBES], ids[::step][:PROBES]
    found = _probed(candidates, probes, k) if probes else {}
    for dim, pairs in found.items():
        if pairs:
            indexes[dim].fit(*samples[dim], *probes[dim][1:], pairs, recall)
    return indexes


_CELL = "dim int, curve int, block int, part int, asks boolean, ids binary, low binary, high binary, base binary, step binary, vectors binary"


def _row(dim, curve, block, part, asks, ids, low, high, base, step, vectors):
    raw = [np.ascontiguousarray(v).tobytes() for v in (ids, low, high, base, step, vectors)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([n], pa.int32()) for n in (dim, curve, block, part)), pa.array([asks]), *(pa.array([r], pa.binary()) for r in raw)],
        ["dim", "curve", "block", "part", "asks", "ids", "low", "high", "base", "step", "vectors"],
    )


def _parts(index, every: int) -> int:
    """To how many groups a block's queries are dealt by a hash of their ids, so that one has some QUERIES; the block's
    vectors go to each."""
    return max(1, round(index.total / every * min(1.0, 2 * index.reach + 1 / index.blocks) / QUERIES))


def _deal(indexes, asks: bool, every: int):
    """Rows of _CELL: runs of one block's vectors, or of the queries whose windows meet it."""

    def run(batches):
        nothing = np.zeros(0)
        for dim, ids, x in _by_length(batches, RUN):
            index = indexes.value.get(dim) or Index(1, 1)
            x, parts = index.tame(x), _parts(index, every)
            for curve in range(max(1, len(index.curves))):
                place = index.places(curve, x, ids)
                if asks:
                    reach = min(0.5, index.reach)
                    centre = index._centre(place, reach)
                    low, high = centre - reach, centre + reach
                    first, last = index.block(low), index.block(high)
                    if index.whole:
                        low, high, first, last = place - 2, place + 2, np.zeros_like(first), np.full_like(last, index.blocks - 1)
                    row = np.repeat(np.arange(len(ids)), last - first + 1)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
                else:
                    row, block = np.arange(len(ids)), index.block(place)
                part = tx.mix64(ids.astype(np.uint64)) % np.uint64(parts) if asks else np.zeros(len(ids), np.uint64)
                order = np.lexsort((place[row], part[row], block))
                for own in np.split(order, np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(part[row][order]) != 0)) + 1):
                    at, b = row[own], int(block[own[0]])
                    if asks:
                        yield _row(dim, curve, b, int(part[at[0]]), True, ids[at], low[at], high[at], nothing, nothing, x[at])
                    else:
                        base = x[at].min(axis=0)
                        step = x[at].max(axis=0) / 255 - base / 255
                        codes = np.rint((x[at] / 2 - base / 2) / np.where(step > 0, step / 2, 1)).astype(np.uint8)
                        for p in range(parts):
                            yield _row(dim, curve, b, p, False, ids[at], place[at], nothing, base, step, codes)

    return run


def _visit(k: int):
    def visit(table: pa.Table) -> pa.Table:
        columns = {n: table.column(n).to_pylist() for n in ("ids", "low", "high", "base", "step", "vectors")}
        asks, dim = table.column("asks").to_pylist(), table.column("dim")[0].as_py()
        read = lambda n, i, kind: np.frombuffer(columns[n][i], kind)
        runs = [i for i, a in enumerate(asks) if not a]
        out_q, out_v, out_low, out_high = [], [], [], []
        if runs and len(runs) < len(asks):
            ids = np.concatenate([read("ids", i, np.int64) for i in runs])
            place = np.concatenate([read("low", i, np.float64) for i in runs])
            step = [read("step", i, np.float64) for i in runs]
            size = [len(columns["ids"][i]) // 8 for i in runs]
            x = np.concatenate([read("vectors", i, np.uint8).reshape(-1, dim) * s + read("base", i, np.float64) for i, s in zip(runs, step)])
            # no component is further from its code than half a step
            unit = max(np.abs(x).max(), *(np.abs(read("vectors", i, np.float64)).max() for i, a in enumerate(asks) if a))
            unit = 1.0 if 1e-140 < unit < 1e140 else 2.0 ** np.floor(np.log2(unit))
            x /= unit
            off = np.repeat([float(np.sqrt(((s / unit / 2) ** 2).sum())) for s in step], size)
            order = np.argsort(place, kind="stable")
            ids, place, x, off = ids[order], place[order], x[order], off[order]
            for i, a in enumerate(asks):
                if not a:
                    continue
                q = read("vectors", i, np.float64).reshape(-1, dim) / unit
                first = np.searchsorted(place, read("low", i, np.float64), "left")
                last = np.searchsorted(place, read("high", i, np.float64), "right")
                for n, own in enumerate(read("ids", i, np.int64).tolist()):
                    part = slice(first[n], last[n])
                    d = np.sqrt(((x[part] - q[n]) ** 2).sum(axis=1))
                    slack = off[part] + 1e-9 * (1 + d)
                    low, high = d - slack, d + slack
                    other = ids[part] != own
                    if not other.any():
                        continue
                    tops = high[other]
                    limit = np.partition(tops, min(k, len(tops)) - 1)[min(k, len(tops)) - 1]
                    hit = np.flatnonzero(other & ((low <= limit) | ~np.isfinite(d)))
                    out_q.append(np.full(len(hit), own, np.int64))
                    out_v.append(ids[part][hit])
                    out_low.append(low[hit])
                    out_high.append(high[hit])
        join = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "low": join(out_low, float), "high": join(out_high, float)})

    return visit


def _distance(a: str, b: str):
    """Euclidean distance of two array<double> columns: squares summed in order; sums that leave
    the range of doubles are taken again, of differences scaled by a power of two."""
    apart = F.zip_with(a, b, lambda x, y: x - y)
    total = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    most = F.array_max(F.transform(apart, F.abs))
    by = F.when((most > 0) & (most < float("inf")), F.pow(F.lit(2.0), F.floor(F.log2(most)).cast("double"))).otherwise(F.lit(1.0))
    scaled = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + (x / by) * (x / by))) * by
    return F.when((total > 1e-280) & (total < 1e300), F.sqrt(total)).otherwise(scaled)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, block: int = 4096, recall: float = 0.94) -> DataFrame:
    """query_id, rank, vec_id, score of vectors(vec_id, embedding); queries: ids divisible by every."""
    rows = common.named(vectors, vec_id="vec_id", embedding="embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
    # copies beyond the least k + 1 ids of a vector cannot be found; ranking starts before the shuffle
    rows = rows.dropDuplicates(["vec_id", "embedding"])
    spark = rows.sparkSession
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    candidates = common.written(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"))
    queries = common.written(rows.where(F.col("vec_id") % every == 0))
    indexes = spark.sparkContext.broadcast(fitted(candidates, k, block, recall))
    both = common.mapped(candidates, _deal(indexes, False, every), _CELL).union(common.mapped(queries, _deal(indexes, True, every), _CELL))
    found = both.groupBy("dim", "curve", "block", "part").applyInArrow(_visit(k), "query_id long, vec_id long, low double, high double")
    # all curves' bounds together leave few vectors to look up
    once = found.groupBy("query_id", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    by_high = Window.partitionBy("query_id").orderBy("high", "vec_id")
    once = once.withColumn("n", F.row_number().over(by_high))
    limit = F.max(F.when(F.col("n") <= k, F.col("high"))).over(Window.partitionBy("query_id"))
    pairs = once.withColumn("limit", limit).where("low <= limit or isnan(low)").select("query_id", "vec_id")
    full = lambda df, name, out: df.select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias(out), F.col("dim").alias(f"{out}_dim"))
    met = pairs.join(full(candidates, "vec_id", "b").hint("merge"), "vec_id").join(full(queries, "query_id", "a").hint("merge"), "query_id")
    scored = met.where("a_dim = b_dim").select("query_id", "vec_id", _distance("a", "b").alias("score"))
    scored = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
