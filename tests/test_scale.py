"""What must hold whatever the number of partitions, of groups, or of rows of one key."""

import math
import os
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as settings_of
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import camera as C
from lumenfold.operators import anchors, brf, calibration, fusion, gains, neighbours, ordinals, ranks, raster, rays, selection, sight, tiles
from lumenfold.plans import queries
from lumenfold.plans.adapters import view
from lumenfold.sources import envi, placed, ply, stores, tables
from lumenfold.streaming import fusion as stream


@pytest.fixture()
def settings(spark):
    """Sets some of the session's settings for one test."""
    before = {}

    def put(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def of_files(spark, tmp_path, n, files, key):
    path = str(tmp_path / f"rows{files}")
    wide = [F.concat(F.lit("x"), F.col("id")).alias("text"), (F.col("id") * 0.5).alias("half")]
    spark.range(n).select("id", key.alias("k"), *wide).repartition(files).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions,files", [(8, 8), (200, 5)])
def test_numbers_are_contiguous(spark, tmp_path, settings, adaptive, partitions, files):
    settings(spark__sql__adaptive__enabled=adaptive, spark__sql__shuffle__partitions=str(partitions))
    n = 3_000_000 if (adaptive, partitions) == ("true", 8) else 300_000
    rows = of_files(spark, tmp_path, n, files, F.col("id") * 7919 % n)
    out = ordinals.numbered(rows, "k")
    written = str(tmp_path / "out")
    out.write.parquet(written)  # all columns
    for got in (spark.read.parquet(written), out.select("observation_id", "k")):  # and pruned ones
        r = got.agg(F.count("*"), F.min("observation_id"), F.max("observation_id"), F.count_if(F.col("observation_id") != F.col("k"))).first()
        assert tuple(r) == (n, 0, n - 1, 0)
    assert spark.read.parquet(written).where("text <> concat('x', id) or half <> id * 0.5").count() == 0


def test_one_key_for_all_rows(spark, tmp_path, settings):
    settings(spark__sql__shuffle__partitions="8")
    rows = of_files(spark, tmp_path, 400_000, 8, F.lit(1))
    placed = ordinals.placed(rows, "k")
    sizes = [r[1] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100_000
    r = ordinals.numbered(rows, "k").agg(F.count_distinct("observation_id"), F.max("observation_id")).first()
    assert tuple(r) == (400_000, 399_999)
    assert ordinals.numbered(rows.where("false"), "k").count() == 0


def test_matrix_of_many_files_is_whole(spark, tmp_path, settings):
    settings(spark__sql__shuffle__partitions="8")
    rows = of_files(spark, tmp_path, 200_000, 8, F.col("id")).select("k", F.array(F.col("k").cast("float") + 1).alias("v"))
    stores.write_matrix(rows, "v", "k", str(tmp_path / "m.npy"))
    assert (np.load(tmp_path / "m.npy")[:, 0] == np.arange(200_000, dtype="f4") + 1).all()


def test_ranks_of_many_groups_and_of_a_huge_one(spark, settings):
    settings(spark__sql__shuffle__partitions="6")
    r = np.random.default_rng(2)
    rows = [(g, float(x)) for g in range(300) for x in r.normal(size=g % 7)] + [(-1, float(x)) for x in r.integers(0, 50, 20_000)]
    rows += [(5, None), (5, float("nan")), (6, float("inf")), (-2, 1.0)]
    df = spark.createDataFrame(rows, "g long, x double").repartition(5)
    got = {r.g: (r.n, r.q) for r in ranks.Sorted(df, "x", "g").percentiles({"q": 0.3}).collect()}
    for g in {g for g, _ in rows}:
        x = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
        if x:
            assert got[g][0] == len(x) and (got[g][1] == pytest.approx(np.percentile(x, 30)) or math.isnan(got[g][1]) or math.isinf(got[g][1]))
        else:
            assert g not in got
    assert ranks.medians(df.where("g = -1"), "x", "g").first().median == np.median([v for k, v in rows if k == -1])


@pytest.mark.parametrize("most", [5, 100_000])
def test_ranks_among_infinite_and_great_values(spark, most):
    inf = float("inf")
    x = [-inf] * 3 + [-1.7e308, -1e308, -5.0, -1e-300, 0.0, 1e-300, 2.0, 2.0, 2.0, 1e308, 1.7e308] + [inf] * 2
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "x double").repartition(3)
    n, got = ranks.order_statistics(df, "x", range, most=most)[None]
    assert n == len(x) and [got[r] for r in range(n)] == sorted(x)


def cloud(spark, n, seed, low=-20.0, high=20.0):
    r = np.random.default_rng(seed)
    xyz = r.uniform(low, high, (n, 3))
    return xyz, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")


@pytest.mark.parametrize("few", [0, 200])
def test_tubes_meet_all_their_points(spark, monkeypatch, few):
    monkeypatch.setattr(rays, "BROADCAST_RAYS", few)
    xyz, points = cloud(spark, 3000, 1)
    r = np.random.default_rng(4)
    cams = [(i, *map(float, r.uniform(-40, 40, 3)), *map(float, r.normal(size=3))) for i in range(20)]
    cams += [(20, 0.0, 0.0, 30.0, 0.0, 0.0, -1.0), (21, -30.0, 1.0, 1.0, 1.0, 0.0, 0.0), (22, -30.0, -30.0, -30.0, 1.0, 1.0, 1.0)]
    scenes = spark.createDataFrame(cams, "scene_code long, cam_x double, cam_y double, cam_z double, fwd_x double, fwd_y double, fwd_z double")
    got = sorted((r.scene_code, round(r.along, 6)) for r in rays.tube(scenes, points, 1.5, 2.0, 60.0).collect())
    expected = []
    for s, *v in cams:
        cam, fwd = np.array(v[:3]), np.array(v[3:]) / np.linalg.norm(v[3:])
        along = (xyz - cam) @ fwd
        apart = ((xyz - cam) ** 2).sum(1) - along**2
        expected += [(s, round(a, 6)) for a, p in zip(along, apart) if 2.0 <= a <= 60.0 and p <= 2.25]
    assert got == sorted(expected) and len(got) > 50
    crossed = rays.voxels(scenes.withColumns({f"fwd_{c}": F.col(f"fwd_{c}") / F.sqrt(F.col("fwd_x") ** 2 + F.col("fwd_y") ** 2 + F.col("fwd_z") ** 2) for c in "xyz"}), 1.0, 1.0, 300.0, 2.0)
    assert crossed.groupBy("scene_code").count().agg(F.max("count")).first()[0] < 1500
    assert crossed.distinct().count() == crossed.count()
    assert rays.tube(scenes, points.where("false")).count() == 0


def test_first_hits(spark):
    xyz = [(0.0, 0.0, 30.0 - k / 10) for k in range(20)] + [(0.2, 0.1, 10.0 - k) for k in range(5)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    scenes = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 0.0, 0.0, -1.0), (2, 90.0, 0.0, 50.0, 0.0, 0.0, -1.0)], "scene_code long, cam_x double, cam_y double, cam_z double, fwd_x double, fwd_y double, fwd_z double")
    got = {r.scene_code: r for r in anchors.first_hits(scenes, points).collect()}
    along = sorted(50.0 - z for _, _, z in xyz)
    limit = np.percentile(along, 5) + 1
    assert got[1].hit_count == 25 and got[1].anchor_range == pytest.approx(np.median([a for a in along if a <= limit]))
    assert got[2].hit_count == 0 and got[2].anchor_range is None
    few = {r.scene_code: r for r in anchors.first_hits(scenes, points.where("point_id >= 14"), min_points=11).collect()}
    assert few[1].hit_count == 11 and few[1].anchor_range == pytest.approx(np.median(along[14:]))


def test_culling_loses_no_pair(spark):
    xyz, points = cloud(spark, 4000, 3, -60.0, 60.0)
    r = np.random.default_rng(9)
    cams = [(i, *map(float, r.uniform(-80, 80, 3)), *map(float, r.normal(size=3))) for i in range(25)]
    scenes = spark.createDataFrame(cams, "scene_code long, cam_x double, cam_y double, cam_z double, ax double, ay double, az double")
    scenes = C.with_frame(scenes, (F.col("ax"), F.col("ay"), F.col("az")))
    rows = tuple(tuple(F.col(f"r{i}{j}") for j in (1, 2, 3)) for i in (1, 2, 3))
    made = C.project((F.col("x"), F.col("y"), F.col("z")), (F.col("cam_x"), F.col("cam_y"), F.col("cam_z")), rows)
    whole = points.crossJoin(scenes).withColumns(made).where("inside and range_m <= 70").select("point_id", "scene_code")
    met = sight.pairs(points, scenes, 70.0)
    seen = met.withColumns(made).where("inside and range_m <= 70").select("point_id", "scene_code")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, whole.collect()))
    assert whole.count() <= met.count() < 0.25 * 4000 * 25


@pytest.mark.parametrize("centres,most", [(20_000, 256), (60, 5)])
def test_blockers(spark, monkeypatch, centres, most):
    monkeypatch.setattr(tiles, "CENTRES", centres)
    monkeypatch.setattr(tiles, "PAIRS", 700)
    xyz, points = cloud(spark, 900, 5, 0.0, 7.0)
    r = np.random.default_rng(6)
    views = [(int(i), s, *map(float, d / np.linalg.norm(d))) for i in r.choice(900, 300, replace=False) for s, d in enumerate(r.normal(size=(3, 3)))]
    views += [(10_000, 0, 0.0, 0.0, 1.0)]  # a point that isn't there
    df = spark.createDataFrame(views, "point_id long, scene_code long, dir_x double, dir_y double, dir_z double")
    got = {(r.point_id, r.scene_code): r for r in tiles.blockers(df, points, 1.2, most, 0.3).collect()}
    assert len(got) == len(views)
    hits = 0
    for i, s, *d in views:
        row = got[i, s]
        if i == 10_000:
            assert (row.n, row.blockers, row.fronts, row.c) == (0, 0, 0, None)
            continue
        rel = xyz - xyz[i]
        d2 = (rel * rel).sum(1)
        near = sorted((v, j) for j, v in enumerate(d2) if v < 1.44 and j != i)[:most]
        t = np.array([rel[j] @ d for _, j in near])
        v = np.array([x for x, _ in near])
        front = t > 0.08
        assert (row.n, row.fronts, row.blockers) == (len(near), front.sum(), (front & (np.maximum(v - t * t, 0) <= 0.09)).sum())
        assert row.c is None if not front.any() else abs(row.c - (t[front] / np.sqrt(v[front])).max()) < 1e-9
        hits += row.blockers
    assert hits > 20
    assert tiles.blockers(df.where("false"), points).count() == 0


def test_occlusion_without_neighbours_is_clear(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 50.0, 0.0, 0.0), (3, 50.0, 0.0, 0.5), (4, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    views = spark.createDataFrame([(p, 7, 0.0, 0.0, 1.0) for p in (1, 2, 4)], "point_id long, scene_code long, dir_x double, dir_y double, dir_z double")
    got = {r.point_id: r for r in neighbours.occlusion(views, points, min_neighbours=1).collect()}
    assert [(got[i].blocker_count, got[i].local_empty_cone_deg, got[i].tube_clear) for i in (1, 2, 4)] == [(0, 180.0, True), (1, 0.0, False), (0, 180.0, True)]


def test_depth_over_tiles(spark):
    r = np.random.default_rng(8)
    rows = [(i, int(s), float(u), float(v), float(z)) for i, (s, u, v, z) in enumerate(zip(r.integers(0, 2, 3000), r.uniform(-3, 600, 3000), r.uniform(-3, 70, 3000), r.uniform(10, 40, 3000)))]
    df = spark.createDataFrame([*rows, (9999, 0, None, 1.0, 5.0)], "point_id long, scene_code long, u double, v double, range_m double")
    got = {r.point_id: (r.near_m, r.zbuffer_clear) for r in selection.depth_clear(df).collect()}
    assert len(got) == 3000
    s, u, v, z = (np.array(c) for c in zip(*[r[1:] for r in rows]))
    iu, iv = np.rint(u), np.rint(v)
    for i in range(3000):
        near = z[(s == s[i]) & (abs(iu - iu[i]) <= 2) & (abs(iv - iv[i]) <= 2)].min()
        assert got[i] == (near, z[i] <= near + 0.8)


def test_a_hot_scene_is_sampled_by_many_tasks(spark, tmp_path, settings):
    settings(spark__sql__shuffle__partitions="6")
    band, line, sample = np.meshgrid(np.arange(1, 4), np.arange(300), np.arange(20), indexing="ij")
    envi.write_bands(str(tmp_path / "hot_REF.hdr"), 5, {b: (b + 2 * line[b - 1] + 3 * sample[b - 1]).astype("f4") for b in (1, 3)})
    views = spark.range(60_000).select(F.col("id").alias("observation_id"), F.lit("hot").alias("scene_id"), (F.col("id") % 19 + 0.25).alias("u"), F.lit(150.5).alias("v"))
    paths = spark.createDataFrame([("hot", str(tmp_path / "hot_REF.hdr"))], "scene_id string, header string")
    offsets = spark.createDataFrame([("hot", 0.0, 1.0)], "scene_id string, du double, dv double")
    got = raster.sampled(views, paths, [1, 3], offsets=offsets).withColumn("task", F.spark_partition_id())
    assert got.where("abs(spectrum[0] - (1 + 2 * 151.5 + 3 * u)) > 1e-6 or abs(spectrum[1] - spectrum[0] - 2) > 1e-6").count() == 0
    sizes = [r[1] for r in got.groupBy("task").count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 6 and max(sizes) < 20_000


def test_conditions_reach_the_image_source(spark, tmp_path, settings):
    settings(spark__sql__python__filterPushdown__enabled="false")
    for name in ("a", "b"):
        envi.write_cube(str(tmp_path / f"{name}_REF.hdr"), np.arange(6 * 40 * 3, dtype="f4").reshape(6, 40, 3))
    df = envi.scan(spark, str(tmp_path), 10)
    some = df.where("scene_id = 'b' and band in (2, 5) and line >= 15 and line < 18 and size(reflectance) = 3")
    assert sorted((r.scene_id, r.band, r.line, r.reflectance[0]) for r in some.collect()) == [("b", b, y, float(((b - 1) * 40 + y) * 3)) for b in (2, 5) for y in (15, 16, 17)]
    reader = envi._PushingReader({"path": str(tmp_path), "lines": "10"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

    assert list(reader.pushFilters([EqualTo(("scene_id",), "b"), In(("band",), (2, 5)), GreaterThanOrEqual(("line",), 15), EqualTo(("reflectance",), 1)])) == [EqualTo(("reflectance",), 1)]
    assert [(p.bands, p.first) for p in reader.partitions()] == [((1, 4), 10), ((1, 4), 20), ((1, 4), 30)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size(reflectance" in plan and "band#" not in plan.split("Filter (size(reflectance")[1].split("\n")[0]


@pytest.mark.parametrize("mode", ["softmax", "hybrid", "surface_adaptive"])
def test_stream_of_best_scores_is_the_batch(spark, sf, tmp_path, mode):
    keep = ["point_id", "scene_code", "visibility_score", "view_weight_raw", "range_m", "offaxis_deg", "border_dist_px", "view_zenith_deg", "surface_view_cos",
            "surface_verticality", "normal_confidence", "local_empty_cone_deg", "blocker_count", "is_clear", "b1", "b2"]
    views = view(spark, sf, "spectra").where("keep_for_fusion").select(*keep)
    for part in (0, 1, 2):  # scores rise and fall from batch to batch
        views.where(F.pmod(F.xxhash64("scene_code"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def write(df, _):
        seen.update({r.point_id: (r.views, r.entropy, r.b1, r.b2) for r in df.collect()})

    source = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    q = stream.start(source, ["b1", "b2"], write, str(tmp_path / "ck"), mode)
    q.processAllAvailable()
    q.stop()
    batch = fusion.fused(fusion.weighted(views, mode), ["b1", "b2"]).collect()
    assert len(seen) == len(batch)
    for r in batch:
        assert seen[r.point_id] == pytest.approx((r.views, r.entropy, r.b1, r.b2), abs=1e-9)


def test_gains_in_groups_of_bands(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = []
    for band in (1, 2, 3):
        point, scene = r.uniform(0.2, 0.8, 40), r.uniform(0.8, 1.25, 6)
        rows += [(band, p, s, float(point[p] / scene[s] * (1 + 0.01 * r.normal())), float(r.uniform(0.1, 1))) for p in range(40) for s in range(6) if r.random() < 0.7]
    long = spark.createDataFrame(rows, "band int, point_id long, scene_code long, value double, w double")
    fit = gains.fit_rows(long, trim=(0.0, 1.0), min_rows=10)

    def brute(band, iterations, tolerance):
        some = [x for x in rows if x[0] == band]
        p, s, y, w = (np.array([f(x) for x in some]) for f in (lambda x: x[1], lambda x: x[2], lambda x: math.log(x[3]), lambda x: x[4]))
        n = np.bincount(p)[p]
        p, s, y, w = p[n > 1], s[n > 1], y[n > 1], w[n > 1]
        e = np.zeros(6)
        for _ in range(iterations):
            pe = np.bincount(p, w * (y - e[s]), 40) / np.maximum(np.bincount(p, w, 40), 1e-300)
            sw = np.bincount(s, w, 6)
            new = np.bincount(s, w * (y - pe[p]), 6) / sw
            new -= (new * sw).sum() / sw.sum()
            moved, e = abs(new - e).max(), new
            if moved <= tolerance:
                break
        return np.clip(np.exp(-e), 0.5, 2.0)

    for most in (1_000_000, 7, 1):  # all bands together; one by one; effects joined by a shuffle
        monkeypatch.setattr(gains, "EFFECTS", most)
        got = {(r.band, r.scene_code): r.gain for r in gains.fitted(fit, 9, 1e-3, min_scene_rows=2).collect()}
        assert len(got) == 18
        for band in (1, 2, 3):
            assert [got[band, s] for s in range(6)] == pytest.approx(list(brute(band, 9, 1e-3)), abs=1e-12)
    assert {r.gain for r in gains.fitted(fit, min_scene_rows=1000).collect()} == {1.0}
    assert gains.fitted(fit.where("false")).count() == 0


def test_fit_rows_count_after_trimming_too(spark):
    long = spark.createDataFrame([(1, p, s, 0.3 + 0.001 * p, float("inf")) for p in range(50) for s in range(2)], "band int, point_id long, scene_code long, value double, w double")
    assert gains.fit_rows(long, trim=(0.1, 0.9), min_rows=95).count() == 0  # 100 before, 80 after
    kept = gains.fit_rows(long, trim=(0.1, 0.9), min_rows=80)
    assert kept.count() == 80 and kept.where("w <> 1").count() == 0


def test_indices_after_gains(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4, 0.5, 9.0, 9.0, 9.0, 9.0), (2, 0.1, 0.2, 0.3, 0.4, 0.5, 9.0, 9.0, 9.0, 9.0)], "scene_code long, g double, r double, e double, n1 double, n2 double, i1 double, i2 double, i3 double, i4 double")
    table = spark.createDataFrame([(51, 1, 2.0)], "band int, scene_code long, gain double")
    nm = [400.0 + 3 * i for i in range(1, 169)]
    at = {"g": 50, "r": 90, "e": 106, "n1": 134, "n2": 150, "i1": 165, "i2": 166, "i3": 167, "i4": 168}  # nearest to the wavelengths
    got = {r.scene_code: r for r in gains.corrected(df, table, {"g": 51}, nm, at).collect()}
    assert got[1].g == 0.2 and got[1].i4 == pytest.approx((0.2 - 0.5) / 0.7) and got[2].i4 == pytest.approx((0.1 - 0.5) / 0.6)
    assert got[2].i1 == pytest.approx(0.3 / 0.7) and got[1].i2 == pytest.approx(0.4 / 0.3)
    assert gains.corrected(df, table, {"g": 51}, nm, {"g": 51, "i1": 165}).first().i1 == 9.0
    with pytest.raises(ValueError):
        gains.corrected(df, table, {"g": 51}, nm, {c: n for c, n in at.items() if c != "e"})


def test_offsets_are_finite(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, inf, 0.0), ("a", 3, None, 0.0), ("b", 1, 0.0, -inf), ("c", 1, float("nan"), 1.0)], "scene_id string, _row long, offset_u_px double, offset_v_px double")
    assert [tuple(r) for r in tables.offsets(df).collect()] == [("a", 1.0, 2.0)]


def test_solver_refuses_what_it_cannot_see(spark, sf):
    marks = queries.calibration_marks(spark, sf).where("status = 'full'").limit(3)
    broken = marks.withColumn("u_top", F.lit(None).cast("double")).union(marks.withColumn("top", F.lit(None).cast("array<double>")))
    broken = broken.union(marks.withColumn("status", F.lit("odd"))).union(marks.withColumn("status", F.lit(None).cast("string")))
    got = calibration.corrections(broken, C.intrinsics(1886, 1886, 35.0, 35.0)).collect()
    assert len(got) == 12 and not any(r.success for r in got) and all(r.angle_deg == 0 and r.r_corr == [1, 0, 0, 0, 1, 0, 0, 0, 1] and r.note for r in got)
    log = calibration.correction_log(calibration.corrections(marks, C.intrinsics(1886, 1886, 35.0, 35.0), 2.5))
    assert log.columns[:18] == ["scene_id", "annotation_status", *calibration._ERRORS, "rx_deg", "ry_deg", "rz_deg", "rotation_total_deg", "solver_dof", "clipped_by_max_angle", "success", "note"][:18]
    for r in log.collect():
        assert r.rotation_total_deg <= 2.5 + 1e-9 and r.clipped_by_max_angle == (int(r.scene_id.split("#")[-1]) % 3 > 0)


def test_store_is_made_anew_for_another_source(spark, tmp_path):
    points = spark.range(3).withColumnRenamed("id", "point_id")
    kept = spark.createDataFrame([(0, 0, 5, 1.5), (0, 1, 6, 0.5)], "point_id long, slot int, scene_code long, coarse_score double")
    calls = []

    def make():
        calls.append(1)
        return kept

    for source in ({"size": 1}, {"size": 1}, {"size": 2}):
        got = stores.candidates_of(stores.stored_candidates(make, points, 2, str(tmp_path / "s"), source))
        assert sorted((r.point_id, r.slot, r.scene_code, r.score, r.is_backlit) for r in got.collect()) == [(0, 0, 5, 1.5, -1), (0, 1, 6, 0.5, -1)]
    assert len(calls) == 2 and len(stores.CANDIDATE_FIELDS) == 26


def test_table_columns(spark, sf):
    assert len(brf.PAPER_COLUMNS) == 34
    rows = queries.QUERIES["q_brf_table"].spark(spark, sf)
    assert set(rows.columns) == set(brf.PAPER_COLUMNS)
    with pytest.raises(ValueError):
        brf.paper_columns(spark.range(1), whole=True)


def test_placed_files_are_whole_or_not_there(spark, tmp_path, settings):
    settings(spark__sql__shuffle__partitions="5")
    rows = of_files(spark, tmp_path, 20_000, 4, F.col("id") * 7919 % 20_000).select("k", (F.col("k") * 3).alias("a"), (F.col("k") / 4).alias("b"))
    path = str(tmp_path / "x.npz")
    assert stores.write_arrays(rows, "k", path, {"a": "<i8", "b": "<f4"}) == 20_000
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None  # checksums too
    with np.load(path) as z:
        assert (z["a"] == np.arange(20_000) * 3).all() and (z["b"] == np.arange(20_000, dtype="f4") / 4).all() and z["b"].dtype == "f4"
    back = stores.read_arrays(spark, path, 3000)
    assert back.where("name = 'a' and value <> row * 3").count() == 0 and back.count() == 40_000
    fail = F.udf(lambda k: 1.0 / (k - 11_111), "double")
    for write in (lambda df: stores.write_arrays(df, "k", str(tmp_path / "y.npz"), {"b": "<f8"}), lambda df: stores.write_matrix(df.select("k", F.array("b").alias("v")), "v", "k", str(tmp_path / "y.npy")),
                  lambda df: ply.write(df, str(tmp_path / "y.ply"), "k")):
        with pytest.raises(Exception):
            write(rows.select("k", fail("k").alias("b")))
        assert not [f for f in os.listdir(tmp_path) if f.startswith("y.")]
    stores.write_arrays(rows.where("false"), "k", str(tmp_path / "none.npz"), {"a": "<i8"})
    with np.load(tmp_path / "none.npz") as z:
        assert z["a"].shape == (0,)
    ply.write(rows.select("k", F.col("a").cast("int").alias("a"), "b"), str(tmp_path / "p.ply"), "k")
    spark.dataSource.register(ply.PlySource)
    got = spark.read.format("ply").option("path", str(tmp_path / "p.ply")).option("rows", "7000").load()
    assert got.count() == 20_000 and got.where("a <> point_id * 3 or b <> point_id / 4").count() == 0


def test_a_writer_that_lacks_rows_leaves_nothing(tmp_path):
    part = tmp_path / "m.part"
    part.write_bytes(b"xx")
    w = placed._Writer({"path": str(tmp_path / "m"), "part": str(part), "rows": "2", "streams": "[]"})
    with pytest.raises(ValueError):
        w.commit([placed._Done(1, []), None])
    assert os.listdir(tmp_path) == []


@settings_of(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_checksums(a, b):
    assert placed.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
