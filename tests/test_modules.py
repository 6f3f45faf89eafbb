"""Sources, rasters, solvers, streams and products on small made-up inputs."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import camera as C
from lumenfold.functions import mapgrid, scoring, spectral
from lumenfold.functions.vectors import clip01, length, product, rotation, unit, vec
from lumenfold.operators import anchors, brf, calibration, candidates, export, fusion, gains, neighbours, ordinals, raster, rays, selection, sight, tiles
from lumenfold.plans import queries
from lumenfold.plans.adapters import view
from lumenfold.sources import envi, ply, stores, tables
from lumenfold.streaming import fusion as stream


@pytest.fixture(scope="module")
def cubes(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cubes")
    band, line, sample = np.meshgrid(np.arange(168), np.arange(64), np.arange(64), indexing="ij")
    ramp = (band + 2 * line + 3 * sample).astype("f4")
    envi.write_cube(str(folder / "one_REF.hdr"), ramp, [400.0 + i for i in range(168)])
    envi.write_cube(str(folder / "two_ref.hdr"), (ramp * 2).astype(">u2"), offset=128, scale=2.0)
    (folder / "other.hdr").write_text("samples = 1")
    return folder


def test_cube_source(spark, cubes):
    spark.dataSource.register(envi.EnviSource)
    df = spark.read.format("envi").option("path", str(cubes)).option("lines", "10").load()
    assert df.count() == 2 * 168 * 64
    for scene in ("one", "two"):
        row = df.where((F.col("scene_id") == scene) & (F.col("band") == 5) & (F.col("line") == 7)).first()
        assert row.reflectance == [4 + 14 + 3 * i for i in range(64)]


def test_cube_files(cubes, tmp_path):
    assert [h.rsplit("/", 1)[1] for h in envi.headers(str(cubes))] == ["one_REF.hdr", "two_ref.hdr"]
    h = envi.parse_header("ENVI\nsamples = 3\nWavelength = {\n 400.5, 410,\n x, }\nname = a b\nscale = 1e4\n")
    assert h == {"samples": 3, "wavelength": [400.5, 410, "x"], "name": "a b", "scale": 1e4}
    assert envi.wavelengths(h) == [400.5, 410.0]
    envi.write_cube(str(tmp_path / "bad.hdr"), np.zeros((2, 3, 4), "i2"))
    with open(tmp_path / "bad.dat", "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(ValueError):
        envi.cube(str(tmp_path / "bad.hdr"))
    with pytest.raises(FileNotFoundError):
        envi.data_file(str(tmp_path / "none.hdr"))


def test_sampling(spark, cubes):
    views = spark.createDataFrame([(i, s, 30.25 + i % 3, 31.5 + i % 2) for i in range(12) for s in ("one", "two", "three")], "observation_id long, scene_id string, u double, v double")
    paths = spark.createDataFrame([("one", str(cubes / "one_REF.hdr")), ("two", str(cubes / "two_ref.hdr"))], "scene_id string, header string")
    bands = [1, 10, 165, 166]
    for method, settings in (("bilinear", {}), ("gaussian", {}), ("patch", {"radius": 1, "sampling": "bilinear"})):
        assert raster.sampled(views, paths, bands, method, strip=16, **settings).where("scene_id = 'three'").count() == 0
        got = raster.sampled(views, paths, bands, method, strip=16, unknown="null", **settings).collect()
        assert len(got) == 36
        for r in got:
            if r.scene_id == "three":
                assert r.spectrum is None
            else:
                flat = 2 * r.v + 3 * r.u
                assert np.allclose(r.spectrum, [flat, 9 + flat, 163 + flat, 165 + flat], atol=1e-6)
    audit = raster.audited(raster.sampled(views, paths, bands, unknown="null")).first()
    assert (audit.n, audit.missing, audit.not_finite) == (36, 12, 0)


def test_patches():
    plane = np.arange(25.0).reshape(1, 5, 5)
    plane[0, 2, 3] = np.nan
    whole = raster.patch(plane, [2.0], [2.0], radius=1, reducer="mean")
    assert np.isclose(whole[0, 0], np.nanmean(plane[0, 1:4, 1:4]))
    assert np.isclose(raster.patch(plane, [2.0], [2.0], 1, reducer="median")[0, 0], np.nanmedian(plane[0, 1:4, 1:4]))
    assert np.isnan(raster.patch(plane, [50.0], [50.0], 1)[0, 0])
    k = raster.gaussian_kernel()
    assert len(k) == 49 and np.isclose(k.sum(), 1)
    assert np.allclose(raster.gaussian(np.full((60, 60), 3.0)), 3.0)


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_source(spark, tmp_path, kind):
    rows = [(0.5, 1.5, -2.0, 7), (3.0, 4.0, 5.0, 200)]
    head = f"ply\nformat {kind} 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty float z\nproperty uchar red\nelement face 0\nend_header\n"
    order = ">" if "big" in kind else "<"
    body = "\n".join(" ".join(map(str, r)) for r in rows).encode() if kind == "ascii" else np.array(rows, [("x", order + "f8"), ("y", order + "f8"), ("z", order + "f4"), ("red", "u1")]).tobytes()
    path = tmp_path / "p.ply"
    path.write_bytes(head.encode() + body)
    spark.dataSource.register(ply.PlySource)
    got = spark.read.format("ply").option("path", str(path)).option("rows", "1").load().orderBy("point_id").collect()
    assert [tuple(r) for r in got] == [(i, *r) for i, r in enumerate(rows)]


def test_ply_round_trip(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 1.5).alias("x"), F.col("id").cast("float").alias("b1"), (F.col("id") % 7).cast("int").alias("k")).repartition(7)
    assert ply.write(df, str(tmp_path / "o.ply"), "id") == 1000
    spark.dataSource.register(ply.PlySource)
    got = spark.read.format("ply").option("path", str(tmp_path / "o.ply")).load().orderBy("point_id").collect()
    assert [tuple(r) for r in got] == [(i, i * 1.5, float(i), i % 7) for i in range(1000)]
    with pytest.raises(ValueError):
        ply.write(df.withColumn("big", F.col("id")), str(tmp_path / "x.ply"), "id")


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿scene_id,Gain (x)\ns1,1.5\ns2,\n".encode())
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    got = tables.resolve(df, {"scene_id": ["Scene_ID"], "gain": ["gain(X)", "g"], "other": ["none"]}, ("scene_id",)).collect()
    assert [(r.scene_id, r.gain, r.other) for r in got] == [("s1", 1.5, None), ("s2", None, None)]
    with pytest.raises(ValueError):
        tables.resolve(df, {"x": ["x"]}, ("x",))
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>#Label</t></si><si><t>v</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>9</v></c></row></sheetData></worksheet>')
    rows = tables.read_table(spark, str(tmp_path / "t.xlsx")).collect()
    assert [tuple(r) for r in rows] == [("ab", None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.pkl"))


def test_configuration(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 2}, "_note": 1, "k": [1]}))
    (tmp_path / "run.json").write_text(json.dumps({"base_config": "base.json", "overrides": {"a": {"y": 3}, "k": [2]}, "a": {"z": 4}}))
    assert tables.load_config(str(tmp_path / "run.json")) == {"a": {"x": 1, "y": 3, "z": 4}, "k": [2]}
    assert tables.output_folder("/o", "/in/a:b?.ply", "all") == "/o/a_b__allbands"
    with pytest.raises(ValueError):
        tables.output_folder("/o", "a", "some")


def test_small_tables(spark):
    nan = float("nan")
    o = spark.createDataFrame([("s", 1.0, 1.0, 0), ("s", 2.0, 3.0, 1), ("s", nan, 1.0, 2), ("t", None, 1.0, 0)], "scene_id string, offset_u_px double, offset_v_px double, _row int")
    assert [tuple(r) for r in tables.offsets(o).collect()] == [("s", 2.0, 3.0)]
    b = spark.createDataFrame([(0, None, 400.0), (1, 9, None)], "_row int, band_number int, wavelength_nm double")
    assert [tuple(r) for r in tables.band_metadata(b, 2).collect()] == [(1, 0, 400.0), (9, 1, None)]
    with pytest.raises(ValueError):
        tables.band_metadata(b, 1)
    g = spark.createDataFrame([("s", "1", "1.5"), ("s", "2", "x"), ("t", "3", "0")], "scene_id string, band_number string, gain string")
    assert [tuple(r) for r in tables.gain_table(g, [1, 2]).collect()] == [("s", 1, 1.5)]


def test_band_specs():
    assert spectral.parse_bands("1:3,7", 10) == [1, 2, 3, 7]
    with pytest.raises(ValueError):
        spectral.parse_bands("0:3", 10)
    with pytest.raises(ValueError):
        spectral.parse_bands("", 10)
    assert spectral.select_bands([400.0, 500.0, 600.0], targets=[590.0, 610.0, 410.0]) == [1, 3]
    assert spectral.nearest_band([400.0, None, 503.0], 500.0, 9) == 3 and spectral.nearest_band([400.0], 500.0, 9) == 9
    assert export.rgb_bands([26, 51, 76]) == (76, 51, 26) and export.rgb_bands([1]) is None
    assert math.isclose(spectral.gaussian_support()["fwhm_m"], 8 * 0.06125232 * 2.35482)


def test_vectors(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 90.0), (1.0, 2.0, -2.0, 33.0), (0.0, 0.0, 0.0, 45.0)], "x double, y double, z double, a double")
    r = rotation(vec("x", "y", "z"), F.col("a"))
    m = product(r, tuple(zip(*r)))
    got = df.select(*[c.alias(f"m{i}{j}") for i, row in enumerate(m) for j, c in enumerate(row)], length(unit(vec("x", "y", "z"), (0.0, 0.0, 1.0))).alias("n")).collect()
    for row in got:
        assert np.allclose(list(row)[:9], np.eye(3).ravel()) and math.isclose(row.n, 1)
    assert math.isnan(df.select(clip01(F.lit(float("nan"))).alias("c")).first().c)
    straight = C.with_frame(df.limit(1), vec(0.0, 0.0, -1.0)).first()
    assert np.allclose(np.abs(np.linalg.det(np.array(list(straight)[4:]).reshape(3, 3))), 1)


def test_grid(spark):
    """On the central meridian the northing is the meridian's arc; elsewhere the map is conformal."""
    a, f = mapgrid.AXIS, mapgrid.FLATTENING
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(26.3), 200_001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    e, n = mapgrid.grid(F.col("lon"), F.col("lat"), 114.0, 500_000.0)
    d = 1e-6
    rows = spark.createDataFrame([(114.0, 26.3), (115.2, 26.3), (115.2 + d, 26.3), (115.2, 26.3 + d)], "lon double, lat double").select(e.alias("e"), n.alias("n")).collect()
    assert math.isclose(rows[0].e, 500_000) and abs(rows[0].n - arc) < 1e-3
    east, north = (np.array([rows[i].e - rows[1].e, rows[i].n - rows[1].n]) for i in (2, 3))
    s = math.sin(math.radians(26.3))
    across = a * math.cos(math.radians(26.3)) / math.sqrt(1 - e2 * s * s)
    along = a * (1 - e2) / (1 - e2 * s * s) ** 1.5
    assert abs(east @ north) / (np.linalg.norm(east) * np.linalg.norm(north)) < 1e-4
    assert math.isclose(np.linalg.norm(east) / across, np.linalg.norm(north) / along, rel_tol=1e-4)
    x, y = mapgrid.adjusted(F.lit(1.0), F.lit(38_000_002.0), swap_xy=True, x_zone=38, y_offset=5.0)
    assert tuple(spark.range(1).select(x, y).first()) == (2.0, 6.0)


def test_known_rotations(spark, sf):
    marks = queries.calibration_marks(spark, sf)
    got = calibration.corrections(marks, C.intrinsics(1886, 1886, 35.0, 35.0)).collect()
    assert {r.status for r in got} >= {"full", "top_only", "base_only"}
    for r in got:
        assert r.success
        if r.status == "full":
            number = int(r.scene_id.rstrip().split("#")[-1])
            assert abs(r.angle_deg - (2 + number % 3)) < 1e-4
        if r.status != "none":
            assert r.post_error < 1e-4 < r.pre_error
    gate = calibration.quality_gate(spark.createDataFrame([("full", True, False, 3.0)], "status string, success boolean, clipped boolean, angle_deg double")).first()
    assert gate.passed and gate.solved == 1


def test_planted_gains(spark):
    rng = np.random.default_rng(3)
    true = [0.8, 0.9, 1.0, 1.1, 1.25, 1.0]
    point = rng.uniform(0.2, 0.8, 50)
    rows = [(1, p, s, float(point[p] / true[s]), 1.0) for p in range(50) for s in range(6)]
    rows += [(2, p, s, float(point[p]), 1.0) for p in range(50) for s in range(6)]
    long = spark.createDataFrame(rows, "band int, point_id long, scene_code long, value double, w double")
    fit = gains.fit_rows(long, trim=(0.0, 1.0), min_rows=10)
    got = {(r.band, r.scene_code): r.gain for r in gains.fitted(fit, min_scene_rows=2).collect()}
    mean = math.exp(np.mean(np.log(true)))
    for s, t in enumerate(true):
        assert abs(got[1, s] - t / mean) < 1e-4 and abs(got[2, s] - 1) < 1e-9
    assert gains.fit_rows(long, min_rows=10_000).count() == 0


def test_normals_of_a_plane(spark):
    rows = [(i * 20 + j, i * 0.1, j * 0.1, 1.0) for i in range(20) for j in range(20)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    n = neighbours.normals(neighbours.moments(neighbours.nearest(points, 0.5, 30, with_self=True)))
    assert n.where("abs(nz - 1) > 1e-9 or verticality > 1e-9 or confidence < 1 - 1e-9").count() == 0
    near = neighbours.pairs(points, 0.25).count()
    xyz = np.array([r[1:] for r in rows])
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    assert near == ((d2 < 0.0625) & ~np.eye(400, dtype=bool)).sum()


def test_weights(spark, sf):
    views = view(spark, sf, "spectra").where("keep_for_fusion")
    for mode in scoring.MODES:
        w = fusion.weighted(views, mode)
        assert w.groupBy("point_id").agg(F.sum("w").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    f = fusion.fused(fusion.weighted(views), ["b1"])
    assert f.where("entropy > ln(views) + 1e-9 or (clear_ratio > 1e-9 and clear_ratio < 1 - 1e-9)").count() == 0
    odd = views.limit(1).withColumn("visibility_score", F.lit(float("nan")))
    assert fusion.weighted(odd).count() == 0
    assert fusion.weighted(views.select("point_id", "scene_code"), "raw").count() == views.count()


def test_ids_are_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = ordinals.numbered(df, "k").collect()
    assert all(r.observation_id == r.k for r in got) and len(got) == 1000


def test_stream_is_the_batch(spark, sf, tmp_path):
    views = view(spark, sf, "spectra").select("point_id", "view_weight_raw", "b1", "b2")
    views.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = {}

    def write(df, _):
        seen.update({r.point_id: (r.views, round(r.b1, 9), round(r.b2, 9)) for r in df.collect()})

    source = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    q = stream.start(source, ["b1", "b2"], write, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    expected = {r.point_id: (r.views, round(r.b1, 9), round(r.b2, 9)) for r in stream.running(views, ["b1", "b2"]).collect()}
    assert seen == expected


def test_products(spark, tmp_path, sf):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(101)], "a double, b double")
    rows = export.stretched(df, ["a", "b"], 0.0, 1.0).collect()
    assert rows[0].a_u8 == 0 and rows[100].a_u8 == 255 and rows[50].a_u8 == 128 and rows[0].b_u8 == 0
    export.manifest(str(tmp_path / "m.json"), {"x": df, "y": df}, ["x", "y"])
    assert json.loads((tmp_path / "m.json").read_text())["rows"] == {"x": 101, "y": 101}
    with pytest.raises(ValueError):
        export.manifest(str(tmp_path / "m.json"), {"x": df, "y": df.limit(1)}, ["x", "y"])
    points = view(spark, sf, "points")
    with pytest.raises(ValueError):
        anchors.target_points(points, {"x": (-5.0, -4.0)})
    assert anchors.target_points(points, {"x": (0.0, 10.0)}).count() == points.count()
    same = raster.reproduced(points.select("point_id", "x"), points.select("point_id", "x"), "x").first()
    assert same.same and same.max_diff == 0
    kept = spark.createDataFrame([(1, 0), (1, 1), (2, 3)], "point_id long, slot int")
    assert [r.point_id for r in candidates.detected(kept, 2).collect()] == [1]


def test_documents_and_corrections(spark, sf):
    from lumenfold.operators import scenes

    cams = queries._cams(spark, sf).withColumn("width", F.lit(1886))
    docs = scenes.document(cams)
    back = scenes.from_json(scenes.as_json(docs), docs.schema["meta"].dataType)
    a, b = ({r.scene_id: r.meta for r in x.collect()} for x in (docs, back))
    assert a == b
    solved = calibration.corrections(queries.calibration_marks(spark, sf), C.intrinsics(1886, 1886, 35.0, 35.0))
    angle = {r.scene_id: (r.status, r.angle_deg) for r in solved.collect()}
    for r in calibration.applied(cams, solved).collect():
        o, c = (np.array([[r[f"{p}{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)]) for p in ("r", "c"))
        turned = math.degrees(math.acos(min(1.0, (np.trace(c @ o.T) - 1) / 2)))
        assert abs(turned - angle[r.scene_id][1]) < 1e-3


def test_repair(spark):
    from lumenfold.operators import scenes

    s = spark.createDataFrame([("a", 1, None), ("b", 2, 3)], "scene_id string, samples int, lines int")
    m = spark.createDataFrame([("a", 7, 8), ("b", 9, 9)], "scene_id string, samples int, lines int")
    assert sorted(map(tuple, scenes.repaired(s, m, ["samples", "lines"]).collect())) == [("a", 7, 8), ("b", 2, 3)]
    assert sorted(map(tuple, scenes.repaired(s.drop("lines"), m, ["samples", "lines"]).collect())) == [("a", 7, 8), ("b", 9, 9)]


def test_anchor_chain(spark):
    rows = [("hit", 5.0, 1.0, 1.0, 0.0, -1.0), ("mark", None, 2.0, 3.0, 0.0, -1.0), ("ray", None, None, None, 0.0, -1.0), ("none", None, None, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "scene_id string, anchor_range double, target_x double, target_y double, fwd_x double, fwd_z double")
    df = df.withColumns({"fwd_y": F.lit(0.0), "cam_x": F.lit(0.0), "cam_y": F.lit(0.0), "cam_z": F.lit(10.0)})
    ground = spark.createDataFrame([(1.0,)], "ground_z double")
    got = {r.scene_id: (r.anchor_source, r.anchor_x, r.anchor_z) for r in anchors.resolved(df, ground, fallback="bref_target_xy").collect()}
    assert got == {
        "hit": ("first_hit_pointcloud", 0.0, 5.0), "mark": ("fallback_bref_target_xy", 2.0, 1.0),
        "ray": ("fallback_ray_ground_intersection", 0.0, 1.0), "none": ("none", None, None),
    }
    got = {r.scene_id: (r.anchor_source, round(r.fwd_x, 6)) for r in anchors.resolved(df, ground, method="bref_target_xy", aim=True).collect()}
    assert got["hit"] == ("bref_target_xy", round(1 / math.sqrt(83), 6)) and got["ray"] == ("ray_ground_intersection", 0.0) and got["none"][0] == "none"


def test_written_products(spark, tmp_path):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(2.0)).alias("spectrum")).repartition(4)
    assert stores.write_matrix(df, "spectrum", "id", str(tmp_path / "m.npy")) == (50, 2)
    assert (np.load(tmp_path / "m.npy")[:, 0] == np.arange(50)).all()
    (tmp_path / "p.png").write_bytes(export.png(np.zeros((4, 6, 3), np.uint8)))
    assert (tmp_path / "p.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    tables.write_table(df.select("id"), str(tmp_path / "o.csv"))
    tables.write_table(df.select("id"), str(tmp_path / "o.csv"), append=True)
    assert tables.read_table(spark, str(tmp_path / "o.csv")).count() == 100
    raw = spark.createDataFrame([("1", "x", "HIGH", None), (None, "2", "low", "1")], "point_id string, view_weight_raw string, brf_quality_level string, other string")
    assert [tuple(r) for r in tables.observation_bundle(raw, ["point_id", "view_weight_raw"]).collect()] == [(1, 1.0, "high", None)]
    with pytest.raises(ValueError):
        tables.observation_bundle(raw, ["u"])
