"""Exact ranks, neighbours without a radius, stores and their refusals."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import mapgrid, spectral
from lumenfold.operators import anchors, export, neighbours, ranks, raster, scenes, sight
from lumenfold.sources import ply, shared, stores


@pytest.mark.parametrize("most", [1 << 18, 40, 1])
def test_percentiles(spark, most):
    r = np.random.default_rng(3)
    groups = {"a": r.standard_normal(700), "b": np.repeat([1.0, 2.0, 5.0], [300, 5, 1]), "c": np.array([7.5]), "d": 1e9 * r.random(99)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("e", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.01, 0.37, 0.5, 0.999, 1.0]
    got = ranks.percentiles(df, "x", shares, "g", most)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, shares), rtol=1e-12)
    assert ranks.percentiles(df.where("false"), "x", [0.5]) == {}
    n, at = ranks.order_statistics(df, "x", lambda n: [0, n // 2, n - 1, n], None, most)[None]
    whole = np.sort(np.concatenate(list(groups.values())))
    assert at == {0: whole[0], n // 2: whole[n // 2], n - 1: whole[-1]}


def test_stretch_of_unknown_and_flat_values(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, float("nan"), None)], "a double, b double, c double")
    got = [tuple(r) for r in export.stretched(df, ["a", "b", "c"]).select("a_u8", "b_u8", "c_u8").collect()]
    assert got == [(0, 0, 0), (255, 0, 0), (0, 0, 0)]


def test_every_point_has_its_nearest(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.random((60, 3)), [[50.0, 0, 0], [50.0, 0, 0], [400.0, 300, 9]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double")
    got = {}
    for row in neighbours.k_nearest(df, 9, 0.2).collect():
        got.setdefault(row.point_id, {})[row.nth] = row.other_id
    for i, p in enumerate(x):
        order = np.lexsort((np.arange(len(x)), ((x - p) ** 2).sum(axis=1)))
        assert [got[i][n] for n in range(1, 10)] == order[:9].tolist()
    assert neighbours.k_nearest(df.limit(3), 9, 0.2).count() == 9
    normals = neighbours.prepared_normals(df.where("point_id >= 60"), 4, 1.0).collect()
    assert len(normals) == 3 and all(r.source == "pca" and 0 <= r.confidence <= 1 for r in normals)
    alone = neighbours.prepared_normals(df.limit(1), 4, 1.0).collect()
    assert len(alone) == 1 and alone[0].confidence == 0
    assert neighbours.k_nearest(df.where("false"), 4, 1.0).count() == 0


def test_scenes_in_reach(spark):
    points = spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in enumerate((-301, -1, 0, 299, 650, 900))], "point_id long, x double, y double, z double")
    cams = spark.createDataFrame([(0, 0.0, 0.0), (1, 600.0, 0.0)], "scene_code long, cam_x double, cam_y double")
    met = {(r.point_id, r.scene_code) for r in sight.near_scenes(points, cams, 300.0).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)} <= met


def test_one_csv_file(spark, tmp_path):
    path = str(tmp_path / "o.csv")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    stores.append_csv(df, path)
    stores.append_csv(df, path)
    raw = (tmp_path / "o.csv").read_bytes()
    assert raw.startswith("\ufeffk,t\n".encode()) and raw.count(b"k,t") == 1
    assert sorted(r.k for r in stores.scan_csv(spark, path, {"k": "long"}).collect()) == [1, 1, 2, 2]
    assert [r.t for r in stores.scan_csv(spark, path, {"t": "int"}).collect()] == [None] * 4
    with pytest.raises(ValueError):
        stores.scan_csv(spark, path, {"x": "long"})


def test_refusals(spark, tmp_path):
    two = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i long, v array<double>")
    with pytest.raises(ValueError):
        stores.write_matrix(two, "v", "i", str(tmp_path / "a.npy"))
    with pytest.raises(ValueError):
        stores.write_matrix(two.where("i = 0").union(two.where("i = 0")), "v", "i", str(tmp_path / "b.npy"), rows=1)
    with pytest.raises(ValueError):
        stores.zipped(two, two.limit(1), ["i"], ["i"])
    with pytest.raises(ValueError):
        stores.inferred_rows(spark, [None, 0])
    with pytest.raises(ValueError):
        stores.catalogue(json.dumps([{"name": "x"}]))
    with pytest.raises(ValueError):
        mapgrid.system(4326)
    with pytest.raises(ValueError):
        anchors.choose_grid(two, two, [], "none")
    with pytest.raises(ValueError):
        raster.finite_or_abort(spark.createDataFrame([([float("nan")],)], "spectrum array<double>"))
    kept = spark.createDataFrame([], "point_id long, slot int, " + ", ".join(f"{n} double" for n in stores.CANDIDATE_FIELDS))
    path = shared.new_path(spark)
    stores.store_candidates(kept, two.withColumnRenamed("i", "point_id"), 3, path)
    assert stores.candidates_of(stores.open_candidates(spark, path)).count() == 0
    stores.save_text(spark, path + "/manifest.json", json.dumps({"points": 2, "slots": 4, "fields": dict.fromkeys(stores.CANDIDATE_FIELDS)}))
    with pytest.raises(ValueError):
        stores.open_candidates(spark, path)


def test_unsigned_colours(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 200, 0, 255)], "point_id long, x double, y double, z double, r int, g int, b int")
    table, types = ply.assembled(p, rgb=("r", "g", "b"))
    ply.write(table, str(tmp_path / "c.ply"), "point_id", types)
    assert ply.header(str(tmp_path / "c.ply"))[2] == [("x", "f8"), ("y", "f8"), ("z", "f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]
    spark.dataSource.register(ply.PlySource)
    assert [tuple(r) for r in spark.read.format("ply").option("path", str(tmp_path / "c.ply")).load().collect()] == [(0, 1.0, 2.0, 3.0, 200, 0, 255)]


def test_grid_by_another_series(spark):
    """Redfearn's series in powers of the difference of longitude, and the arc of the meridian."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    for lon, lat in ((114.3, 26.0), (113.2, 40.5), (115.0, 3.0)):
        phi, w = math.radians(lat), math.radians(lon - 114.0)
        steps = 20_000
        arc = sum(a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5 for p in ((i + 0.5) * phi / steps for i in range(steps))) * phi / steps
        nu = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        psi = nu / (a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5)
        c, t = math.cos(phi), math.tan(phi)
        east = nu * w * c * (1 + w**2 / 6 * c**2 * (psi - t**2) + w**4 / 120 * c**4 * (4 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 + 8 * t**2) - 2 * psi * t**2 + t**4))
        north = arc + nu * math.sin(phi) * w**2 / 2 * c * (1 + w**2 / 12 * c**2 * (4 * psi**2 + psi - t**2))
        x, y = mapgrid.grid(F.lit(lon), F.lit(lat), *mapgrid.system(4547))
        got = spark.range(1).select(x, y).first()
        assert abs(got[0] - 500_000 - east) < 1e-3 and abs(got[1] - north) < 1e-2


def test_pieces(spark):
    assert mapgrid.SYSTEMS == {4547: (114, 500_000.0), 4526: (114, 38_500_000.0)}
    assert spectral.directional_bands([5, 2], [9, 2, 0], 8) == [2, 5]
    assert np.allclose(raster.patch_offsets(3, 0)[2], raster.patch_offsets(3, 1.5)[2])
    df = spark.createDataFrame([("s10",), ("s2",), ("x",), ("s2",)], "scene_id string")
    assert {r.scene_id: r.code for r in scenes.factorized(df).collect()} == {"s2": 0, "s10": 1, "x": 2}
    bins = spark.createDataFrame([("a", "v", i, i * 5.0, i * 5.0 + 5, n, float(i), 0.1) for i, n in enumerate((3, 0, 2))], "angle string, variable string, bin int, bin_left double, bin_right double, n long, mean double, ci95 double")
    drawn = export.curves(bins).first()
    assert drawn.points == 2 and drawn.svg.startswith("<svg") and drawn.svg.endswith("</svg>")
    assert [r.text for r in export.notes(bins).orderBy("line").collect()][2:] == ["| a | v | 5 | 0 | 10 |"]


def test_preview(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 255, 0, 0), (1, 2, 0, 9, 0)], "line int, sample int, red int, green int, blue int")
    export.write_preview(df, str(tmp_path / "p.png"), 2, 3)
    assert (tmp_path / "p.png").read_bytes().startswith(b"\x89PNG")
