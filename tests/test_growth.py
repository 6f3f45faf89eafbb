"""Work is dealt by how much there is to do: by pairs, files and pictures, not by the bytes that are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import candidates, export, gains, neighbours, ordinals, rays, selection, sight, tiles
from lumenfold.plans import adapters, queries
from lumenfold.sources import envi

CAMERA = "scene_code long, cam_x double, cam_y double, cam_z double"


def cloud(spark, n, seed=3):
    xyz = np.random.default_rng(seed).uniform(0.0, 8.0, (n, 3))
    return xyz, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double").coalesce(1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def makers(df) -> int:
    """Partitions that hold rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_rays_are_cut_only_near_points(spark, monkeypatch):
    _, points = cloud(spark, 500)
    scenes = spark.createDataFrame([(i, 4.0 + i, 4.0, 60.0, -i / 60, 0.0, -1.0) for i in range(20)], CAMERA + ", fwd_x double, fwd_y double, fwd_z double")
    cut, voxels = [], rays.voxels

    def counted(df, radius, nearest, farthest, side, *keep):
        out = voxels(df, radius, nearest, farthest, side, *keep)
        cut.append(out.count())
        return out

    monkeypatch.setattr(rays, "voxels", counted)
    assert rays.tube(scenes, points).count() > 100
    assert cut[-1] < 20 * 150 and sum(cut) < 20 * 300  # the tubes have about 1000 voxels each


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_pairs_are_dealt_by_their_number(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sight, "TASK_PAIRS", 500)
    monkeypatch.setattr(sight, "BROADCAST_CELLS", broadcast)
    _, points = cloud(spark, 400)
    unit = {f"r{i}{j}": F.lit(float((i, j) in ((1, 1), (2, 2)))) for i in (1, 2, 3) for j in (1, 2, 3)} | {"r33": F.lit(-1.0)}
    scenes = spark.createDataFrame([(i, 4.0, 4.0, 90.0 + i) for i in range(10)], CAMERA).withColumns(unit)
    met = sight.pairs(points, scenes, 300.0)
    assert met.count() == 4000 and makers(met) > 4


def test_views_beyond_the_best_go_before_the_exchange(spark):
    rows = spark.range(900).select((F.col("id") % 9).alias("point_id"), F.col("id").alias("scene_code"), (F.col("id") * 37 % 101).cast("double").alias("coarse_score"))
    best = candidates.best(rows, 3)
    assert plan(best).count("WindowGroupLimit") == 2
    got = {(r.point_id, r.slot): r.scene_code for r in best.collect()}
    for p in range(9):
        order = sorted(range(p, 900, 9), key=lambda i: (-(i * 37 % 101), i))
        assert [got[p, k] for k in range(3)] == order[:3]


def test_observations_are_dealt_once(spark, sf):
    assert plan(adapters.view(spark, sf, "observations")).count("Exchange hashpartitioning") == 1


def test_nearest_by_tasks_of_bounded_work(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 2_000)
    xyz, points = cloud(spark, 600)
    near = neighbours.nearest(points, 1.5, 5)
    assert makers(near) > 8
    got = {(r.point_id, r.nth): r.other_id for r in near.collect()}
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    for i in range(600):
        order = [j for j in np.argsort(d2[i], kind="stable") if j != i and d2[i, j] < 2.25][:5]
        assert [got[i, k] for k in range(1, len(order) + 1)] == order and (i, len(order) + 1) not in got


def test_rows_of_one_id_are_one_point(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 9.2, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert [(r.other_id, r.nth) for r in neighbours.nearest(points, 1.0, 1).where("point_id = 1").collect()] == [(3, 1)]


def test_many_cubes_share_partitions(spark, tmp_path):
    n = envi.FEW + 44
    for i in range(n):
        envi.write_cube(str(tmp_path / f"s{i}_REF.hdr"), np.full((2, 3, 4), i, "<f4"))
    reader = envi._Reader({"path": str(tmp_path)})
    assert len(reader.partitions()) <= -(-n // envi.PACK)
    rows = envi.scan(spark, str(tmp_path)).where("band = 2 and line >= 1")
    assert rows.count() == 2 * n and rows.select(F.sum(F.col("reflectance")[3])).first()[0] == 2 * sum(range(n))


def test_pixels_of_many_pictures(spark, monkeypatch):
    monkeypatch.setattr(export, "PICTURES", 3)
    pixels = spark.range(40).select(F.col("id").cast("string").alias("scene_id"), F.lit(1).alias("line"), F.lit(2).alias("sample"), F.col("id").cast("int").alias("red"), F.lit(7).alias("green"), F.lit(1).alias("blue"))
    got = {r.scene_id: r.pixels for r in export.pixels_of(export.previews(pixels, 4, 5).coalesce(1)).collect()}
    assert len(got) == 40
    for s, p in got.items():
        assert len(p) == 20 and tuple(p[7]) == (int(s), 7, 1) and not any(map(any, p[:7] + p[8:]))


def test_occlusion_is_dealt_by_points(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TASK_POINTS", 50)
    _, points = cloud(spark, 600)
    views = points.select("point_id", F.lit(1).alias("scene_code"), *[F.lit(v).alias(f"dir_{c}") for c, v in zip("xyz", (0.0, 0.0, 1.0))])
    met = tiles.blockers(views, points, side=1.0)
    assert met.count() == 600 and makers(met) > 8


def sites(spark):
    """Forty sites of ten points and three scenes; a scene sees its own site."""
    rows = spark.range(1200).select(F.lit(1).alias("band"), F.expr("id div 3").alias("point_id"), F.expr("id div 30 * 3 + id % 3").alias("scene_code"))
    return rows.withColumn("y", F.sin(F.col("point_id") * 7 + F.col("scene_code"))).withColumn("w", 1.0 + F.col("point_id") % 5)


def test_a_step_of_the_gain_fit_passes_once_through_its_rows(spark, monkeypatch):
    plans, written = [], gains.shared.written
    monkeypatch.setattr(gains.shared, "written", lambda df: plans.append(plan(df)) or written(df))
    assert gains.fitted(sites(spark), 3, 0.0, min_scene_rows=2).count() == 120
    assert [p.count("InMemoryTableScan") for p in plans].count(1) >= 3 and not any(p.count("InMemoryTableScan") > 1 for p in plans)


def test_sums_of_the_gain_fit_grow_with_scenes_not_with_tasks(spark):
    rows = sites(spark)
    scenes = rows.select("band", "scene_code").distinct().withColumn("at", F.col("scene_code"))
    kept = gains.dealt(rows, scenes, 10)
    assert kept.count() == 1200 and makers(kept) > 5
    assert kept.select(F.spark_partition_id(), "at").distinct().count() <= 120 + 9 * 3  # dealt by a hash of points: about 770
    step = plan(gains.iterate(kept, F.broadcast(scenes.select("at", F.lit(0.5).alias("effect")))))
    assert "hashpartitioning(at" in step and "hashpartitioning(band" not in step
    kept.unpersist()


def exchanged(df) -> list[set]:
    """The columns of each exchange of a plan, reused and adaptive ones included."""
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if "Exchange" in node.nodeName() and "Broadcast" not in node.nodeName():
            out.append({node.output().apply(i).name() for i in range(node.output().size())})
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("name", ["q_brf_table", "q_visible_views"])
@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_geometry_of_views_is_neither_shuffled_nor_written(spark, sf, monkeypatch, name, broadcast):
    monkeypatch.setattr(sight, "BROADCAST_CELLS", broadcast)
    plans, written = [], queries.shared.written
    monkeypatch.setattr(queries.shared, "written", lambda df: plans.append(df) or written(df))
    plans.append(queries.QUERIES[name].spark(spark, sf))
    made = {"view_zenith_deg", "view_azimuth_deg", "offaxis_deg", "surface_view_cos", "coarse_score"}
    assert not [c for df in plans for c in [*exchanged(df), set(df.columns) if df is not plans[-1] else set()] if c & made]


@pytest.mark.parametrize("views", [200_000, 400])
def test_hidden_views_over_tiles(spark, monkeypatch, views):
    monkeypatch.setattr(tiles, "VIEWS", views)
    monkeypatch.setattr(tiles, "TASK_VIEWS", 500)
    r = np.random.default_rng(11)
    n = 4000
    rows = [(i, int(s), float(u), float(v), float(z)) for i, (s, u, v, z) in enumerate(zip(r.integers(0, 3, n), r.uniform(-3, 130, n), r.uniform(-3, 70, n), r.uniform(10, 12, n)))]
    df = spark.createDataFrame([*rows, (9999, 0, None, 1.0, 5.0)], "point_id long, scene_code long, u double, v double, range_m double")
    theirs = sorted(tuple(x) for x in selection.depth_clear(df).where("not zbuffer_clear").select("point_id", "scene_code").collect())
    assert 500 < len(theirs) < 3500
    assert sorted(map(tuple, tiles.hidden(df, side=32).collect())) == theirs


@pytest.mark.parametrize("ranges", [1, 5])
def test_groups_start_where_those_before_end(spark, ranges):
    groups = spark.range(1000).select((F.col("id") * 7919 % 1000 * 3).alias("k"), (F.col("id") * 7919 % 1000 % 4).cast("int").alias("n")).repartition(3)
    at = 0
    for k, start in sorted(map(tuple, ordinals.starts(groups, "k", "n", ranges=ranges).collect())):
        assert start == at
        at += k // 3 % 4
    assert at == 1500


def test_table_without_broadcasts(spark, sf, monkeypatch):
    rows = lambda: sorted(map(tuple, queries.QUERIES["q_brf_table"].spark(spark, sf).collect()))
    expected = rows()
    monkeypatch.setattr(sight, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(sight, "TASK_PAIRS", 500)
    monkeypatch.setattr(tiles, "VIEWS", 20)
    assert len(expected) > 1000 and rows() == expected


def test_lists_of_views_are_shuffled_once_by_the_occlusion(spark):
    _, points = cloud(spark, 60)
    views = F.array(F.struct(F.lit(1).cast("long").alias("scene_code"), *[F.col(c).alias(f"dir_{c}") for c in "xyz"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables whose sizes are estimated above it
    try:
        met = tiles.listed_blockers(points.withColumn("views", views), points)
        assert sum("dir_x" in c for c in exchanged(met)) == 1 and met.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
