"""Queries over images, files and documents: each writes its input to the shared folder, reads it
back through the library's sources, and has a twin in SQL that computes the same from the tables.

Each scene has an image of 168 bands, 64 lines and 64 samples, written by executors, but one scene in fifty
that has none, which shows what happens to views without an image.  Three of the bands hold values, a formula
of scene, band, line and sample; the others are holes in the files.  One scene in three is stored as
big-endian whole numbers behind an offset, with a scale.  All observations are sampled.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import mapgrid, spectral
from ..functions.vectors import matrix_times, rotation, vec
from ..operators import anchors, brf, calibration, candidates, export, fusion, gains, ordinals, raster, scenes, sizes
from ..sources import envi, ply, shared, stores, tables
from . import sqltext as T
from .adapters import ctes, view
from .queries import QUERIES, _best, _cams, _points, _suns, _weighted, calibration_marks, query

__all__ = ["QUERIES"]

SIDE, BANDS = 64, 168
VALUE = "({b} / 8.0::DOUBLE + {x} / 4.0::DOUBLE + {y} / 2.0::DOUBLE + {x} * {x} / 64.0::DOUBLE + {s})"
_SAMPLED = [26, 166, 165]
#: Scenes with an image, in SQL.
_PICTURED = "scene_code % 50 <> 49"


def _write_image(folder: str, scene_id: str, code: int) -> str:
    y, x = np.meshgrid(np.arange(SIDE), np.arange(SIDE), indexing="ij")
    planes = {b: b / 8 + x / 4 + y / 2 + x * x / 64 + code % 3 for b in _SAMPLED}
    path = os.path.join(folder, f"{scene_id}_REF.hdr")
    nm = [400 + 3 * i for i in range(1, BANDS + 1)]
    if code % 3 < 2:
        envi.write_bands(path, BANDS, {b: p.astype("<f4") for b, p in planes.items()}, nm)
    else:
        envi.write_bands(path, BANDS, {b: (p * 64).astype(">u2") for b, p in planes.items()}, nm, offset=128, scale=64.0)
    return path


def _cubes(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The folder of the scenes' images, and (scene_id, header) of each."""
    folder = shared.plain_path(spark)
    os.makedirs(folder)

    def save(batches):
        for b in batches:
            yield pd.DataFrame({"scene_id": b["scene_id"], "header": [_write_image(folder, s, c) for s, c in zip(b["scene_id"], b["scene_code"])]})

    s = view(spark, d, "scenes").where(_PICTURED).select("scene_id", "scene_code")
    n = max(8, sizes.tasks(spark, s.count(), 500))
    return folder, shared.written(s.repartition(n, "scene_code").mapInPandas(save, "scene_id string, header string"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return _cubes(spark, d)[1]


def _views(spark, d, low: float, high: float) -> DataFrame:
    """All observations with their scene, their places brought between low and high in the images."""
    o = view(spark, d, "observations").join(view(spark, d, "scenes").select("scene_code", "scene_id"), "scene_code")
    place = lambda c: low + (high - low) * F.col(c) / 1885
    return o.select("scene_id", place("u").alias("u"), place("v").alias("v"), "point_id", "scene_code")


def _placed(low: str, high: str) -> str:
    at = lambda c: f"{low}::DOUBLE + ({high}::DOUBLE - {low}) * {c} / 1885"
    return f"{ctes('observations')}, vw AS (SELECT point_id, scene_code, scene_code % 3 AS s, {_PICTURED} AS pictured, {at('u')} AS u, {at('v')} AS v FROM observations)"


def _spectrum(df: DataFrame, bands: list[int]) -> DataFrame:
    return df.withColumns({f"b{b}": F.col("spectrum")[i] for i, b in enumerate(bands)})


def _sql_bands(value) -> str:
    return ", ".join(f"{value(b)}{' - 1' if b in spectral.STORED_PLUS_ONE else ''} AS b{b}" for b in _SAMPLED)


@query("q_envi_headers", "scene_id samples:int lines:int bands:int data_type:int wavelengths:long suffix", "header_offset scale", f"""{ctes('scenes')} ;;
SELECT scene_id, 64 AS samples, 64 AS lines, 168 AS bands, CASE scene_code % 3 WHEN 2 THEN 12 ELSE 4 END AS data_type, 168 AS wavelengths, '.dat' AS suffix, CASE scene_code % 3 WHEN 2 THEN 128 ELSE 0 END AS header_offset,
 CASE scene_code % 3 WHEN 2 THEN 64 ELSE 1 END AS scale FROM scenes WHERE {_PICTURED}""")
def _(spark, d):
    return envi.inventory(spark, _cubes(spark, d)[0])


@query("q_envi_cube", "scene_id band:int line:int", "first last total", f"""{ctes('scenes')}, px AS (SELECT scene_id, b, y, {VALUE.format(s='scene_code % 3', b='b', x='x', y='y')} AS f, x FROM scenes, (VALUES (26), (165)) c(b), range(16, 48) l(y), range(64) m(x) WHERE {_PICTURED}) ;;
SELECT scene_id, b AS band, y AS line, max(CASE x WHEN 0 THEN f END) AS first, max(CASE x WHEN 63 THEN f END) AS last, sum(f) AS total FROM px GROUP BY scene_id, b, y""")
def _(spark, d):
    """Bands and lines are chosen by conditions that reach the source, so of 168 bands two are read."""
    rows = envi.scan(spark, _cubes(spark, d)[0], 16).where(F.col("band").isin(26, 165) & (F.col("line") >= 16) & (F.col("line") < 48))
    r = F.col("reflectance")
    return rows.select("scene_id", "band", "line", r[0].alias("first"), r[63].alias("last"), F.aggregate(r, F.lit(0.0), lambda a, x: a + x).alias("total"))


def _bilinear_sql(b: int) -> str:
    at = lambda x, y: VALUE.format(b=b, x=x, y=y, s="s")
    return f"""(({at('x0', 'y0')} * (1 - fx) + {at('x1', 'y0')} * fx) * (1 - fy) + ({at('x0', 'y1')} * (1 - fx) + {at('x1', 'y1')} * fx) * fy)"""


@query("q_raster_sample", "point_id scene_code", " ".join(f"b{b}" for b in _SAMPLED), f"""{_placed('-2', '66')}, cl AS (SELECT *, least(greatest(u, 0), 63) AS a, least(greatest(v, 0), 63) AS c FROM vw WHERE pictured),
g AS (SELECT *, floor(a) AS x0, floor(c) AS y0, least(floor(a) + 1, 63) AS x1, least(floor(c) + 1, 63) AS y1, a - floor(a) AS fx, c - floor(c) AS fy FROM cl) ;; SELECT point_id, scene_code, {_sql_bands(_bilinear_sql)} FROM g""")
def _(spark, d):
    return _spectrum(raster.sampled(_views(spark, d, -2.0, 66.0), _paths(spark, d), _SAMPLED, strip=8), _SAMPLED)


_GAUSS = "(SELECT sum(k * k * exp(-0.5::DOUBLE * k * k / 64)) / sum(exp(-0.5::DOUBLE * k * k / 64)) FROM range(-24, 25) t(k))"


@query("q_gauss_sample", "point_id scene_code", " ".join(f"b{b}" for b in _SAMPLED), f"""{_placed('25', '38')}, gv AS (SELECT {_GAUSS} / 64 AS spread),
g AS (SELECT vw.*, spread, floor(u) AS x0, floor(v) AS y0, least(floor(u) + 1, 63) AS x1, least(floor(v) + 1, 63) AS y1, u - floor(u) AS fx, v - floor(v) AS fy FROM vw, gv WHERE pictured) ;;
SELECT point_id, scene_code, {_sql_bands(lambda b: f"({_bilinear_sql(b)} + spread)")} FROM g""")
def _(spark, d):
    return _spectrum(raster.sampled(_views(spark, d, 25.0, 38.0), _paths(spark, d), _SAMPLED, "gaussian"), _SAMPLED)


_PATCH = "(SELECT sum(k * k * exp(-0.5::DOUBLE * k * k / 1.3225::DOUBLE)) / sum(exp(-0.5::DOUBLE * k * k / 1.3225::DOUBLE)) FROM range(-2, 3) t(k))"


@query("q_patch_sample", "point_id scene_code", " ".join(f"b{b}" for b in _SAMPLED), f"""{_placed('5', '58')}, pv AS (SELECT {_PATCH} / 64 AS spread), g AS (SELECT vw.*, spread, round_even(u, 0) AS x, round_even(v, 0) AS y FROM vw, pv WHERE pictured) ;;
SELECT point_id, scene_code, {_sql_bands(lambda b: f"({VALUE.format(b=b, x='x', y='y', s='s')} + spread)")} FROM g""")
def _(spark, d):
    return _spectrum(raster.sampled(_views(spark, d, 5.0, 58.0), _paths(spark, d), _SAMPLED, "patch", strip=8, radius=2, sigma=1.15), _SAMPLED)


_MOVED = "SELECT user_id AS scene_code, user_id % 5 - 2 AS du, user_id % 7 - 3 AS dv FROM events GROUP BY user_id"


@query("q_offset_patch", "point_id scene_code", " ".join(f"b{b}" for b in _SAMPLED), f"""{_placed('9', '54')}, {ctes('scenes')}, pv AS (SELECT {_PATCH} / 64 AS spread), mv AS ({_MOVED}),
g AS (SELECT vw.*, spread, round_even(u + coalesce(du, 0), 0) AS x, round_even(v + coalesce(dv, 0), 0) AS y FROM vw LEFT JOIN mv USING (scene_code), pv WHERE pictured) ;;
SELECT point_id, scene_code, {_sql_bands(lambda b: f"({VALUE.format(b=b, x='x', y='y', s='s')} + spread)")} FROM g""")
def _(spark, d):
    """Patches at places moved by their scene's offset, the last finite one of a table of corrections."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("scene_code"), "event_id")
    k = F.col("scene_code")
    last = F.col("event_id") == F.max("event_id").over(Window.partitionBy("scene_code"))  # earlier rows hold other offsets, later ones none
    rows = e.withColumn("_last", last).join(view(spark, d, "scenes").select("scene_code", "scene_id"), "scene_code")
    table = rows.select("scene_id", F.col("event_id").alias("_row"), (k % 5 - 2 + F.when(~F.col("_last"), 1).otherwise(0)).cast("double").alias("offset_u_px"), (k % 7 - 3).cast("double").alias("offset_v_px"))
    broken = rows.where("_last").select("scene_id", (F.col("event_id") + 1).alias("_row"), F.lit(float("inf")).alias("offset_u_px"), F.lit(0.0).alias("offset_v_px"))
    moved = tables.offsets(table.union(broken))
    return _spectrum(raster.sampled(_views(spark, d, 9.0, 54.0), _paths(spark, d), _SAMPLED, "patch", radius=2, sigma=1.15, offsets=moved), _SAMPLED)


@query("q_spectra_audit", "n:long missing:long not_finite:long", "", f"{ctes('observations')} ;; SELECT count(*) AS n, count_if(NOT ({_PICTURED})) AS missing, 0 AS not_finite FROM observations")
def _(spark, d):
    return raster.audited(raster.sampled(_views(spark, d, 5.0, 58.0), _paths(spark, d), [26], unknown="null"))


@query("q_spectra_finite", "n:long missing:long not_finite:long", "", f"{ctes('observations')} ;; SELECT count(*) AS n, 0 AS missing, 0 AS not_finite FROM observations WHERE {_PICTURED}")
def _(spark, d):
    return raster.finite_or_abort(raster.sampled(_views(spark, d, 5.0, 58.0), _paths(spark, d), [26, 51]))


@query("q_fusion_reproduced", "against same", "max_diff mean_diff", f"""{T.weighted('softmax')}, sf AS (SELECT point_id, {T.mean('b2')} AS x FROM wt GROUP BY point_id), rf AS (SELECT point_id, sum(view_weight_raw * b2) / sum(view_weight_raw) AS x FROM spectra WHERE keep_for_fusion GROUP BY point_id),
dd AS (SELECT max(abs(rf.x - sf.x)) AS m, avg(abs(rf.x - sf.x)) AS a FROM rf JOIN sf USING (point_id)) ;;
SELECT 'raw' AS against, 0.0 AS max_diff, 0.0 AS mean_diff, true AS same UNION ALL SELECT 'softmax', m, a, m <= 2e-6 FROM dd""")
def _(spark, d):
    """The stored raw fusion against another formula for it, which reproduces it, and against softmax weights, which don't."""
    stored = shared.written(fusion.fused(_weighted(spark, d, "raw"), ["b2"]).select("point_id", "b2"))
    again = gains.fused(view(spark, d, "spectra").where("keep_for_fusion").withColumn("w", F.col("view_weight_raw")), ["b2"])
    found = {"raw": again, "softmax": fusion.fused(_weighted(spark, d, "softmax"), ["b2"])}
    rows = [raster.reproduced(stored, df, "b2").withColumn("against", F.lit(n)) for n, df in found.items()]
    return rows[0].union(rows[1])


@query("q_gaussian_support", "scene_code", "sigma_px sigma_m fwhm_m", f"""{ctes('observations')}, g AS (SELECT scene_code, avg(range_m) / {T._F} AS gsd FROM observations GROUP BY scene_code) ;;
SELECT scene_code, 8 AS sigma_px, 8 * gsd AS sigma_m, 2.35482::DOUBLE * 8 * gsd AS fwhm_m FROM g""")
def _(spark, d):
    """The filter's support on the ground, by each scene's mean ground sampling distance."""
    gsd = view(spark, d, "observations").groupBy("scene_code").agg((F.avg("range_m") / C.intrinsics(1886, 1886, 35.0, 35.0)[0]).alias("gsd"))
    return gsd.withColumns({k: v if hasattr(v, "cast") else F.lit(v) for k, v in spectral.gaussian_support(8.0, F.col("gsd")).items()})


# tables and stores


@query("q_csv_round_trip", "point_id", "x y z", f"{ctes('points')} ;; SELECT point_id, x, y, z FROM points")
def _(spark, d):
    path = shared.plain_path(spark, ".csv")
    p = view(spark, d, "points").select("point_id", "x", "y", "z", F.lit("n").alias("note"))
    for half in (0, 1):  # the header comes once
        stores.append_csv(p.where(F.col("point_id") % 2 == half), path)
    return stores.scan_csv(spark, f"file://{path}", {"point_id": "long", "x": "double", "y": "double", "z": "double"})


@query("q_parquet_scan", "point_id", "u v", f"{ctes('observations')} ;; SELECT point_id, u, v FROM observations WHERE scene_code = 7 AND is_clear")
def _(spark, d):
    path = shared.new_path(spark, ".parquet")
    o = view(spark, d, "observations")
    for half in (0, 1):
        tables.write_table(o.where(F.col("point_id") % 2 == half), path, append=True)
    return stores.scan_parquet(spark, path, ["point_id", "u", "v"], {"scene_code": 7, "is_clear": True})


@query("q_positional_zip", "point_id vec_id", "x first", f"""{ctes('points')}, n AS (SELECT least((SELECT count(*) FROM points), (SELECT count(*) FROM embeddings)) AS n),
a AS (SELECT *, row_number() OVER (ORDER BY point_id) AS i FROM points), b AS (SELECT *, row_number() OVER (ORDER BY vec_id DESC) AS i FROM embeddings) ;;
SELECT point_id, vec_id, x, CAST(embedding[1] AS DOUBLE) AS first FROM a JOIN b USING (i), n WHERE i <= n""")
def _(spark, d):
    p = ordinals.numbered(view(spark, d, "points"), "point_id")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding")[0].cast("double").alias("first"), (-F.col("vec_id")).alias("back"))
    n = stores.inferred_rows(spark, [min(p.count(), e.count())])
    some = ordinals.numbered(e, "back").where(F.col("observation_id") < n).drop("observation_id")
    return stores.zipped(p.where(F.col("observation_id") < n).drop("observation_id"), some, ["point_id"], ["back"])


@query("q_inferred_rows", "rows:long", "", "t AS (SELECT count(*) AS n FROM part) ;; SELECT greatest(n, 12) AS rows FROM t")
def _(spark, d):
    return spark.createDataFrame([(stores.inferred_rows(spark, [None, 12], [f"{d}/part.parquet", "/none.csv"]),)], "rows long")


@query("q_matrix_round_trip", "row:long", "first last total", """e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) ;;
SELECT row, v[1] AS first, v[64] AS last, list_sum(v) AS total FROM e""")
def _(spark, d):
    path = shared.plain_path(spark, ".npy")
    stores.write_matrix(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding", "vec_id", path)
    v = F.col("values")
    return stores.read_matrix(spark, path, 256).select("row", v[0].alias("first"), v[63].alias("last"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("q_archive_round_trip", "name n:long", "total", f"{ctes('points')} ;; SELECT 'point_id' AS name, count(*) AS n, sum(point_id) AS total FROM points UNION ALL SELECT 'z', count(*), sum(z) FROM points")
def _(spark, d):
    path = shared.plain_path(spark, ".npz")
    stores.write_arrays(view(spark, d, "points"), "point_id", path, {"point_id": "<i8", "z": "<f8"})
    return stores.read_arrays(spark, path, 1000).groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: The store's fields and what they are called in the oracle's views.
_STORED = {n: {"score": "coarse_score", "local_view_cos_signed": "facing", "sun_dir_x": "sun_x", "sun_dir_y": "sun_y", "sun_dir_z": "sun_z"}.get(n, n) for n in stores.CANDIDATE_FIELDS if n not in ("scene_code", "is_backlit")}
_LIT = "view2 AS (SELECT v.*,"


@query("q_candidate_store", "point_id slot:int scene_code is_backlit:int", " ".join(_STORED), f"{T.CANDIDATES.replace(_LIT, _LIT + ' sun_x, sun_y, sun_z,')} ;; SELECT point_id, slot, scene_code, CAST(is_backlit AS INT) AS is_backlit, {', '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {n}' for n, c in _STORED.items())} FROM topk")
def _(spark, d):
    """All fields of the store; a second call finds the same source and makes nothing."""
    path, p = shared.new_path(spark), view(spark, d, "points")
    make = lambda: candidates.sunlit(_best(spark, d), _suns(spark, d))
    stores.stored_candidates(make, p, 8, path, {"tables": d})
    rows = stores.candidates_of(stores.stored_candidates(lambda: 1 / 0, p, 8, path, {"tables": d}))
    return rows.withColumns({n: F.nanvl(n, F.lit(None).cast("float")) for n in _STORED})


@query("q_candidate_points", "point_id", "", f"{T.CANDIDATES} ;; SELECT DISTINCT point_id FROM topk WHERE slot < 3")
def _(spark, d):
    return candidates.detected(_best(spark, d), 3)


@query("q_manifest", "product rows:long", "", f"{ctes('points', 'scenes')} ;; SELECT 'points' AS product, count(*) AS rows FROM points UNION ALL SELECT 'copies', count(*) FROM points UNION ALL SELECT 'scenes', count(*) FROM scenes")
def _(spark, d):
    path = shared.plain_path(spark, ".json")
    p = view(spark, d, "points")
    export.manifest(path, {"points": p, "copies": p.select("point_id"), "scenes": view(spark, d, "scenes")}, ["points", "copies"])
    rows = tables.read_table(spark, path).select(F.to_json("rows").alias("j"))
    return rows.select(F.explode(F.from_json("j", "map<string, long>")).alias("product", "rows"))


@query("q_cleanup", "name removed", "", """t AS (SELECT n_name, n_nationkey FROM nation), f AS (SELECT CASE n_nationkey % 4 WHEN 3 THEN '../' || n_name || '.tmp' ELSE n_name || '.tmp' END AS name, n_nationkey % 4 = 0 OR n_nationkey % 4 = 2 AS removed FROM t) ;; SELECT name, removed FROM f""")
def _(spark, d):
    """Files named by nations: of four one is a product and stays, one lies outside the folder, and two go."""
    folder = shared.plain_path(spark)
    inside = os.path.join(folder, "run")
    os.makedirs(inside)
    nations = [(n.n_name, n.n_nationkey % 4) for n in spark.read.parquet(f"{d}/nation.parquet").collect()]
    for name, k in nations:
        with open(os.path.join(folder if k == 3 else inside, f"{name}.tmp"), "w") as f:
            f.write(name)
    p = view(spark, d, "points")
    products = {name: p for name, k in nations if k == 1}
    export.manifest(os.path.join(inside, "manifest.json"), products, list(products))
    names = [f"../{name}.tmp" if k == 3 else f"{name}.tmp" for name, k in nations]
    return spark.createDataFrame(export.cleaned(inside, os.path.join(inside, "manifest.json"), names), "name string, removed boolean")


@query("q_config", "run key value", "", """t AS (SELECT n_name, n_nationkey, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey) ;;
SELECT n_name AS run, k.key AS key, CASE k.key WHEN 'a.x' THEN CAST(r_regionkey AS VARCHAR) WHEN 'a.y' THEN CAST(n_nationkey AS VARCHAR) WHEN 'a.z' THEN '4' WHEN 'region' THEN '"' || r_name || '"' ELSE '[' || CAST(n_nationkey AS VARCHAR) || ', 2]' END AS value
FROM t, (VALUES ('a.x'), ('a.y'), ('a.z'), ('k'), ('region')) k(key)""")
def _(spark, d):
    """A base configuration for each region, and one for each nation that is built on its region's."""
    folder = shared.plain_path(spark)
    os.makedirs(folder)
    trees = {f"region{r.r_regionkey}": {"a": {"x": r.r_regionkey, "y": -1}, "_note": 1, "k": [1], "region": r.r_name} for r in spark.read.parquet(f"{d}/region.parquet").collect()}
    nations = spark.read.parquet(f"{d}/nation.parquet").collect()
    trees |= {f"nation{n.n_nationkey}": {"base_config": f"region{n.n_regionkey}.json", "overrides": {"a": {"y": n.n_nationkey}, "k": [n.n_nationkey, 2]}, "a": {"z": 4}} for n in nations}
    for name, tree in trees.items():
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            json.dump(tree, f)
    rows = [(n.n_name, *r) for n in nations for r in tables.flattened(tables.load_config(os.path.join(folder, f"nation{n.n_nationkey}.json")))]
    return spark.createDataFrame(rows, "run string, key string, value string")


@query("q_output_paths", "name path", "", """t AS (SELECT n_name, n_nationkey FROM nation) ;; SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name || '.csv' WHEN 1 THEN '../up/' || n_name || '.npy' ELSE '/abs/' || n_name END AS name,
 CASE n_nationkey % 3 WHEN 0 THEN '/o/run_' || n_nationkey || '_' || CASE n_nationkey % 2 WHEN 0 THEN '_allbands' ELSE '' END || '/' || n_name || '.csv'
 WHEN 1 THEN '/o/run_' || n_nationkey || '_' || CASE n_nationkey % 2 WHEN 0 THEN '_allbands' ELSE '' END || '/up/' || n_name || '.npy' ELSE '/abs/' || n_name END AS path FROM t""")
def _(spark, d):
    rows = []
    for n in spark.read.parquet(f"{d}/nation.parquet").collect():
        name = (f"{n.n_name}.csv", f"../up/{n.n_name}.npy", f"/abs/{n.n_name}")[n.n_nationkey % 3]
        rows.append((name, tables.output_path("/o", f"/in/run_{n.n_nationkey}?.ply", name, "subset" if n.n_nationkey % 2 else "all")))
    return spark.createDataFrame(rows, "name string, path string")


@query("q_scene_offsets", "scene_id", "du dv", """o AS (SELECT CAST(user_id AS VARCHAR) AS scene_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS u, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value * 2 END AS v FROM events) ;;
SELECT scene_id, arg_max(u, event_id) AS du, arg_max(v, event_id) AS dv FROM o WHERE u IS NOT NULL AND NOT isnan(v) GROUP BY scene_id""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    u, v = F.when(F.col("event_id") % 7 != 0, F.col("value")), F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value") * 2)
    return tables.offsets(e.select(F.col("user_id").cast("string").alias("scene_id"), F.col("event_id").alias("_row"), u.alias("offset_u_px"), v.alias("offset_v_px")))


@query("q_gain_table", "scene_id band:int", "gain", f"{ctes('scenes')} ;; SELECT scene_id, band, 1 + scene_code / 1000.0::DOUBLE AS gain FROM scenes, (VALUES (26), (51)) t(band) WHERE scene_code % 4 > 1")
def _(spark, d):
    k = F.col("scene_code")
    text = F.when(k % 4 == 0, "x").when(k % 4 == 1, "0").otherwise((1 + k / 1000.0).cast("string"))
    s = view(spark, d, "scenes").select("scene_id", F.explode(F.array(F.lit("26"), F.lit("51"), F.lit("76"), F.lit("b"))).alias("band_number"), text.alias("gain"))
    path = shared.new_path(spark, ".csv")
    tables.write_table(s, path)
    return tables.gain_table(tables.read_table(spark, path, "scene_id string, band_number string, gain string"), [26, 51])


@query("q_band_table", "band_number:int band_index:int", "wavelength_nm", "n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) ;; SELECT i AS band_number, i - 1 AS band_index, 400 + 3 * n_nationkey AS wavelength_nm FROM n")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("_row"), (400 + 3 * F.col("n_nationkey")).cast("double").alias("wavelength_nm"))
    return tables.band_metadata(n, BANDS)


@query("q_observation_bundle", "point_id scene_code:int selection_method is_clear", "view_weight_raw u", f"""{ctes('observations')} ;; SELECT point_id, scene_code, selection_method, is_clear, CASE WHEN scene_code % 3 = 0 THEN 1 ELSE view_weight_raw END AS view_weight_raw, u FROM observations WHERE point_id % 10 <> 3""")
def _(spark, d):
    o = view(spark, d, "observations")
    weight = F.when(F.col("scene_code") % 3 == 0, "unknown").otherwise(F.col("view_weight_raw").cast("string"))
    raw = o.select(
        F.when(F.col("point_id") % 10 != 3, F.col("point_id").cast("string")).alias("point_id"), F.col("scene_code").cast("string").alias("scene_code"), F.upper("selection_method").alias("selection_method"),
        F.col("is_clear").cast("string").alias("is_clear"), weight.alias("view_weight_raw"), F.col("u").cast("string").alias("u"),
    )
    return tables.observation_bundle(raw, ["point_id", "view_weight_raw", "u"])


@query("q_median_patch", "point_id scene_code", "b26", f"""{_placed('5', '58')} ;; SELECT point_id, scene_code, list_median([{', '.join(VALUE.format(b=26, x=f'(round_even(u, 0) + {i})', y=f'(round_even(v, 0) + {j})', s='s') for i in (-1, 0, 1) for j in (-1, 0, 1))}]) AS b26 FROM vw WHERE pictured""")
def _(spark, d):
    return _spectrum(raster.sampled(_views(spark, d, 5.0, 58.0), _paths(spark, d), [26], "patch", strip=8, radius=1, reducer="median"), [26])


# point files


@query("q_point_file", "point_id red:int green:int blue:int", "x y z band_26 confidence", f"{ctes('points')} ;; SELECT point_id, x, y, z, point_id % 256 AS red, point_id % 7 AS green, 255 AS blue, CAST(CAST(z / 3 AS FLOAT) AS DOUBLE) AS band_26, normal_confidence AS confidence FROM points")
def _(spark, d):
    p = view(spark, d, "points").withColumns({"r": F.col("point_id") % 256, "g": F.col("point_id") % 7, "b": F.lit(255), "third": F.col("z") / 3, "confidence": F.col("normal_confidence")})
    table, types = ply.assembled(p, {"band_26": "third"}, ("r", "g", "b"), ("confidence",))
    first = table.agg(F.min("point_id")).first()[0] or 0
    path = shared.plain_path(spark, ".ply")
    ply.write(table, path, "point_id", types)
    spark.dataSource.register(ply.PlySource)
    back = spark.read.format("ply").option("path", path).option("rows", "500").load()
    return back.withColumn("point_id", F.col("point_id") + first)


@query("q_export_adjusted", "point_id", "b2 b4", f"{ctes('spectra')} ;; SELECT point_id, avg(b2) - 1 AS b2, avg(b4) AS b4 FROM spectra GROUP BY point_id")
def _(spark, d):
    means = view(spark, d, "spectra").groupBy("point_id").agg(F.avg("b2").alias("b2"), F.avg("b4").alias("b4"))
    return export.adjusted(means, {"b2": 165, "b4": 51}, (165,))[0]


@query("q_curves", "angle variable points:long", "", f"""{ctes('spectra')}, l AS (SELECT 'view_zenith_deg' AS angle, view_zenith_deg AS ang, 90 AS most FROM spectra UNION ALL SELECT 'relative_azimuth_deg', relative_azimuth_deg, 180 FROM spectra),
g AS (SELECT DISTINCT angle, CAST(floor(least(ang, most - 1e-9) / 5) AS INT) AS bin FROM l WHERE ang >= 0 AND ang <= most) ;; SELECT angle, v AS variable, count(*) AS points FROM g, (VALUES ('b2'), ('b4')) t(v) GROUP BY ALL""")
def _(spark, d):
    return export.curves(brf.angular_bins(view(spark, d, "spectra"), {"view_zenith_deg": 90.0, "relative_azimuth_deg": 180.0}, ["b2", "b4"]))


# scenes and documents


@query("q_factorized_scenes", "scene_id code:int", "", f"""{ctes('scenes')} ;; SELECT scene_id, row_number() OVER (ORDER BY CAST(regexp_extract(scene_id, '(\\d+)$', 1) AS BIGINT), scene_id) - 1 AS code FROM scenes""")
def _(spark, d):
    s = view(spark, d, "scenes")
    return scenes.with_code(s.select("scene_id"), scenes.factorized(s.union(s)))


@query("q_scene_aggregates", "scene_code scene_id views:long", "", f"{ctes('scenes', 'observations')}, a AS (SELECT scene_code, count(*) AS views FROM observations WHERE scene_code % 3 <> 0 GROUP BY 1) ;; SELECT scene_code, scene_id, coalesce(views, 0) AS views FROM scenes LEFT JOIN a USING (scene_code)")
def _(spark, d):
    s = view(spark, d, "scenes").select("scene_code", "scene_id")
    o = view(spark, d, "observations").where("scene_code % 3 <> 0").groupBy("scene_code").agg(F.count("*").alias("views"))
    return scenes.with_aggregates(s, o.join(s, "scene_code"))


@query("q_pose_chain", "scene_id", "cam_x cam_x_pose derived", f"{ctes('scenes')} ;; SELECT scene_id, cam_x, cam_x + 1 AS cam_x_pose, CASE WHEN scene_code % 3 = 0 THEN cam_y END AS derived FROM scenes WHERE scene_code % 5 <> 0")
def _(spark, d):
    s = view(spark, d, "scenes")
    aligned = s.where("scene_code % 5 <> 0").select("scene_id", (F.col("cam_x") + 1).alias("cam_x"))
    return scenes.pose_chain(s.select("scene_id", "cam_x"), aligned, s.where("scene_code % 3 = 0").select("scene_id", F.col("cam_y").alias("derived")))


_R = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


@query("q_scene_documents", "scene_id", " ".join(["turned", *_R]), f"{ctes('scenes')}, {T.CAMS} ;; SELECT scene_id, r11 + 1 AS turned, {', '.join(_R)} FROM cams")
def _(spark, d):
    s = _cams(spark, d)
    made = scenes.document(s)
    path = shared.new_path(spark)
    scenes.save_documents(made, path)
    loaded = scenes.load_documents(spark, path, made.schema)
    frames = s.select("scene_id", *[(F.col(r) + 1).alias(r.replace("r", "c")) for r in _R])
    turned = scenes.corrected_document(loaded, frames)
    back = scenes.restored(turned).select("scene_id", F.col("meta.camera_model.world_to_camera").alias("m"))
    first = turned.select("scene_id", F.col("meta.camera_model.world_to_camera")[0][0].alias("turned"))
    return back.select("scene_id", *[F.col("m")[int(r[1]) - 1][int(r[2]) - 1].alias(r) for r in _R]).join(first, "scene_id")


@query("q_repaired_scenes", "scene_id", "cam_x cam_y", f"{ctes('scenes')} ;; SELECT scene_id, CASE WHEN scene_code % 3 = 0 THEN cam_x + 1 ELSE cam_x END AS cam_x, CASE WHEN scene_code % 3 = 0 THEN cam_y + 1 ELSE cam_y END AS cam_y FROM scenes")
def _(spark, d):
    s = view(spark, d, "scenes")
    broken = s.select("scene_id", F.when(F.col("scene_code") % 3 != 0, F.col("cam_x")).alias("cam_x"), "cam_y")
    return scenes.repaired(broken, s.select("scene_id", *[(F.col(c) + F.when(F.col("scene_code") % 3 == 0, 1).otherwise(0)).alias(c) for c in ("cam_x", "cam_y")]), ["cam_x", "cam_y"])


_STATUS = "CASE WHEN scene_code % 4 = 0 THEN 'top_only' WHEN scene_code % 4 = 1 THEN 'base_only' WHEN scene_code % 7 = 6 THEN 'none' ELSE 'full' END"


@query("q_annotations", "scene_id annotation_status", "u_top top_anchor_z base_anchor_z", f"""{ctes('scenes', 'points')}, n AS (SELECT count(*) AS n FROM points), o AS (SELECT *, row_number() OVER (ORDER BY z) - 1 AS i FROM points),
c AS (SELECT (SELECT z FROM o, n WHERE i = greatest(0, CAST(floor(0.95::DOUBLE * n) AS BIGINT) - 1)) AS hi, (SELECT z FROM o, n WHERE i = least(n - 1, CAST(floor(0.05::DOUBLE * n) AS BIGINT))) AS lo),
a AS (SELECT avg(CASE WHEN z >= hi THEN z END) AS top_anchor_z, avg(CASE WHEN z <= lo THEN z END) AS base_anchor_z FROM points, c) ;;
SELECT scene_id, {_STATUS} AS annotation_status, scene_code AS u_top, top_anchor_z, base_anchor_z FROM scenes, a WHERE scene_code % 5 <> 0""")
def _(spark, d):
    k = F.col("scene_code")
    marks = view(spark, d, "scenes").select("scene_id", F.when(k % 5 == 0, "pending").otherwise(F.expr(_STATUS)).alias("annotation_status"), k.cast("double").alias("u_top"))
    path = shared.new_path(spark, ".csv")
    tables.write_table(stores.annotations(marks, anchors.top_and_base(view(spark, d, "points"))), path)
    return stores.scan_csv(spark, path, {"scene_id": "string", "annotation_status": "string", "u_top": "double", "top_anchor_z": "double", "base_anchor_z": "double"})


# observations, bands, geometry


@query("q_brf_geometry", "point_id scene_code", "x y z nx nz", f"{ctes('points', 'observations')}, {T.PNTS} ;; SELECT o.point_id, scene_code, x, y, z, nx, nz FROM observations o JOIN pnts USING (point_id)")
def _(spark, d):
    return brf.with_geometry(view(spark, d, "observations"), _points(spark, d))


@query("q_observation_spectrum", "observation_id:long point_id", "first", f"""{ctes('observations')}, n AS (SELECT row_number() OVER (ORDER BY point_id, scene_code) - 1 AS observation_id, point_id FROM observations), k AS (SELECT count(*) AS k, (SELECT max(p_partkey) FROM part) // 2 AS m FROM embeddings) ;;
SELECT observation_id, point_id, CAST(embedding[1] AS DOUBLE) AS first FROM n, k JOIN embeddings ON vec_id = (observation_id * 7) % k WHERE point_id BETWEEN 0 AND m - 1""")
def _(spark, d):
    """Spectra by observation_id, as a matrix has them, for the first half of the points; views of other points take no part."""
    o = ordinals.numbered(view(spark, d, "observations").select("point_id", "scene_code"), "point_id", "scene_code").select("observation_id", "point_id")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("spectrum"))
    rows = spark.range(o.count()).withColumnRenamed("id", "observation_id").withColumn("vec_id", F.col("observation_id") * 7 % e.count())
    half = spark.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey")).first()[0] // 2
    return brf.with_spectrum(o, rows.join(e, "vec_id").drop("vec_id"), half).withColumn("first", F.col("spectrum")[0])


@query("q_notes", "text", "", f"""{ctes('spectra')}, l AS (SELECT 'view_zenith_deg' AS angle, view_zenith_deg AS ang, 90 AS most, b2 FROM spectra UNION ALL SELECT 'relative_azimuth_deg', relative_azimuth_deg, 180, b2 FROM spectra),
g AS (SELECT angle, CAST(floor(least(ang, most - 1e-9) / 5) AS INT) AS bin, count(*) AS n, avg(b2) AS m FROM l WHERE ang >= 0 AND ang <= most GROUP BY ALL),
t AS (SELECT angle, sum(n) AS n, arg_min(bin, m) * 5 AS lo, arg_max(bin, m) * 5 AS hi FROM g GROUP BY angle) ;; SELECT '| ' || angle || ' | b2 | ' || n || ' | ' || lo || ' | ' || hi || ' |' AS text FROM t
UNION ALL SELECT '| angle | variable | observations | least mean from | greatest mean from |' UNION ALL SELECT '|-|-|-|-|-|'""")
def _(spark, d):
    return export.notes(brf.angular_bins(view(spark, d, "spectra"), {"view_zenith_deg": 90.0, "relative_azimuth_deg": 180.0}, ["b2"]))


@query("q_scene_preview", "scene_id bytes_differ", "pixels red", f"""{ctes('scenes', 'observations')}, p AS (SELECT scene_code, CAST(floor(u / 32) AS INT) AS x, CAST(floor(v / 32) AS INT) AS y, count(*) AS n FROM observations GROUP BY ALL) ;;
SELECT scene_id, false AS bytes_differ, count(*) AS pixels, sum(least(n * 40, 255)) AS red FROM p JOIN scenes USING (scene_code) GROUP BY scene_id""")
def _(spark, d):
    """A picture (PNG) for each scene, drawn by its own task: how many observations fall on each block of pixels.  The files are
    read back, and their pixels counted."""
    o = view(spark, d, "observations").join(view(spark, d, "scenes").select("scene_code", "scene_id"), "scene_code")
    n = o.groupBy("scene_id", F.floor(F.col("v") / 32).cast("int").alias("line"), F.floor(F.col("u") / 32).cast("int").alias("sample")).agg(F.count("*").alias("n"))
    pixels = n.select("scene_id", "line", "sample", F.least(F.col("n") * 40, F.lit(255)).alias("red"), F.lit(7).alias("green"), F.lit(1).alias("blue"))
    pictures = shared.written(export.previews(pixels, 60, 60))
    back = export.pixels_of(pictures)
    red = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p["red"])
    return back.select("scene_id", F.size(F.filter("pixels", lambda p: p["green"] == 7)).cast("long").alias("pixels"), red.alias("red"), F.lit(False).alias("bytes_differ"))


@query("q_band_selection", "nation:long kind band:int", "", """t AS (SELECT n_nationkey AS k FROM nation), b AS (SELECT k, 'spec' AS kind, unnest([1 + k, 2 + k, 3 + k, 100 + k]) AS band FROM t
UNION ALL SELECT k, 'targets', unnest([50 + k, 134]) FROM t UNION ALL SELECT k, 'directional', unnest([26 + k, 51 + k, 164]) FROM t UNION ALL SELECT k, 'nearest', CASE WHEN k % 2 = 0 THEN 1 + k ELSE 81 END FROM t) ;; SELECT k AS nation, kind, band FROM b""")
def _(spark, d):
    """Choices of bands whose settings come from a table: a text of ranges, wavelengths, two lists, and the nearest within 3 nm."""
    nm, rows = [400.0 + 3 * i for i in range(1, BANDS + 1)], []
    for (k,) in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect():
        picked = {"spec": spectral.parse_bands(f"{1 + k}:{3 + k},{100 + k}", BANDS), "targets": spectral.select_bands(nm, targets=[400.0 + 3 * (50 + k) + 1, 802.0]), "directional": spectral.directional_bands([51 + k, 26 + k], [164, 900, 0], BANDS)}
        picked["nearest"] = [spectral.nearest_band(nm, 400.0 + 3 * (1 + k) if k % 2 == 0 else 4000.0 + k, 81)]
        rows += [(k, kind, b) for kind, bands in picked.items() for b in bands]
    return spark.createDataFrame(rows, "nation long, kind string, band int")


@query("q_truth", "user_id:long yes", "", "e AS (SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'no' END AS t FROM events GROUP BY user_id) ;; SELECT user_id, coalesce(lower(trim(t)) IN ('true', '1', 'yes', 'y'), false) AS yes FROM e")
def _(spark, d):
    k = F.col("user_id")
    text = F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, " yes ").when(k % 5 == 2, "1").when(k % 5 == 3, "no")
    return spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().select("user_id", spectral.truth(text).alias("yes"))


@query("q_axis_rotation", "scene_code", "x y z", f"""{ctes('scenes')}, a AS (SELECT *, radians(scene_code % 90) AS t, 1 / sqrt(3.0::DOUBLE) AS k, cam_x + cam_y + cam_z AS d FROM scenes) ;;
SELECT scene_code, cam_x * cos(t) + k * (cam_z - cam_y) * sin(t) + d / 3 * (1 - cos(t)) AS x, cam_y * cos(t) + k * (cam_x - cam_z) * sin(t) + d / 3 * (1 - cos(t)) AS y, cam_z * cos(t) + k * (cam_y - cam_x) * sin(t) + d / 3 * (1 - cos(t)) AS z FROM a""")
def _(spark, d):
    turned = matrix_times(rotation(vec(1.0, 1.0, 1.0), (F.col("scene_code") % 90).cast("double")), vec("cam_x", "cam_y", "cam_z"))
    return view(spark, d, "scenes").select("scene_code", *[c.alias(n) for c, n in zip(turned, "xyz")])


@query("q_near_image", "point_id scene_code", "", f"""{ctes('observations')} ;; SELECT point_id, scene_code FROM observations WHERE u - 100 BETWEEN -50 AND 1935 AND v * 1.1::DOUBLE BETWEEN -50 AND 1935""")
def _(spark, d):
    o = view(spark, d, "observations")
    return o.where(C.near_image(F.col("u") - 100, F.col("v") * 1.1, 50.0))


@query("q_target_points", "point_id", "z", f"{ctes('points')} ;; SELECT point_id, z FROM points WHERE power(x - 5, 2) + power(y - 2, 2) <= 4 AND z BETWEEN 0.5 AND 4.5")
def _(spark, d):
    return anchors.target_points(view(spark, d, "points"), {"z": (0.5, 4.5)}, 5, (5.0, 2.0, 2.0))


@query("q_default_weights", "point_id scene_code", "w", f"""{ctes('observations')} ;; SELECT point_id, scene_code, 1.0::DOUBLE / count(*) OVER (PARTITION BY point_id) AS w FROM observations""")
def _(spark, d):
    return fusion.weighted(view(spark, d, "observations").select("point_id", "scene_code"), "raw")


@query("q_corrected_pixels", "scene_code", "u v", f"""{ctes('scenes')}, {T.CAMS}, e AS (SELECT *, site_x + 5.5::DOUBLE - cam_x AS ex, 4.2::DOUBLE - cam_y AS ey, 0.5::DOUBLE - cam_z AS ez FROM cams),
f AS (SELECT *, r11 * ex + r12 * ey + r13 * ez AS px, r21 * ex + r22 * ey + r23 * ez AS py, r31 * ex + r32 * ey + r33 * ez AS pz FROM e),
g AS (SELECT scene_code, px * cos(t) - py * sin(t) AS qx, px * sin(t) + py * cos(t) AS qy, pz FROM (SELECT *, radians(2.0::DOUBLE) AS t FROM f)) ;;
SELECT scene_code, {T._F} * (qx / pz) + 942.5::DOUBLE AS u, {T._F} * (qy / pz) + 942.5::DOUBLE AS v FROM g""")
def _(spark, d):
    s = _cams(spark, d)
    solved = s.select("scene_id", F.lit("full").alias("status"), F.lit(True).alias("success"), F.lit(0.0).alias("rx"), F.lit(0.0).alias("ry"), F.radians(F.lit(2.0)).alias("rz"))
    turned = calibration.applied(s, solved)
    rows = tuple(vec(*[f"c{i}{j}" for j in (1, 2, 3)]) for i in (1, 2, 3))
    u, v = C.project_corrected(vec(F.col("site_x") + 5.5, 4.2, 0.5), vec("cam_x", "cam_y", "cam_z"), rows)
    return turned.select("scene_code", u.alias("u"), v.alias("v"))


_BEHIND = "scene_code % 11 = 5"


@query("q_rotation_gate", "solved:long failed:long clipped:long reasons passed", "min_angle median_angle mean_angle", f"""{ctes('scenes')}, s AS (SELECT {_BEHIND} AS f, CASE WHEN {_BEHIND} THEN 0 ELSE least(2 + scene_code % 3, 3.5::DOUBLE) END AS a, NOT ({_BEHIND}) AND scene_code % 3 = 2 AS c FROM scenes WHERE {_STATUS} = 'full'),
g AS (SELECT count(*) AS solved, count_if(f) AS failed, count_if(c) AS clipped, min(a) AS min_angle, median(a) AS median_angle, avg(a) AS mean_angle FROM s),
w AS (SELECT *, concat_ws(';', CASE WHEN solved = 0 THEN 'nothing_solved' END, CASE WHEN failed > 0 THEN 'failed_scenes' END, CASE WHEN clipped > 0 THEN 'clipped_scenes' END, CASE WHEN min_angle > 5 THEN 'min_angle' END, CASE WHEN median_angle > 5 THEN 'median_angle' END, CASE WHEN mean_angle > 10 THEN 'mean_angle' END) AS reasons FROM g) ;;
SELECT *, reasons = '' AS passed FROM w""")
def _(spark, d):
    """Planted turns of 2 to 4 degrees under a limit of 3.5, and some scenes whose marks lie behind the camera."""
    marks = calibration_marks(spark, d).where("status in ('full', 'none')").join(view(spark, d, "scenes").select("scene_id", "scene_code"), "scene_id")
    behind = lambda e: F.when(F.expr(_BEHIND), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: 2.0 * F.get("cam", i) - F.get(e, i))).otherwise(F.col(e))
    return calibration.quality_gate(calibration.corrections(marks.withColumns({e: behind(e) for e in ("top", "base")}), C.intrinsics(1886, 1886, 35.0, 35.0), 3.5))


_TURNED = f"""{ctes('scenes')}, {T.CAMS}, mk AS (SELECT *, {_STATUS} AS status, radians(2.0::DOUBLE + scene_code % 3) AS t FROM cams), en AS (SELECT *, 'top' AS e, site_x + 5 - cam_x AS ex, 4 - cam_y AS ey, 4 - cam_z AS ez FROM mk UNION ALL SELECT *, 'base', site_x + 5.5::DOUBLE - cam_x, 4.2::DOUBLE - cam_y, 0.5::DOUBLE - cam_z FROM mk),
pp AS (SELECT *, r11 * ex + r12 * ey + r13 * ez AS px, r21 * ex + r22 * ey + r23 * ez AS py, r31 * ex + r32 * ey + r33 * ez AS pz, 1.0::DOUBLE / sqrt(1.29::DOUBLE) AS kx, 0.5::DOUBLE / sqrt(1.29::DOUBLE) AS ky, 0.2::DOUBLE / sqrt(1.29::DOUBLE) AS kz FROM en),
qq AS (SELECT *, kx * px + ky * py + kz * pz AS kp FROM pp),
tt AS (SELECT *, px * cos(t) + (ky * pz - kz * py) * sin(t) + kx * kp * (1 - cos(t)) AS qx, py * cos(t) + (kz * px - kx * pz) * sin(t) + ky * kp * (1 - cos(t)) AS qy, pz * cos(t) + (kx * py - ky * px) * sin(t) + kz * kp * (1 - cos(t)) AS qz FROM qq),
er AS (SELECT scene_id, scene_code, status, e, {T._F} * (px / pz - qx / qz) AS du, {T._F} * (py / pz - qy / qz) AS dv FROM tt WHERE status = 'full' OR status = e || '_only')"""


@query("q_correction_log", "scene_id annotation_status solver_dof:int clipped_by_max_angle success noted", " ".join([*calibration._ERRORS, "rotation_deg"]), f"""{_TURNED}, w AS (SELECT scene_id, {', '.join(f"max(CASE e WHEN '{e}' THEN d{a} END) AS {a}_{e}" for e in ('top', 'base') for a in 'uv')} FROM er GROUP BY scene_id) ;;
SELECT mk.scene_id, status AS annotation_status, CASE status WHEN 'full' THEN 3 WHEN 'none' THEN 0 ELSE 2 END AS solver_dof, false AS clipped_by_max_angle, true AS success, status = 'none' AS noted,
 {', '.join(f"{a}_{e} AS pre_err_{a}_{e}_px, {a}_{e} * 0 AS post_err_{a}_{e}_px" for e in ('top', 'base') for a in 'uv')}, CASE status WHEN 'full' THEN 2 + scene_code % 3 WHEN 'none' THEN 0 END AS rotation_deg FROM mk LEFT JOIN w USING (scene_id)""")
def _(spark, d):
    """All columns of the log; with one end marked the turn about it is open, so its angle isn't shown."""
    log = calibration.correction_log(calibration.corrections(calibration_marks(spark, d), C.intrinsics(1886, 1886, 35.0, 35.0)))
    shown = F.when(F.col("annotation_status").isin("full", "none"), F.col("rotation_total_deg"))
    return log.withColumns({"noted": F.col("note") != "", "rotation_deg": shown})


@query("q_marked_solve", "scene_id status", "angle_deg", f"{ctes('scenes')} ;; SELECT scene_id, 'full' AS status, 2 + scene_code % 3 AS angle_deg FROM scenes WHERE {_STATUS} = 'full' AND scene_code % 5 <> 0")
def _(spark, d):
    """Annotations and documents of other scenes meet; the solve gives back the planted angle."""
    marks = calibration_marks(spark, d).where("status = 'full'")
    rows = marks.select("scene_id", F.col("status").alias("annotation_status"), "u_top", "v_top", "u_base", "v_base", *[F.col(e)[i].alias(f"{e}_anchor_{c}") for e in ("top", "base") for i, c in enumerate("xyz")])
    made = calibration.marked(rows, scenes.document(_cams(spark, d).where("scene_code % 5 <> 0")))
    return calibration.corrections(made, C.intrinsics(1886, 1886, 35.0, 35.0))


@query("q_collected_report", "scene_id has_points has_none", "pre_max", f"""{_TURNED} ;; SELECT s.scene_id, true AS has_points, false AS has_none, m.x AS pre_max
FROM scenes s LEFT JOIN (SELECT scene_id, max(sqrt(du * du + dv * dv)) AS x FROM er GROUP BY scene_id) m USING (scene_id)""")
def _(spark, d):
    """The errors of each scene's ends before its correction, beside the sizes of a product's file that exists and one that doesn't."""
    path = shared.plain_path(spark, ".csv")
    stores.append_csv(view(spark, d, "points").select("point_id", "x", "y", "z"), path)
    solved = calibration.correction_log(calibration.corrections(calibration_marks(spark, d), C.intrinsics(1886, 1886, 35.0, 35.0)))
    report = gains.rmse_columns(solved, [(f"pre_err_u_{e}_px", f"pre_err_v_{e}_px") for e in ("top", "base")], "pre")
    found = export.collected(report, {"points": path, "none": path + ".none"})
    return found.withColumns({f"has_{n}": F.coalesce(F.col(f"bytes_{n}") > 0, F.lit(False)) for n in ("points", "none")})


def _system(code: int) -> tuple[str, str]:
    return f"{mapgrid.system(code)[0]}::DOUBLE", f"{mapgrid.system(code)[1]}::DOUBLE"


_CATALOGUE = [
    {"name": "plain", "src_crs": "EPSG:4326", "dst_crs": "EPSG:4547", "post_ops": {"x_offset_m": -500000.0, "y_offset_m": -2876000.0}},
    {"name": "swapped", "src_crs": "EPSG:4326", "dst_crs": "EPSG:4547", "post_ops": {"swap_xy": True}},
    {"name": "strip", "src_crs": "EPSG:4326", "dst_crs": "EPSG:4526", "post_ops": {"subtract_x_zone_prefix_million": 38}},
]


@query("q_grid_choice", "name hits:long", "distance_km score_k", f"""{ctes('points', 'scenes')}, bx AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM points), {T.tm('scenes', 'cam_lon', 'cam_lat', *_system(4547))},
cc AS (SELECT 'plain' AS name, east - 500000 AS cx, north - 2876000 AS cy FROM tm UNION ALL SELECT 'swapped', north, east FROM tm UNION ALL SELECT 'strip', east, north FROM tm),
g AS (SELECT name, count_if(cx BETWEEN xl - greatest(30, (xh - xl) * 0.2::DOUBLE) AND xh + greatest(30, (xh - xl) * 0.2::DOUBLE) AND cy BETWEEN yl - greatest(30, (yh - yl) * 0.2::DOUBLE) AND yh + greatest(30, (yh - yl) * 0.2::DOUBLE)) AS hits,
 median(sqrt(power(cx - (xl + xh) * 0.5::DOUBLE, 2) + power(cy - (yl + yh) * 0.5::DOUBLE, 2))) AS distance FROM cc, bx GROUP BY name) ;;
SELECT name, hits, distance / 1000 AS distance_km, (hits * 1000 - distance - 2 * 999 - 2 * 999) / 1000 AS score_k FROM g""")
def _(spark, d):
    text = json.dumps({"candidates": _CATALOGUE})
    s = view(spark, d, "scenes").select("cam_lon", "cam_lat", F.lit(None).cast("double").alias("az_residual"), F.lit(None).cast("double").alias("zen_residual"))
    _, scores = anchors.choose_grid(s, anchors.bounds(view(spark, d, "points")), stores.catalogue(text))
    return scores.withColumns({"distance_km": F.col("distance") / 1000, "score_k": F.col("score") / 1000})
