"""Views of the benchmark tables as points, scenes, times, observations and spectra.

One SQL text serves both engines: in Spark table names become Parquet paths, elsewhere they
are the registered tables.  The mapping is that of FIXTURES.md, but for its two cuts: every
row of every table is used.  Points and scenes lie at sites a kilometre apart, 1000 points and
49 scenes at each, so both sides grow with the tables and a scene sees its own site; an
observation's spectrum is one of all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sizes import compiled

POINTS = """SELECT p_partkey AS point_id, 1000 * floor(CAST(p_partkey AS DOUBLE) / 1000) + CAST(p_partkey % 50 AS DOUBLE) / 5 AS x,
  floor(CAST(p_partkey % 1000 AS DOUBLE) / 50) / 5 AS y,
  CAST(p_size AS DOUBLE) / 10 AS z, CAST(p_partkey % 7 AS DOUBLE) - 3 AS nx_raw, CAST(p_partkey % 5 AS DOUBLE) - 2 AS ny_raw,
  CAST(1 + p_partkey % 4 AS DOUBLE) AS nz_raw, CAST(p_partkey % 11 AS DOUBLE) / 10 AS normal_confidence FROM {part}"""

SCENES = """SELECT s_suppkey AS scene_code, s_name AS scene_id, s_nationkey AS group_key,
  1000 * floor(CAST(s_suppkey AS DOUBLE) / 49) AS site_x, 1000 * floor(CAST(s_suppkey AS DOUBLE) / 49) + 5 + 25 * cos(2 * pi() * s_suppkey / 49) AS cam_x, 4 + 25 * sin(2 * pi() * s_suppkey / 49) AS cam_y,
  CAST(30 + 10 * (s_suppkey % 3) AS DOUBLE) AS cam_z, CAST(114 AS DOUBLE) + CAST(s_suppkey AS DOUBLE) / 1000 AS cam_lon,
  CAST(26 AS DOUBLE) + CAST(s_nationkey AS DOUBLE) / 1000 AS cam_lat FROM {supplier}"""

TIMES = "SELECT user_id AS scene_code, min(ts) AS acquisition_time FROM {events} GROUP BY user_id"

OBSERVATIONS = """SELECT e.*, CASE WHEN is_clear THEN 'clear_keep' WHEN n_clear = 0 THEN 'fallback_keep' ELSE 'unclear_keep' END AS selection_method,
  (is_clear OR n_clear = 0) AS keep_for_fusion
FROM (SELECT d.*, sum(CASE WHEN is_clear THEN 1 ELSE 0 END) OVER (PARTITION BY point_id) AS n_clear
  FROM (SELECT l_partkey AS point_id, l_suppkey AS scene_code, CAST((l_orderkey * 37 + l_suppkey * 11) % 1886 AS DOUBLE) AS u,
    CAST((l_orderkey * 53 + l_linenumber * 7) % 1886 AS DOUBLE) AS v, 20 + l_quantity AS range_m, 250 * l_tax AS offaxis_deg,
    CAST((l_orderkey * 13) % 400 AS DOUBLE) AS border_dist_px, CAST((l_orderkey * 7 + l_linenumber * 13) % 90 AS DOUBLE) AS view_zenith_deg,
    CAST((l_orderkey * 29) % 360 AS DOUBLE) - 180 AS relative_azimuth_deg, CAST((l_orderkey * 17) % 180 AS DOUBLE) AS local_solar_incidence_deg,
    CAST((l_partkey + l_suppkey) % 101 AS DOUBLE) / 100 AS surface_view_cos, CAST(l_partkey % 21 AS DOUBLE) / 20 AS surface_verticality,
    CAST(l_partkey % 11 AS DOUBLE) / 10 AS normal_confidence, l_quantity / 5 - 5 AS coarse_score, l_extendedprice / 1000 AS visibility_score,
    CAST(1 + (l_orderkey * 3) % 1000 AS DOUBLE) / 1000 AS view_weight_raw, CAST((l_orderkey * 19) % 181 AS DOUBLE) AS local_empty_cone_deg,
    CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 + CAST(l_orderkey % 3 AS INT) END AS blocker_count,
    (l_linestatus = 'F' AND l_partkey % 10 <> 0) AS is_clear,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) AS dup_rank
    FROM {lineitem}) d WHERE dup_rank = 1) e"""

#: Observations with their five reflectances: green, red, red edge, NIR 802 and NIR 850.
BANDS = (12, 26, 40, 51, 60)
SPECTRA = (
    "SELECT o.*, " + ", ".join(f"0.7 + CAST({{at{b}}} AS DOUBLE) AS b{i}" for i, b in enumerate(BANDS, 1))
    + " FROM (SELECT e.*, (e.point_id * 31 + e.scene_code * 17) % k.n_vectors AS spectrum_id FROM ({observations}) e CROSS JOIN (SELECT count(*) AS n_vectors FROM {embeddings}) k) o"
    + " JOIN {embeddings} m ON m.vec_id = o.spectrum_id"
)

TABLES = ("part", "supplier", "events", "lineitem", "embeddings")

#: What observations read of lineitem, dealt by point once: both of their windows, and what follows by point, need no further exchange.
DEALT = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus FROM {lineitem} DISTRIBUTE BY l_partkey)"


def sql(name: str) -> str:
    """A view's text for the oracle."""
    text = {"points": POINTS, "scenes": SCENES, "times": TIMES, "observations": OBSERVATIONS}.get(name)
    if name == "spectra":
        text = SPECTRA.replace("{observations}", OBSERVATIONS)
        for b in BANDS:
            text = text.replace(f"{{at{b}}}", f"m.embedding[{b}]")
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def ctes(*names: str) -> str:
    """A WITH list (without the keyword) of views."""
    return ",\n".join(f"{n} AS ({sql(n)})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled(spark)
    text = {"points": POINTS, "scenes": SCENES, "times": TIMES, "observations": OBSERVATIONS}.get(name)
    if name == "spectra":
        text = SPECTRA.replace("{observations}", OBSERVATIONS)
        for b in BANDS:
            text = text.replace(f"{{at{b}}}", f"m.embedding[{b - 1}]")
    text = text.replace("{lineitem}", DEALT)
    for t in TABLES:
        text = text.replace(f"{{{t}}}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)
