"""Scene inventory: matching pose tables, quality reports, angle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordinals
from .sizes import small


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an explicit order (file order has none in Spark)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def matched(manifest: DataFrame, brdf: DataFrame, bref: DataFrame) -> DataFrame:
    """manifest left-joined with two pose tables by scene_id; match_status and both flags."""
    out = (
        manifest.join(brdf.withColumn("has_brdf", F.lit(True)), "scene_id", "left")
        .join(bref.withColumn("has_bref", F.lit(True)), "scene_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_brdf", "has_bref")})
    )
    status = (
        F.when(F.col("has_brdf") & F.col("has_bref"), "matched_brdf_bref")
        .when(F.col("has_brdf"), "matched_brdf_only")
        .when(F.col("has_bref"), "matched_bref_only")
        .otherwise("missing_both")
    )
    return out.withColumn("match_status", status)


def quality_report(scenes: DataFrame, excluded: dict[str, str], hdr_data=True, brdf=True, solar=True) -> DataFrame:
    """scenes(scene_id, has_hdr, has_data, has_brdf, has_solar) with reject_reason and final_use."""
    reason = F.create_map(*[F.lit(x) for pair in excluded.items() for x in pair])[F.col("scene_id")] if excluded else F.lit(None).cast("string")
    reasons = [reason]
    for wanted, lacking, name in (
        (hdr_data, ~(F.col("has_hdr") & F.col("has_data")), "missing_hdr_or_data"),
        (brdf, ~F.col("has_brdf"), "missing_brdf_pose"),
        (solar, ~F.col("has_solar"), "missing_solar_geometry"),
    ):
        if wanted:
            reasons.append(F.when(lacking, F.lit(name)))
    return scenes.withColumn("reject_reason", F.concat_ws(";", *reasons)).withColumn("final_use", F.col("reject_reason") == "")


def used(scenes: DataFrame, report: DataFrame) -> DataFrame:
    return scenes.join(report.where("final_use").select("scene_id"), "scene_id", "left_semi")


def suffixed_join(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """A left join in which the right side's clashing columns take a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), key, "left")


def factorized(df: DataFrame, key: str = "scene_id") -> DataFrame:
    """key, suffix and code: the distinct scenes numbered from 0 by the number that ends their name,
    then by name."""
    from ..functions.spectral import numeric_suffix

    names = df.select(F.col(key).cast("string").alias(key)).distinct().withColumn("suffix", numeric_suffix(F.col(key)))
    return ordinals.numbered(names, "suffix", key, name="code").withColumn("code", F.col("code").cast("int"))


def with_code(df: DataFrame, mapping: DataFrame, key: str = "scene_id") -> DataFrame:
    """df with its scenes' codes; -1 for scenes that the mapping lacks."""
    return df.join(small(mapping.select(key, "code")), key, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def with_aggregates(mapping: DataFrame, summary: DataFrame, keys: tuple[str, ...] = ("scene_code", "scene_id")) -> DataFrame:
    """Every scene of the mapping with its sums; counts of scenes without rows are 0."""
    out = mapping.join(summary, list(keys), "left")
    whole = [f.name for f in summary.schema.fields if f.name not in keys and f.dataType.simpleString() in ("int", "bigint")]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in whole})


def pose_chain(manifest: DataFrame, aligned: DataFrame, derived: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes that both the manifest and the aligned poses have, with the poses derived from these
    where there are any; clashing columns take the suffixes _pose and _derived."""
    tasks = manifest.join(aligned.select(key), key, "left_semi")
    return suffixed_join(suffixed_join(tasks, aligned, key, "_pose"), derived, key, "_derived")


def save_documents(documents: DataFrame, path: str) -> None:
    """scene_id and meta as JSON lines, a nested document each."""
    documents.write.json(path)


def load_documents(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def corrected_document(documents: DataFrame, frames: DataFrame) -> DataFrame:
    """documents with world_to_camera from frames(scene_id, c11..c33); the original matrix stays
    beside it, so that restored() gives back what there was."""
    new = frames.select("scene_id", F.array(*[F.array(*[F.col(f"c{i}{j}") for j in (1, 2, 3)]) for i in (1, 2, 3)]).alias("_c"))
    out = documents.join(new, "scene_id", "left")
    camera = F.col("meta.camera_model")
    made = camera.withField("world_to_camera", F.coalesce("_c", camera["world_to_camera"]))
    return out.withColumn("meta", F.col("meta").withField("camera_model", made)).drop("_c")


def restored(documents: DataFrame) -> DataFrame:
    camera = F.col("meta.camera_model")
    return documents.withColumn("meta", F.col("meta").withField("camera_model", camera.withField("world_to_camera", camera["world_to_camera_original"])))


def repaired(scenes: DataFrame, manifest: DataFrame, columns: list[str], key: str = "scene_id") -> DataFrame:
    """scenes with these columns from the manifest, all of them or none: where any is missing in
    scenes, every one is taken from the manifest."""
    lacking = [c for c in columns if c not in scenes.columns]
    base = scenes.withColumns({c: F.lit(None).cast(manifest.schema[c].dataType) for c in lacking})
    other = manifest.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    out = base.join(other, key, "left").withColumn("_whole", whole)
    return out.withColumns({c: F.when(F.col("_whole"), F.col(c)).otherwise(F.col(f"_{c}")) for c in columns}).select(*base.columns)


def document(scenes: DataFrame) -> DataFrame:
    """scene_id and `meta`, a nested document of a scene's camera, angles and matrix (r11..r33)."""
    matrix = lambda name: F.array(*[F.array(*[F.col(f"r{i}{j}") for j in (1, 2, 3)]) for i in (1, 2, 3)]).alias(name)
    have = lambda *names: [F.col(n) for n in names if n in scenes.columns]
    camera = F.struct(
        F.array("cam_x", "cam_y", "cam_z").alias("center_xyz"), matrix("world_to_camera"), matrix("world_to_camera_original"),
        *have("width", "height", "fov_h_deg", "fov_v_deg"),
    )
    sun = have("solar_zenith_deg", "solar_azimuth_deg", "sun_x", "sun_y", "sun_z")
    return scenes.select("scene_id", F.struct(camera.alias("camera_model"), *([F.struct(*sun).alias("sun")] if sun else [])).alias("meta"))


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select("scene_id", F.to_json("meta").alias("json"))


def from_json(texts: DataFrame, schema) -> DataFrame:
    """scene_id and meta of (scene_id, json)."""
    return texts.select("scene_id", F.from_json("json", schema).alias("meta"))
