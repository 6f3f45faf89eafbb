"""Rotation corrections of scenes: bounded least-squares solves, their quality gate, log and reports.

A solve reads one scene's row.  All scenes of an Arrow batch are solved together: stacked 3 x 3 systems, and
masks for the rows whose step is refused and for those that are done.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from ..sources import shared

_ENDS = ("top", "base")


def rotations(q: np.ndarray) -> np.ndarray:
    """The matrix of each rotation vector (n x 3)."""
    angle = np.linalg.norm(q, axis=1)
    axis = q / np.maximum(angle, 1e-300)[:, None]
    k = np.zeros((len(q), 3, 3))
    x, y, z = axis.T
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 0], k[:, 1, 2], k[:, 2, 0], k[:, 2, 1] = -z, y, z, -x, -y, x
    turn = np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)
    return np.eye(3) + np.where((angle < 1e-15)[:, None, None], 0.0, turn)


class Marks:
    """Marked ends of n scenes: matrices (n x 3 x 3), places of the ends relative to the camera (n x 2 x 3), marked pixels
    (n x 2 x 2) and which ends are used (n x 2); f and c are the focal lengths and the image's centre."""

    def __init__(self, original, relative, pixels, used, f, c):
        self.original, self.pixels, self.used = original, pixels, used
        self.seen = np.einsum("nij,nej->nei", original, np.where(used[:, :, None], relative, 0.0))
        self.f, self.c = np.array(f), np.array(c)

    def errors(self, q: np.ndarray, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(predicted minus marked pixels, 0 for unused ends; whether all used ends are before the camera)."""
        used = self.used[at]
        p = np.einsum("nij,nej->nei", rotations(q), self.seen[at])
        ahead = p[:, :, 2] > 1e-6
        z = np.where(used & ahead, p[:, :, 2], 1.0)
        found = self.f * p[:, :, :2] / z[:, :, None] + self.c - self.pixels[at]
        return np.where(used[:, :, None], found, 0.0), (ahead | ~used).all(axis=1)


def solve(marks: Marks, limit_deg: float = 180.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(rotation vectors, successes): Levenberg-Marquardt over three angles where both ends are used, else over two;
    steps that leave the bounds are cut, and those that put an end behind the camera are refused."""
    n = len(marks.used)
    free = np.ones((n, 3), bool)
    free[:, 2] = marks.used.all(axis=1)
    bound = 1.5 * math.radians(limit_deg)
    q, damp, done = np.zeros((n, 3)), np.full(n, 1e-3), np.zeros(n, bool)
    r, good = marks.errors(q)
    r = r.reshape(n, 4)
    active = np.flatnonzero(good & marks.used.any(axis=1))
    for _ in range(steps):
        if not len(active):
            break
        jac = np.zeros((len(active), 4, 3))
        for j in range(3):
            e = q[active]
            e[:, j] += 1e-7
            up, ahead = marks.errors(e, active)
            jac[:, :, j] = np.where((ahead & free[active, j])[:, None], (up.reshape(-1, 4) - r[active]) / 1e-7, 0.0)
        h, g = jac.transpose(0, 2, 1) @ jac, np.einsum("nij,ni->nj", jac, r[active])
        cost = (r[active] ** 2).sum(axis=1)
        trial, after, met = q[active], r[active], np.zeros(len(active), bool)
        for _ in range(20):
            left = np.flatnonzero(~met)
            if not len(left):
                break
            rows = active[left]
            diagonal = np.einsum("nii->ni", h[left]) + 1e-12
            ridge = np.where(free[rows], damp[rows, None] * diagonal, 1.0)
            step = -np.linalg.solve(h[left] + ridge[:, :, None] * np.eye(3), g[left][:, :, None])[:, :, 0]
            tried = np.clip(q[rows] + np.where(free[rows], step, 0.0), -bound, bound)
            errors, ahead = marks.errors(tried, rows)
            errors = errors.reshape(-1, 4)
            better = ahead & ((errors**2).sum(axis=1) <= cost[left])
            trial[left[better]], after[left[better]] = tried[better], errors[better]
            met[left[better]] = True
            damp[rows[~better]] *= 4
        now = (after**2).sum(axis=1)
        small = (np.abs(cost - now) <= 1e-10 * np.maximum(1.0, cost)) | (np.linalg.norm(trial - q[active], axis=1) <= 1e-10)
        rows = active[met]
        q[rows], r[rows] = trial[met], after[met]
        damp[rows] /= 3
        done[active[met & small]] = True
        active = active[met & ~small]
    return q, done


_ERRORS = [f"{when}_err_{axis}_{end}_px" for when in ("pre", "post") for end in _ENDS for axis in "uv"]
_SOLVED = (
    "scene_id string, status string, rx double, ry double, rz double, angle_deg double, clipped boolean, success boolean, pre_error double, post_error double, "
    + ", ".join(f"{e} double" for e in _ERRORS)
    + ", solver_dof int, note string, r_corr array<double>"
)


def _corrected(b: pd.DataFrame, f, c, limit_deg: float) -> pd.DataFrame:
    """A batch of corrections()."""
    n = len(b)
    status = b["status"].fillna("").to_numpy()
    used = np.stack([(status == "full") | (status == f"{e}_only") for e in _ENDS], axis=1) if n else np.zeros((0, 2), bool)
    three = lambda v: np.array([x if x is not None else [np.nan] * 3 for x in v], float).reshape(n, 3)
    cam = three(b["cam"])
    relative = np.stack([three(b[e]) - cam for e in _ENDS], axis=1)
    pixels = np.stack([np.stack([b[f"{axis}_{e}"].to_numpy(float) for axis in "uv"], axis=1) for e in _ENDS], axis=1)
    original = np.array([x for x in b["r"]], float).reshape(n, 3, 3)
    whole = np.isfinite(np.where(used[:, :, None], relative, 0.0)).all(axis=(1, 2)) & np.isfinite(np.where(used[:, :, None], pixels, 0.0)).all(axis=(1, 2))
    whole &= np.isfinite(original).all(axis=(1, 2))
    marks = Marks(np.where(whole[:, None, None], original, np.eye(3)), np.where(whole[:, None, None], relative, 1.0), np.where(whole[:, None, None], pixels, 0.0), used & whole[:, None], f, c)
    q, success = solve(marks, limit_deg)
    angle = np.degrees(np.linalg.norm(q, axis=1))
    clipped = angle > limit_deg
    q = q * np.where(clipped, limit_deg / np.maximum(angle, 1e-300), 1.0)[:, None]
    none, known = status == "none", used.any(axis=1)
    out = {"scene_id": b["scene_id"], "status": b["status"], "rx": q[:, 0], "ry": q[:, 1], "rz": q[:, 2], "angle_deg": np.minimum(angle, limit_deg), "clipped": clipped, "success": success | none}
    for when, v in (("pre", np.zeros_like(q)), ("post", q)):
        e, ahead = marks.errors(v)
        e = np.where((marks.used & ahead[:, None])[:, :, None], e, np.nan)
        lengths = np.hypot(e[:, :, 0], e[:, :, 1])
        out[f"{when}_error"] = np.where(marks.used.any(axis=1) & ahead, np.where(marks.used, lengths, 0.0).sum(axis=1) / np.maximum(marks.used.sum(axis=1), 1), np.nan)
        out |= {f"{when}_err_{axis}_{end}_px": e[:, i, j] for i, end in enumerate(_ENDS) for j, axis in enumerate("uv")}
    out["solver_dof"] = np.where(known & success, np.where(used.all(axis=1), 3, 2), 0).astype(np.int32)
    note = np.where(none, "none is marked, nothing is corrected", np.where(~known, "the status is unknown", np.where(success, "", "the solver failed")))
    return pd.DataFrame(out | {"note": note, "r_corr": list(rotations(q).reshape(n, 9))})


def corrections(marks: DataFrame, intrinsics: tuple[float, float, float, float], limit_deg: float = 180.0) -> DataFrame:
    """marks(scene_id, status, r: 9 numbers, cam, top, base: 3 numbers, u_top, v_top, u_base, v_base).
    status full solves three angles, top_only and base_only two, none is the identity.  A row with an end behind
    the camera, or without a number that its status needs, fails and stays as it is."""
    f, c = intrinsics[:2], intrinsics[2:]
    names = [x.split()[0] for x in _SOLVED.split(", ")]

    def run(batches):
        for b in batches:
            if len(b):
                yield _corrected(b, f, c, limit_deg)[names]

    return marks.mapInPandas(run, _SOLVED)


def correction_log(solved: DataFrame) -> DataFrame:
    """The log's columns of corrections(), and the matrix."""
    turned = [F.degrees(c).alias(f"{c}_deg") for c in ("rx", "ry", "rz")]
    named = [F.nanvl(e, F.lit(None).cast("double")).alias(e) for e in _ERRORS]
    return solved.select(
        "scene_id", F.col("status").alias("annotation_status"), *named, *turned, F.col("angle_deg").alias("rotation_total_deg"),
        "solver_dof", F.col("clipped").alias("clipped_by_max_angle"), "success", "note", "r_corr",
    )


def marked(annotations: DataFrame, documents: DataFrame) -> DataFrame:
    """What corrections() solves: annotations(scene_id, annotation_status, u_top, ..., base_anchor_z)
    with their scenes' documents; annotations of scenes without a document take no part."""
    camera = F.col("meta.camera_model")
    end = lambda e: F.array(*[F.col(f"{e}_anchor_{c}").cast("double") for c in "xyz"]).alias(e)
    return annotations.join(documents, "scene_id").select(
        "scene_id", F.col("annotation_status").alias("status"), F.flatten(camera["world_to_camera_original"]).alias("r"), camera["center_xyz"].alias("cam"),
        end("top"), end("base"), *[F.col(c).cast("double").alias(c) for c in ("u_top", "v_top", "u_base", "v_base")],
    )


def quality_gate(solved: DataFrame, least=5.0, middle=5.0, mean=10.0) -> DataFrame:
    """One row: numbers over the solved scenes, and why the gate is shut ('' if it is open)."""
    some = shared.written(solved.where("status <> 'none'").select("success", "clipped", "angle_deg"))
    middle_of = ranks.percentiles(some, "angle_deg", [0.5]).get(None)
    rows = some.agg(
        F.count("*").alias("solved"), F.count_if(~F.col("success")).alias("failed"), F.count_if("clipped").alias("clipped"),
        F.min("angle_deg").alias("min_angle"), F.lit(middle_of[1][0] if middle_of else None).cast("double").alias("median_angle"), F.avg("angle_deg").alias("mean_angle"),
    )
    why = F.concat_ws(
        ";",
        F.when(F.col("solved") == 0, "nothing_solved"), F.when(F.col("failed") > 0, "failed_scenes"), F.when(F.col("clipped") > 0, "clipped_scenes"),
        F.when(F.col("min_angle") > least, "min_angle"), F.when(F.col("median_angle") > middle, "median_angle"), F.when(F.col("mean_angle") > mean, "mean_angle"),
    )
    return rows.withColumn("reasons", why).withColumn("passed", F.col("reasons") == "")


def worst(table: DataFrame, error: str, n: int = 5) -> DataFrame:
    return table.where(F.col(error).isNotNull() & ~F.isnan(error)).orderBy(F.desc(error), "scene_id").limit(n)


def error_statistics(table: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median and greatest absolute value of each column, long."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.abs(F.col(c)).alias("x")) for c in columns])).alias("e")).select("e.*")
    known = shared.written(long.where("x is not null"))
    middle = ranks.medians(known, "x", "name").select("name", "median")
    return known.groupBy("name").agg(F.avg("x").alias("mean"), F.max("x").alias("max")).join(middle, "name", "left")


def applied(frames: DataFrame, solved: DataFrame) -> DataFrame:
    """frames(scene_id, r11..r33) with c11..c33: the correction times the original matrix where a
    solve of status other than none succeeded, else the original.  The original stays as it is,
    so applying again gives the same, and restoring is choosing the r columns."""
    from ..functions.vectors import product, rotation, vec

    v = ("rx", "ry", "rz")
    angle = F.degrees(F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz")))
    met = frames.join(solved.select("scene_id", "status", "success", *v), "scene_id", "left").withColumn("_angle", angle)
    turn = {f"_t{i}{j}": c for i, row in enumerate(rotation(vec(*v), F.col("_angle")), 1) for j, c in enumerate(row, 1)}
    met = met.withColumns(turn)
    rows = lambda p: tuple(vec(*[f"{p}{i}{j}" for j in (1, 2, 3)]) for i in (1, 2, 3))
    use = F.coalesce(F.col("success") & (F.col("status") != "none"), F.lit(False))
    made = product(rows("_t"), rows("r"))
    out = {f"c{i}{j}": F.when(use, c).otherwise(F.col(f"r{i}{j}")) for i, row in enumerate(made, 1) for j, c in enumerate(row, 1)}
    return met.withColumns(out).select(*frames.columns, *out)
