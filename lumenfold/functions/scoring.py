"""Scores and weights of views, with the parameters of the default configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip, clip01

COARSE = {"border": 0.01, "offaxis": 0.4, "range": 0.005, "surface": 4.0, "vertical": 0.12}
SELECTION = {"coarse": 0.2, "cone": 0.7, "blocker": 0.45, "offaxis": 0.2, "range": 0.006, "surface": 1.0, "vertical": 0.3, "floor": 0.25}
RAW = {
    "coarse": 6.0, "offaxis": 28.0, "range": 80.0, "border": 120.0, "cone": 25.0, "blocker": 0.5, "clear": 1.0, "unclear": 0.25,
    "align_floor": 0.05, "align_power": 1.0, "vertical_boost": 2.5, "vertical_power": 1.0, "floor": 0.25, "least": 1e-6,
}
ADAPTIVE = {
    "temperature": 45.0, "range": 240.0, "offaxis": 120.0, "cone": 30.0, "cone_floor": 0.75, "blocker": 0.35, "unclear": 0.2,
    "floor": 0.25, "align_floor": 0.05, "align_power": 1.0, "vertical": 4.0, "zenith": 60.0,
}


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -60.0, 60.0)))


def _reliability(confidence: Column, floor: float) -> Column:
    return floor + (1.0 - floor) * clip01(confidence)


def coarse(distance, offaxis, range_m, surface_cos, zenith, verticality, confidence, p=COARSE) -> Column:
    trust = 0.25 + 0.75 * confidence
    bonus = p["surface"] * surface_cos * trust + p["vertical"] * zenith * verticality * trust
    return p["border"] * distance - p["offaxis"] * offaxis - p["range"] * range_m + bonus


def selection(coarse_score, cone, blockers, offaxis, range_m, zenith, surface_cos, verticality, confidence, p=SELECTION) -> Column:
    trust = _reliability(confidence, p["floor"])
    return (
        p["coarse"] * coarse_score + p["cone"] * cone - p["blocker"] * blockers - p["offaxis"] * offaxis - p["range"] * range_m
        + p["surface"] * clip01(surface_cos) * trust
        + p["vertical"] * F.greatest(zenith, F.lit(0.0)) * clip01(verticality) * trust
    )


def raw_weight(coarse_score, cone, blockers, offaxis, range_m, border, clear, zenith, surface_cos, verticality, confidence, p=RAW) -> Column:
    """The product of eleven terms, each of one property of a view."""
    positive = lambda x: F.greatest(x, F.lit(0.0))
    fades = lambda x, scale: F.exp(-positive(x) / scale)
    grows = lambda x, scale: F.greatest(1.0 - F.exp(-positive(x) / scale), F.lit(1e-6))
    trust = _reliability(confidence, p["floor"])
    surface = p["align_floor"] + (1.0 - p["align_floor"]) * F.pow(clip01(surface_cos), F.lit(p["align_power"])) * trust
    steep = F.pow(clip01(positive(zenith) / 90.0), F.lit(p["vertical_power"]))
    vertical = 1.0 + p["vertical_boost"] * clip01(verticality) * steep * trust
    seen = F.when(clear, F.lit(p["clear"])).otherwise(F.lit(p["unclear"]))
    product = (
        sigmoid(coarse_score / p["coarse"]) * fades(offaxis, p["offaxis"]) * fades(range_m, p["range"]) * grows(border, p["border"])
        * grows(cone, p["cone"]) * F.exp(-p["blocker"] * positive(blockers)) * seen * surface * vertical
    )
    return F.greatest(product, F.lit(p["least"]))


MODES = ("raw", "hybrid", "surface_adaptive", "softmax")


def base_weight(mode: str, best: Column, temperature: float = 30.0, power: float = 1.0, p=ADAPTIVE) -> Column:
    """A view's weight before normalisation; best: the greatest visibility score of its point."""
    score, raw = F.col("visibility_score"), F.col("view_weight_raw")
    soft = lambda t: F.exp(clip((score - best) / t, -60.0, 60.0))
    if mode == "raw":
        return raw
    if mode == "hybrid":
        return soft(temperature) * F.pow(F.greatest(raw, F.lit(1e-18)), F.lit(power))
    if mode != "surface_adaptive":
        return soft(temperature)
    positive = lambda c: F.greatest(F.col(c), F.lit(0.0))
    trust = _reliability(F.col("normal_confidence"), p["floor"])
    cone = p["cone_floor"] + (1.0 - p["cone_floor"]) * (1.0 - F.exp(-positive("local_empty_cone_deg") / p["cone"]))
    align = p["align_floor"] + (1.0 - p["align_floor"]) * F.pow(clip01(F.col("surface_view_cos")), F.lit(p["align_power"]))
    steep = clip01(F.col("view_zenith_deg") / p["zenith"])
    return (
        soft(p["temperature"]) * F.exp(-positive("range_m") / p["range"]) * F.exp(-positive("offaxis_deg") / p["offaxis"]) * cone
        * F.exp(-p["blocker"] * positive("blocker_count")) * F.when(F.col("is_clear"), 1.0).otherwise(p["unclear"]) * align
        * F.exp(p["vertical"] * clip01(F.col("surface_verticality")) * steep * trust)
    )


#: (offaxis at most, cone at least, border at least, zenith at most)
HIGH, MEDIUM = (20.0, 15.0, 80.0, 60.0), (35.0, 8.0, 30.0, 70.0)


def quality_level(high=HIGH, medium=MEDIUM) -> Column:
    """high, medium or low for observations with the usual column names."""
    sound = F.col("is_clear") & ~F.lower(F.col("selection_method")).contains("fallback") & (F.col("blocker_count") <= 0)

    def within(limits):
        return (
            sound
            & (F.col("offaxis_deg") <= limits[0])
            & (F.col("local_empty_cone_deg") >= limits[1])
            & (F.col("border_dist_px") >= limits[2])
            & (F.col("view_zenith_deg") <= limits[3])
        )

    return F.when(within(high), "high").when(within(medium), "medium").otherwise("low")


def point_quality(clear: Column, zenith_range: Column, primary: Column) -> Column:
    return F.when((clear >= 5) & (zenith_range >= 20.0) & (primary <= 0.85), "high").when(clear >= 3, "medium").otherwise("low")


def rejected_because(**reasons: Column) -> Column:
    """Names of the true conditions joined by '+', or 'none'."""
    text = F.concat_ws("+", *[F.when(c, F.lit(name)) for name, c in reasons.items()])
    return F.when(text == "", "none").otherwise(text)
