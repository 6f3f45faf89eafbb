"""Band names, index-band corrections, vegetation indices, stretching and name parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands that hold indices, and those stored plus one.
INDEX_BANDS = {165: "NDVI", 166: "RVI", 167: "MSAVI", 168: "NDWI"}
STORED_PLUS_ONE = (165, 167, 168)


def scene_key_from_name(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"(?i)_ref$", "")


def scene_key_from_label(label: Column) -> Column:
    base = F.regexp_replace(F.trim(label), r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(base, r"(?i)\.tiff?$", ""), r"(?i)_pan$", "")


def header_text(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " ()", "")


def numeric_suffix(scene: Column) -> Column:
    digits = F.regexp_extract(scene, r"(\d+)$", 1)
    return F.when(digits == "", F.lit(1_000_000_000)).otherwise(digits.try_cast("long"))


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def corrected(value: Column, band: Column) -> Column:
    return F.when(band.isin(*STORED_PLUS_ONE), value - 1.0).otherwise(value)


#: What indices() takes, in its order: the wavelength in nm, and the band's usual number.
INDEX_SOURCES = {"green": (550.0, 51), "red": (670.0, 81), "edge": (718.0, 93), "nir802": (802.0, 114), "nir850": (850.0, 126)}


def band_name(band: Column) -> Column:
    out = F.concat(F.lit("band_"), band.cast("string"))
    for number, name in INDEX_BANDS.items():
        out = F.when(band == number, name).otherwise(out)
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-12, a / F.when(F.abs(b) > 1e-12, b)).otherwise(F.lit(0.0))


def indices(green: Column, red: Column, edge: Column, nir802: Column, nir850: Column) -> dict[str, Column]:
    root = F.sqrt(F.greatest((2.0 * nir802 + 1.0) * (2.0 * nir802 + 1.0) - 8.0 * (nir802 - edge), F.lit(0.0)))
    return {
        "ndvi": _ratio(nir850 - red, nir850 + red),
        "rvi": _ratio(nir802, edge),
        "msavi": (2.0 * nir802 + 1.0 - root) / 2.0,
        "ndwi": _ratio(green - nir850, green + nir850),
    }


def ndvi(red: Column, nir: Column) -> Column:
    """Null where the sum vanishes."""
    total = nir + red
    return (nir - red) / F.when(F.abs(total) > 1e-12, total)


def parse_bands(spec: str, n_bands: int) -> list[int]:
    """'1:164,200' as sorted distinct numbers, inclusive, inside 1..n_bands."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        ends = [int(x) for x in re.split(r"[:-]", part)]
        if len(ends) > 2 or min(ends) < 1 or max(ends) > n_bands:
            raise ValueError(f"band {part} is outside 1..{n_bands}")
        out.update(range(ends[0], ends[-1] + 1))
    if not out:
        raise ValueError("no bands")
    return sorted(out)


def select_bands(wavelengths: list[float], numbers: list[int] | None = None, targets: list[float] | None = None) -> list[int]:
    """Band numbers: all, the given ones, or those nearest to target wavelengths."""
    if numbers:
        bad = [b for b in numbers if not 1 <= b <= len(wavelengths)]
        if bad:
            raise ValueError(f"bands {bad} are outside 1..{len(wavelengths)}")
        return sorted(set(numbers))
    if targets:
        return sorted({min(range(len(wavelengths)), key=lambda i: abs(wavelengths[i] - t)) + 1 for t in targets})
    return list(range(1, len(wavelengths) + 1))


def directional_bands(wanted: list[int], for_table: list[int], n_bands: int) -> list[int]:
    """Both lists' band numbers in order, those outside 1..n_bands left out."""
    return sorted({b for b in [*wanted, *for_table] if 1 <= b <= n_bands})


def nearest_band(wavelengths: list[float | None], target: float, fallback: int, tolerance: float = 3.0) -> int:
    """The number of the nearest valid wavelength within the tolerance, or the fallback."""
    near = [(abs(w - target), i + 1) for i, w in enumerate(wavelengths) if w is not None and w > 0]
    return min(near)[1] if near and min(near)[0] <= tolerance else fallback


def gaussian_support(sigma_px: float = 8.0, gsd_m=0.06125232) -> dict:
    """The support's width in pixels and metres; gsd_m, the ground sampling distance, is a number or a column."""
    return {"sigma_px": sigma_px, "sigma_m": sigma_px * gsd_m, "fwhm_m": 2.35482 * sigma_px * gsd_m}
