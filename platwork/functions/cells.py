"""Cell-level column expressions: validity, classes, areas, affine corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platwork.model import INTEGER_RANGES, LAND, TILE, UNCERTAIN, UNKNOWN, VERTICAL_FACTORS, WATER


def is_finite(value: Column) -> Column:
    """True for ordinary numbers. Spark orders NaN above everything, so test it first."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def nodata_pixels(value: Column, nodata: Column, dtype: Column) -> Column:
    """Does a cell hold its grid's NoData value, compared in the grid's own type?"""
    value = value.cast("double")
    nodata = nodata.cast("double")
    verdict = F.when(nodata.isNull(), F.lit(False)).when(F.isnan(nodata), F.isnan(value))
    for name, (low, high) in INTEGER_RANGES.items():
        fits = nodata.between(low, high) & (nodata == F.floor(nodata))
        verdict = verdict.when(dtype == name, fits & (value == nodata))
    verdict = verdict.when(dtype == "float64", value == nodata)
    return F.coalesce(verdict.otherwise(value == nodata.cast("float").cast("double")), F.lit(False))


def valid_pixels(value: Column, mask: Column, nodata: Column, dtype: Column) -> Column:
    """A cell counts only if unmasked, finite and not NoData."""
    present = F.coalesce(mask > 0, F.lit(False))
    return present & is_finite(value) & ~nodata_pixels(value, nodata, dtype)


def classify_depth(
    value: Column,
    mask: Column,
    covered: Column,
    nodata: Column,
    dtype: Column,
    nodata_is_land: Column,
    near_zero_m: Column,
) -> Column:
    """Class code of a depth cell. Missing depth is land only under a declared rule."""
    covered = F.coalesce(covered, F.lit(False))
    usable = covered & valid_pixels(value, mask, nodata, dtype)
    dry = F.coalesce(nodata_is_land, F.lit(False)) & covered & nodata_pixels(value, nodata, dtype)
    return (
        F.when(dry, LAND)
        .when(usable & (value > near_zero_m), WATER)
        .when(usable & (F.abs(value) <= near_zero_m), UNCERTAIN)
        .otherwise(UNKNOWN)
        .cast("int")
    )


def class_label(code: Column) -> Column:
    return (
        F.when(code == WATER, "water")
        .when(code == LAND, "land")
        .when(code == UNCERTAIN, "uncertain")
        .otherwise("unknown")
    )


def pixel_area(a: Column, b: Column, d: Column, e: Column) -> Column:
    """Absolute determinant of the affine map; NULL when the map is singular."""
    area = F.abs(a * e - b * d)
    return F.when(is_finite(area) & (area > 0), area)


def affine_x(col: Column, row: Column) -> Column:
    return F.col("a") * col + F.col("b") * row + F.col("c")


def affine_y(col: Column, row: Column) -> Column:
    return F.col("d") * col + F.col("e") * row + F.col("f")


def grid_corners() -> Column:
    """The four corners of a grid row, in ring order."""
    zero = F.lit(0.0)
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    corners = [(zero, zero), (width, zero), (width, height), (zero, height)]
    return F.array(
        *[F.struct(affine_x(c, r).alias("x"), affine_y(c, r).alias("y")) for c, r in corners]
    )


def tile_of(index: Column, size: int = TILE) -> Column:
    return F.floor(index / F.lit(size)).cast("int")


def vertical_factor(unit: Column) -> Column:
    """Metres per unit; NULL for an undeclared unit."""
    factor = F.lit(None).cast("double")
    for name, value in VERTICAL_FACTORS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return factor
