"""Registered queries of the grid operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork import fixtures as fx
from platwork.functions import cells as cf
from platwork.operators import grids as og


def src1_cells_scan(spark: SparkSession, sf: str) -> DataFrame:
    grids = fx.grids(spark, sf).withColumn(
        "band_count",
        F.when((F.col("package_id") % 3 == 2) & (F.col("role") == "terrain"), 2).otherwise(1),
    )
    return og.cells_scan(fx.cells(spark, sf), grids).drop("nodata", "dtype")


def fn1_nodata_pixels(spark: SparkSession, sf: str) -> DataFrame:
    value, marker = F.col("value"), F.lit(fx.NODATA)
    return fx.cells(spark, sf).select(
        "package_id",
        "grid_id",
        "row",
        "col",
        cf.nodata_pixels(value, marker, F.lit("float32")).alias("as_float"),
        cf.nodata_pixels(value, marker, F.lit("int16")).alias("as_int16"),
        cf.nodata_pixels(value, marker, F.lit("uint8")).alias("as_uint8"),
        cf.nodata_pixels(value, F.lit(float("nan")), F.lit("float32")).alias("as_nan_marker"),
    )


def fn2_valid_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return og.cells_scan(fx.cells(spark, sf), fx.grids(spark, sf)).select(
        "package_id",
        "grid_id",
        "row",
        "col",
        cf.valid_pixels(F.col("value"), F.col("mask"), F.col("nodata"), F.col("dtype")).alias(
            "is_valid"
        ),
    )


def fn3_classify_depth(spark: SparkSession, sf: str) -> DataFrame:
    code = cf.classify_depth(
        F.col("value"),
        F.col("mask"),
        F.lit(True),
        F.col("nodata"),
        F.col("dtype"),
        F.col("package_id") % 2 == 0,
        F.lit(1.0),
    )
    return og.cells_scan(fx.depth_cells(spark, sf), fx.grids(spark, sf)).select(
        "package_id", "row", "col", cf.class_label(code).alias("class")
    )


def fn4_pixel_area(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return fx.table(spark, sf, "supplier").select(
        key.alias("grid_key"),
        cf.pixel_area(
            (key % 4).cast("double"), (key % 3) / 2.0, (key % 2).cast("double"), -(key % 5) / 4.0
        ).alias("pixel_area_m2"),
    )


def fn5_grid_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.grids(spark, sf)
        .select("grid_id", F.posexplode(cf.grid_corners()).alias("corner", "v"))
        .select("grid_id", "corner", "v.x", "v.y")
    )


def fn6_grid_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return og.grid_report(fx.grids(spark, sf))


def fn7_tile_assign(spark: SparkSession, sf: str) -> DataFrame:
    return og.tile_inventory(fx.grids(spark, sf), 32)


def fn9_vertical_scale(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("m", "ft", "us-ft", "yd")]), (key % 4 + 1).cast("int"))
    factor = cf.vertical_factor(unit)
    return fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.round(F.floor(F.col("c_acctbal") / 100) / 8 * factor, 6).alias("metres"),
        F.when(factor.isNull(), "MISSING_VERTICAL_UNIT").alias("code"),
    )


def ag1_raster_profile(spark: SparkSession, sf: str) -> DataFrame:
    return og.raster_profile(fx.cells(spark, sf), fx.grids(spark, sf))


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return og.align_nearest(
        fx.terrain_cells(spark, sf), fx.depth_cells(spark, sf), fx.grids(spark, sf)
    )


def jn1_align_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).select(
        "package_id",
        "row",
        "col",
        "covered",
        "depth",
        cf.valid_pixels(
            F.col("terrain"), F.col("terrain_mask"), F.col("terrain_nodata"), F.col("terrain_dtype")
        ).alias("terrain_valid"),
    )


def ag2_class_accounting(spark: SparkSession, sf: str) -> DataFrame:
    grids = fx.grids(spark, sf)
    return og.align_depth(
        fx.terrain_cells(spark, sf), fx.depth_cells(spark, sf), grids, fx.semantics(grids)
    )


def ag3_area_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Conservation must fail for packages that lost some cells on the way."""
    grids = fx.grids(spark, sf)
    classes = og.classify_aligned(_aligned(spark, sf), fx.semantics(grids)).filter(
        ~((F.col("package_id") % 4 == 1) & (F.col("row") == 0) & (F.col("col") < 7))
    )
    return og.class_accounting(classes, grids).select(
        "package_id",
        (F.col("water") + F.col("land") + F.col("unknown")).alias("classified_cells"),
        "expected_cells",
        "conservation_code",
    )


def jn2_resample_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    source = fx.grids(spark, sf).filter("role = 'terrain'")
    shifted = source.withColumns({"c": F.col("c") + 0.25, "f": F.col("f") - 0.25})
    return og.resample_bilinear(fx.terrain_cells(spark, sf), source, shifted).select(
        "package_id", "row", "col", F.round("value", 6).alias("value")
    )


def w1_terrain_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return og.terrain_gradient(fx.terrain_cells(spark, sf), fx.grids(spark, sf)).select(
        "package_id", "row", "col", "dz_dx", "dz_dy", F.round("slope", 6).alias("slope")
    )


def w2_row_run_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    runs = og.row_runs(fx.depth_cells(spark, sf), F.col("value") > 0)
    return og.run_rectangles(runs, fx.grids(spark, sf)).drop("grid_id")


QUERIES = {
    q.__name__: q
    for q in (
        src1_cells_scan,
        fn1_nodata_pixels,
        fn2_valid_pixels,
        fn3_classify_depth,
        fn4_pixel_area,
        fn5_grid_footprint,
        fn6_grid_metadata,
        fn7_tile_assign,
        fn9_vertical_scale,
        ag1_raster_profile,
        jn1_align_nearest,
        ag2_class_accounting,
        ag3_area_conservation,
        jn2_resample_bilinear,
        w1_terrain_gradient,
        w2_row_run_rectangles,
    )
}
