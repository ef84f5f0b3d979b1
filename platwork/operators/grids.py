"""Grid work on cell tables: profile, align, classify, account, resample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.functions.cells import (
    affine_x,
    affine_y,
    classify_depth,
    grid_corners,
    is_finite,
    pixel_area,
    tile_of,
    valid_pixels,
)
from platwork.model import LAND, TILE, UNCERTAIN, UNKNOWN, WATER

GRID_COLUMNS = ("a", "b", "c", "d", "e", "f", "width", "height", "nodata", "dtype")


def cells_scan(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells of single-band grids with their tile; other grids are left to the report."""
    single = grids.filter("band_count = 1").select("package_id", "grid_id", "nodata", "dtype")
    return cells.join(single, ["package_id", "grid_id"]).withColumns(
        {"tile_row": tile_of(F.col("row")), "tile_col": tile_of(F.col("col"))}
    )


def grid_report(grids: DataFrame) -> DataFrame:
    """Shape, bounds, cell area and stated units of each grid; unsaid facts are 'unknown'."""
    corners = grid_corners()
    xs = F.transform(corners, lambda v: v["x"])
    ys = F.transform(corners, lambda v: v["y"])
    return grids.select(
        "package_id",
        "grid_id",
        "width",
        "height",
        "crs",
        "dtype",
        "nodata",
        F.coalesce("band_unit", F.lit("unknown")).alias("band_unit"),
        F.array_min(xs).alias("left_x"),
        F.array_min(ys).alias("bottom_y"),
        F.array_max(xs).alias("right_x"),
        F.array_max(ys).alias("top_y"),
        pixel_area(F.col("a"), F.col("b"), F.col("d"), F.col("e")).alias("pixel_area_m2"),
        F.lit("unknown").alias("vertical_datum"),
        F.when(F.col("band_count") != 1, "UNSUPPORTED_BANDS")
        .when(
            pixel_area(F.col("a"), F.col("b"), F.col("d"), F.col("e")).isNull(), "INVALID_TRANSFORM"
        )
        .alias("code"),
    )


def tile_inventory(grids: DataFrame, size: int = TILE) -> DataFrame:
    """The windows that cut each grid, ragged at the right and lower edge."""
    if size <= 0:
        raise ValueError("INVALID_WINDOW: positive window size required")

    def steps(extent: str) -> Column:
        return F.explode(F.sequence(F.lit(0), tile_of(F.col(extent) - 1, size)))

    return (
        grids.select("package_id", "grid_id", "width", "height", steps("height").alias("tile_row"))
        .withColumn("tile_col", steps("width"))
        .select(
            "package_id",
            "grid_id",
            "tile_row",
            "tile_col",
            F.least(F.lit(size), F.col("width") - F.col("tile_col") * size).alias("tile_width"),
            F.least(F.lit(size), F.col("height") - F.col("tile_row") * size).alias("tile_height"),
        )
    )


def raster_profile(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Counts and range of each grid, as one partial plus final aggregate.

    A grid without cells counts zero of everything and has no range.
    """
    value = F.col("value")
    valid = valid_pixels(value, F.col("mask"), F.col("nodata"), F.col("dtype"))
    counts = ("valid_pixels", "finite_pixels", "valid_zero_pixels", "valid_negative_pixels")
    counted = (
        cells_scan(cells, grids)
        .withColumn("_valid", valid)
        .groupBy("package_id", "grid_id")
        .agg(
            F.count_if("_valid").alias("valid_pixels"),
            F.count_if(is_finite(value)).alias("finite_pixels"),
            F.count_if(F.col("_valid") & (value == 0)).alias("valid_zero_pixels"),
            F.count_if(F.col("_valid") & (value < 0)).alias("valid_negative_pixels"),
            F.min(F.when(F.col("_valid"), value)).cast("double").alias("valid_min"),
            F.max(F.when(F.col("_valid"), value)).cast("double").alias("valid_max"),
        )
    )
    return grids.select("package_id", "grid_id").join(counted, ["package_id", "grid_id"], "left").na.fill(
        0, list(counts)
    )


def _source_index(prefix: str) -> tuple[Column, Column]:
    """Fractional source column and row of the point (_x, _y)."""
    g = lambda name: F.col(f"{prefix}{name}")
    det = g("a") * g("e") - g("b") * g("d")
    dx, dy = F.col("_x") - g("c"), F.col("_y") - g("f")
    return (
        F.try_divide(g("e") * dx - g("b") * dy, det),
        F.try_divide(g("a") * dy - g("d") * dx, det),
    )


def _grid_of(grids: DataFrame, role: str, prefix: str) -> DataFrame:
    return grids.filter(F.col("role") == role).select(
        "package_id",
        F.col("grid_id").alias(f"{prefix}grid_id"),
        *[F.col(name).alias(f"{prefix}{name}") for name in GRID_COLUMNS],
    )


def align_nearest(terrain: DataFrame, depth: DataFrame, grids: DataFrame) -> DataFrame:
    """Depth value, mask and coverage on every terrain cell, nearest neighbour.

    The source index of a cell centre is arithmetic, so the alignment is one left
    equi-join on (package, row, col); cells off the depth grid stay uncovered.
    """
    target = _grid_of(grids, "terrain", "t_")
    source = _grid_of(grids, "depth", "s_")
    located = (
        terrain.join(target.join(source, "package_id", "left"), "package_id")
        .filter(F.col("grid_id") == F.col("t_grid_id"))
        .withColumns(
            {
                "_x": F.col("t_a") * (F.col("col") + 0.5)
                + F.col("t_b") * (F.col("row") + 0.5)
                + F.col("t_c"),
                "_y": F.col("t_d") * (F.col("col") + 0.5)
                + F.col("t_e") * (F.col("row") + 0.5)
                + F.col("t_f"),
            }
        )
    )
    u, v = _source_index("s_")
    located = located.withColumns({"_u": F.floor(u), "_v": F.floor(v)}).withColumn(
        "covered",
        F.coalesce(
            (F.col("_u") >= 0)
            & (F.col("_u") < F.col("s_width"))
            & (F.col("_v") >= 0)
            & (F.col("_v") < F.col("s_height")),
            F.lit(False),
        ),
    )
    sampled = depth.select(
        "package_id",
        F.col("grid_id").alias("s_grid_id"),
        F.col("row").cast("long").alias("_v"),
        F.col("col").cast("long").alias("_u"),
        F.col("value").alias("depth"),
        F.col("mask").alias("depth_mask"),
    )
    return located.join(sampled, ["package_id", "s_grid_id", "_v", "_u"], "left").select(
        "package_id",
        "grid_id",
        "row",
        "col",
        F.col("value").alias("terrain"),
        F.col("mask").alias("terrain_mask"),
        F.col("t_nodata").alias("terrain_nodata"),
        F.col("t_dtype").alias("terrain_dtype"),
        "covered",
        "depth",
        "depth_mask",
        F.col("s_nodata").alias("depth_nodata"),
        F.col("s_dtype").alias("depth_dtype"),
    )


def classify_aligned(aligned: DataFrame, semantics: DataFrame) -> DataFrame:
    """Class code of every aligned cell, plus whether its terrain is usable."""
    declared = semantics.select("package_id", "nodata_is_land", "near_zero_m")
    return aligned.join(declared, "package_id", "left").select(
        "package_id",
        "grid_id",
        "row",
        "col",
        "covered",
        classify_depth(
            F.col("depth"),
            F.col("depth_mask"),
            F.col("covered"),
            F.col("depth_nodata"),
            F.col("depth_dtype"),
            F.col("nodata_is_land"),
            F.coalesce(F.col("near_zero_m"), F.lit(0.0)),
        ).alias("class"),
        valid_pixels(
            F.col("terrain"), F.col("terrain_mask"), F.col("terrain_nodata"), F.col("terrain_dtype")
        ).alias("terrain_valid"),
    )


def class_accounting(classes: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells and area per class and package, with the conservation check.

    `classes` holds one row per cell: package_id, grid_id, class, terrain_valid, covered.
    A terrain grid without a single cell has lost all of its area.
    """
    code = F.col("class")
    counted = classes.groupBy("package_id", "grid_id").agg(
        F.count_if(code == WATER).alias("water"),
        F.count_if(code == LAND).alias("land"),
        F.count_if(code.isin(UNKNOWN, UNCERTAIN)).alias("unknown"),
        F.count_if(code == UNCERTAIN).alias("near_zero_uncertain"),
        F.count_if(~F.col("terrain_valid")).alias("terrain_missing"),
        F.count_if(~F.col("covered")).alias("depth_outside"),
    )
    sized = grids.filter("role = 'terrain'").select(
        "package_id",
        "grid_id",
        (F.col("width").cast("long") * F.col("height")).alias("expected_cells"),
        pixel_area(F.col("a"), F.col("b"), F.col("d"), F.col("e")).alias("_area"),
    )
    total = F.col("water") + F.col("land") + F.col("unknown")
    counts = [c for c in counted.columns if c not in ("package_id", "grid_id")]
    return sized.join(counted, ["package_id", "grid_id"], "left").na.fill(0, counts).select(
        "package_id",
        "water",
        "land",
        "unknown",
        "near_zero_uncertain",
        "terrain_missing",
        "depth_outside",
        "expected_cells",
        (F.col("water") * F.col("_area")).alias("water_m2"),
        (F.col("land") * F.col("_area")).alias("land_m2"),
        (F.col("unknown") * F.col("_area")).alias("unknown_m2"),
        (F.col("expected_cells") * F.col("_area")).alias("roi_m2"),
        F.when(total != F.col("expected_cells"), "AREA_CONSERVATION").alias("conservation_code"),
        ((F.col("unknown") == 0) & (F.col("terrain_missing") == 0)).alias("complete"),
    )


def align_depth(
    terrain: DataFrame, depth: DataFrame, grids: DataFrame, semantics: DataFrame
) -> DataFrame:
    """Water / land / unknown accounting of a depth grid on the terrain grid."""
    classes = classify_aligned(align_nearest(terrain, depth, grids), semantics)
    return class_accounting(classes, grids)


def orientation_codes(grids: DataFrame) -> DataFrame:
    """Grids with UNSUPPORTED_GRID_ORIENTATION where rows and columns do not run along the axes."""
    turned = (F.col("b") != 0) | (F.col("d") != 0)
    return grids.select(
        "package_id", "grid_id", F.when(turned, "UNSUPPORTED_GRID_ORIENTATION").alias("code")
    )


def resample_bilinear(cells: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Source grid values on a target grid of the same package, NoData aware.

    A triangle kernel, widened for coarser targets, spreads every valid source cell
    to the target centres in its reach; weights are summed over valid cells only.
    Scattering from the source keeps the work to one aggregate and no join of cells.
    `source` and `target` hold one grid per package. Turned or sheared grids on either side
    give no values; `orientation_codes` says which they are.
    """
    upright = "b = 0 AND d = 0"
    s = source.filter(upright).select(
        "package_id", "grid_id", *[F.col(n).alias(f"s_{n}") for n in GRID_COLUMNS]
    )
    t = target.filter(upright).select(
        "package_id",
        F.col("grid_id").alias("target_id"),
        *[F.col(n).alias(f"t_{n}") for n in GRID_COLUMNS],
    )
    rows = cells.join(s.join(t, "package_id"), ["package_id", "grid_id"]).filter(
        valid_pixels(F.col("value"), F.col("mask"), F.col("s_nodata"), F.col("s_dtype"))
    )

    def reach(axis_scale: str, offset: str, index: str) -> tuple[Column, Column]:
        # Source centre in target cells, and kernel half width in target cells.
        scale = F.try_divide(F.col(f"s_{axis_scale}"), F.col(f"t_{axis_scale}"))
        centre = (
            F.try_divide(F.col(f"s_{offset}") - F.col(f"t_{offset}"), F.col(f"t_{axis_scale}"))
            + scale * (F.col(index) + 0.5)
            - 0.5
        )
        return centre, F.greatest(F.abs(scale), F.lit(1.0))

    u, half_u = reach("a", "c", "col")
    v, half_v = reach("e", "f", "row")
    rows = rows.withColumns({"_u": u, "_hu": half_u, "_v": v, "_hv": half_v})

    def span(centre: str, half: str, limit: str) -> Column:
        low = F.greatest(F.floor(F.col(centre) - F.col(half)) + 1, F.lit(0))
        high = F.least(F.ceil(F.col(centre) + F.col(half)) - 1, F.col(limit).cast("long") - 1)
        return F.when(low <= high, F.sequence(low, high))

    weight = (1.0 - F.abs(F.col("tcol") - F.col("_u")) / F.col("_hu")) * (
        1.0 - F.abs(F.col("trow") - F.col("_v")) / F.col("_hv")
    )
    def inside(axis: str, offset: str, index: str, limit: str) -> Column:
        # A target cell counts only if its centre lies on the source grid.
        at = F.try_divide(
            F.col(f"t_{offset}")
            + F.col(f"t_{axis}") * (F.col(index) + 0.5)
            - F.col(f"s_{offset}"),
            F.col(f"s_{axis}"),
        )
        return (at >= 0) & (at < F.col(f"s_{limit}"))

    return (
        rows.withColumn("tcol", F.explode(span("_u", "_hu", "t_width")))
        .withColumn("trow", F.explode(span("_v", "_hv", "t_height")))
        .filter(inside("a", "c", "tcol", "width") & inside("e", "f", "trow", "height"))
        .withColumn("_w", weight)
        .groupBy("package_id", "target_id", "trow", "tcol")
        .agg(
            F.sum(F.col("_w") * F.col("value")).alias("_sum"),
            F.sum("_w").alias("_weight"),
        )
        .filter("_weight > 0.00001")
        .select(
            "package_id",
            F.col("target_id").alias("grid_id"),
            F.col("trow").cast("int").alias("row"),
            F.col("tcol").cast("int").alias("col"),
            (F.col("_sum") / F.col("_weight")).alias("value"),
        )
    )


def terrain_gradient(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Slope by central differences, one-sided at the grid edge; unknown stays NULL.

    Both windows run inside single grid rows or columns, never over a whole grid.
    """
    grid = grids.select("package_id", "grid_id", *GRID_COLUMNS)
    height = F.when(
        valid_pixels(F.col("value"), F.col("mask"), F.col("nodata"), F.col("dtype")), F.col("value")
    ).cast("double")
    rows = cells.join(grid, ["package_id", "grid_id"]).withColumn("_z", height)

    def slope(index: str, other: str, last: Column, step: Column) -> Column:
        line = Window.partitionBy("package_id", "grid_id", other).orderBy(index)
        here = F.col(index)
        before = F.when(F.lag(index).over(line) == here - 1, F.lag("_z").over(line))
        after = F.when(F.lead(index).over(line) == here + 1, F.lead("_z").over(line))
        return (
            F.when(here == 0, (after - F.col("_z")) / step)
            .when(here == last, (F.col("_z") - before) / step)
            .otherwise((after - before) / (2.0 * step))
        )

    return (
        rows.withColumn("dz_dx", slope("col", "row", F.col("width") - 1, F.abs(F.col("a"))))
        .withColumn("dz_dy", slope("row", "col", F.col("height") - 1, F.abs(F.col("e"))))
        .select(
            "package_id",
            "grid_id",
            "row",
            "col",
            "dz_dx",
            "dz_dy",
            F.hypot("dz_dx", "dz_dy").alias("slope"),
        )
    )


def row_runs(cells: DataFrame, positive: Column) -> DataFrame:
    """Neighbouring positive cells of a row merged into one run (gaps and islands)."""
    line = Window.partitionBy("package_id", "grid_id", "row").orderBy("col")
    return (
        cells.filter(positive)
        .withColumn("_island", F.col("col") - F.row_number().over(line))
        .groupBy("package_id", "grid_id", "row", "_island")
        .agg(F.min("col").alias("col_start"), F.max("col").alias("col_end"))
        .drop("_island")
    )


def run_rectangles(runs: DataFrame, grids: DataFrame) -> DataFrame:
    """Runs as rectangles in map coordinates (north-up grids)."""
    grid = grids.select("package_id", "grid_id", "a", "b", "c", "d", "e", "f")
    zero = F.lit(0)
    y_top, y_low = affine_y(zero, F.col("row")), affine_y(zero, F.col("row") + 1)
    return runs.join(grid, ["package_id", "grid_id"]).select(
        "package_id",
        "grid_id",
        "row",
        "col_start",
        "col_end",
        affine_x(F.col("col_start"), zero).alias("xmin"),
        F.least(y_top, y_low).alias("ymin"),
        affine_x(F.col("col_end") + 1, zero).alias("xmax"),
        F.greatest(y_top, y_low).alias("ymax"),
    )
