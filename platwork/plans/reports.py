"""Reports over packages: layer profile, water-face report, readiness, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions.attributes import normalize_network
from platwork.functions.cells import pixel_area, tile_of, valid_pixels, vertical_factor
from platwork.model import FOOTPRINT_TOLERANCE_M, LAND, UNKNOWN, WATER
from platwork.operators.conflicts import feature_zone_pairs
from platwork.operators.faces import classify_water_faces, on_cells
from platwork.operators.grids import row_runs, run_rectangles
from platwork.operators.quality import scan_quality, with_validity
from platwork.session import stored


def layer_profile(features: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Per layer: records by geometry state, network forms, background, associations.

    A building is associated if it meets a zone; without zones every one stays pending. Its
    foundation stays unknown either way.
    """
    rows = normalize_network(with_validity(features)).withColumn("_q", F.expr(scan_quality()))
    rows = rows.withColumn("_key", F.concat_ws("\0", "layer", "source_record_id"))
    good = F.col("_q") == "valid_planar_geometry"
    network = good & F.col("layer").contains("Network")
    building = good & (F.col("layer").contains("Building") | F.col("layer").contains("POI"))
    if zones is None:
        rows = rows.withColumn("_met", F.lit(False))
    else:
        # Judged once, read by the join and by the counts.
        rows = stored(rows.drop("props"), "profiled")
        met = (
            feature_zone_pairs(rows.filter(building).select("package_id", "_key", "geom", "is_valid"), zones, "_key", with_area=False)
            .select("package_id", "_key")
            .distinct()
            .withColumn("_met", F.lit(True))
        )
        rows = rows.join(met, ["package_id", "_key"], "left").na.fill(False, ["_met"])

    def state(name: str) -> Column:
        return F.count_if(F.col("_q") == name).alias(name)

    def form(name: str) -> Column:
        return F.count_if(network & (F.coalesce("form", F.lit("unknown")) == name)).alias(
            f"form_{name.lower()}"
        )

    return rows.groupBy("package_id", "layer").agg(
        F.count("*").alias("records_read"),
        state("null_geometry"),
        state("empty_geometry"),
        state("invalid_geometry"),
        state("z_geometry_requires_adapter"),
        state("valid_planar_geometry"),
        form("SURFACE"),
        form("ELEVATED"),
        form("TUNNEL"),
        form("unknown"),
        F.count_if(network & F.col("excluded")).alias("excluded_background"),
        F.count_if(building & F.col("_met")).alias("associated"),
        F.count_if(building & ~F.col("_met")).alias("pending_association"),
        F.count_if(building).alias("foundation_unknown"),
    )


def water_face_report(
    cells: DataFrame, grids: DataFrame, faces: DataFrame, assertions: DataFrame
) -> DataFrame:
    """Classes, areas and height range of the water-face route, with diagnostics.

    assertions: package_id, complete_coverage_confirmed, vertical_unit, vertical_reference.
    One grid per package.
    """
    flagged = on_cells(cells, faces, grids)
    classes = classify_water_faces(flagged, assertions)
    facts = grids.select("package_id", "nodata", "dtype", "a", "b", "d", "e", "width", "height")
    units = assertions.select("package_id", "vertical_unit", "vertical_reference")
    rows = classes.join(facts.join(units, "package_id", "left"), "package_id")
    valid = valid_pixels(F.col("value"), F.col("mask"), F.col("nodata"), F.col("dtype"))
    rows = rows.withColumns({"_valid": valid}).withColumn(
        "_z", F.when(F.col("_valid"), F.col("value").cast("double") * vertical_factor(F.col("vertical_unit")))
    )
    code = F.col("class")
    totals = rows.groupBy("package_id", "grid_id").agg(
        F.count_if(code == WATER).alias("water"),
        F.count_if(code == LAND).alias("land"),
        F.count_if(code == UNKNOWN).alias("unknown"),
        F.count_if("_valid").alias("terrain_valid"),
        F.min("_z").alias("terrain_min_m"),
        F.max("_z").alias("terrain_max_m"),
    )
    unit_area = pixel_area(F.col("a"), F.col("b"), F.col("d"), F.col("e"))
    n_cells = F.col("width").cast("long") * F.col("height")
    rows = totals.join(facts.join(units, "package_id", "left"), "package_id").withColumns(
        {
            "_cells": n_cells,
            "water_m2": F.col("water") * unit_area,
            "land_m2": F.col("land") * unit_area,
            "unknown_m2": F.col("unknown") * unit_area,
            "roi_m2": n_cells * unit_area,
        }
    )
    checks = [
        (vertical_factor(F.col("vertical_unit")).isNull(), "MISSING_VERTICAL_UNIT"),
        (F.col("water") + F.col("land") + F.col("unknown") != F.col("_cells"), "AREA_CONSERVATION"),
        (F.col("unknown") > 0, "WATER_COVERAGE_UNKNOWN"),
        (F.col("terrain_valid") != F.col("_cells"), "TERRAIN_MISSING"),
        (F.col("vertical_reference").isNull(), "VERTICAL_REFERENCE_UNCONFIRMED"),
    ]
    return rows.withColumns(
        {
            "terrain_missing": F.col("_cells") - F.col("terrain_valid"),
            "diagnostics": F.filter(
                F.array(*[F.when(bad, name) for bad, name in checks]), lambda c: c.isNotNull()
            ),
        }
    ).select(
        "package_id",
        "water",
        "land",
        "unknown",
        "water_m2",
        "land_m2",
        "unknown_m2",
        "roi_m2",
        "terrain_valid",
        "terrain_missing",
        "terrain_min_m",
        "terrain_max_m",
        "diagnostics",
        (F.size("diagnostics") == 0).alias("ready"),
    )


def two_route_compare(cells: DataFrame, grids: DataFrame, window: int) -> DataFrame:
    """Positive cells per window, counted directly and by filling their own rectangles."""
    from platwork.functions.geometry import box_geom

    positive = F.col("value") > 0
    grid = grids.select("package_id", "grid_id")
    direct = (
        cells.filter(positive)
        .groupBy("package_id", tile_of(F.col("row"), window).alias("tile_row"), tile_of(F.col("col"), window).alias("tile_col"))
        .agg(F.count("*").alias("direct_cells"))
    )
    rectangles = run_rectangles(row_runs(cells, positive), grids).selectExpr(
        "package_id",
        "'water' AS role",
        "concat(row, '-', col_start) AS face_id",
        f"{box_geom('xmin', 'ymin', 'xmax', 'ymax')} AS geom",
    )
    filled = (
        on_cells(cells.join(grid, ["package_id", "grid_id"]), rectangles, grids)
        .filter("water")
        .groupBy("package_id", tile_of(F.col("row"), window).alias("tile_row"), tile_of(F.col("col"), window).alias("tile_col"))
        .agg(F.count("*").alias("face_cells"))
    )
    keys = ["package_id", "tile_row", "tile_col"]
    return direct.join(filled, keys, "full_outer").select(
        *keys,
        F.coalesce("direct_cells", F.lit(0)).cast("long").alias("direct_cells"),
        F.coalesce("face_cells", F.lit(0)).cast("long").alias("face_cells"),
        F.expr("direct_cells <=> face_cells").alias("agree"),
    )


def readiness(profile: DataFrame, assertions: DataFrame) -> DataFrame:
    """Blocking diagnostics of each package, and what it can be used for.

    profile: package_id, terrain_valid, depth_valid, conserved, terrain_missing,
    depth_outside, unknown. assertions: see `functions.rules.assertion_rules`.
    Nothing missing is ever read as a pass.
    """
    rows = profile.join(assertions, "package_id", "left")

    def passed(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    conditions = {
        "RASTER_EMPTY": (F.col("terrain_valid") > 0) & (F.col("depth_valid") > 0),
        "GRID_UNVERIFIED": F.col("conserved"),
        "TERRAIN_MISSING": F.col("terrain_missing") == 0,
        "DEPTH_OUTSIDE_ROI": F.col("depth_outside") == 0,
        "CARTO_SOURCE_UNCONFIRMED": F.col("carto_source_confirmed"),
        "DEPTH_COVERAGE_UNCONFIRMED": F.col("complete_depth_coverage_confirmed"),
        "LAND_WATER_UNKNOWN": F.col("unknown") == 0,
        "TERRAIN_UNIT_UNCONFIRMED": F.col("terrain_unit") == "m",
        "VERTICAL_REFERENCE_UNCONFIRMED": F.col("terrain_vertical_reference").isNotNull(),
        "GAME_MAPPING_UNCONFIRMED": F.col("game_mapping_confirmed"),
    }
    flags = {f"_{name}": passed(test) for name, test in conditions.items()}
    blocking = F.filter(
        F.array(*[F.when(~F.col(f"_{name}"), name) for name in conditions]),
        lambda c: c.isNotNull(),
    )
    return (
        rows.withColumns(flags)
        .withColumn("blocking", blocking)
        .select(
            "package_id",
            "blocking",
            (F.size("blocking") == 0).alias("planning_ready"),
            F.col("_RASTER_EMPTY").alias("can_read_rasters"),
            F.col("_GRID_UNVERIFIED").alias("can_partition_grid"),
            (
                F.col("_LAND_WATER_UNKNOWN")
                & F.col("_DEPTH_COVERAGE_UNCONFIRMED")
                & F.col("_CARTO_SOURCE_UNCONFIRMED")
            ).alias("complete_land_water"),
        )
    )


def optional_diagnostics(layers: DataFrame) -> DataFrame:
    """Layers with quarantined geometry: degraded, never blocking."""
    issues = (
        F.col("null_geometry")
        + F.col("empty_geometry")
        + F.col("invalid_geometry")
        + F.col("z_geometry_requires_adapter")
    )
    return layers.withColumn("issues", issues).filter("issues > 0").select(
        "package_id",
        "layer",
        F.lit("OPTIONAL_LAYER_QUARANTINE").alias("code"),
        "issues",
        F.lit("degraded").alias("severity"),
    )


def reconcile_declaration(
    declared: DataFrame, observed: DataFrame, differences: DataFrame, references: DataFrame
) -> DataFrame:
    """Declared against observed identity per package; the first failing check decides.

    declared: package_id, confirmed, evidence, version, source_digest, binary_hash.
    observed: package_id, version, source_digest, binary_hash, mapping_code, origin_ok,
    layers_match, dtype, candidates, roundtrip_ok. differences: pinned-file rows with
    package_id and state 'missing' or 'changed'. references: package_id, role, stated and
    expected arrays of numbers, compared within 1e-6.
    """
    pinned = differences.groupBy("package_id").agg(
        F.count_if(F.col("state") == "missing").alias("_missing"),
        F.count_if(F.col("state") == "changed").alias("_changed"),
    )
    close = F.forall(
        F.zip_with("stated", "expected", lambda a, b: F.abs(a - b) <= FOOTPRINT_TOLERANCE_M),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    native = references.groupBy("package_id").agg(
        F.bool_and(F.coalesce(close, F.lit(False))).alias("_native_ok")
    )
    d, o = (lambda c: F.col(f"d_{c}")), (lambda c: F.col(f"o_{c}"))
    left = declared.select("package_id", *[F.col(c).alias(f"d_{c}") for c in declared.columns if c != "package_id"])
    right = observed.select("package_id", *[F.col(c).alias(f"o_{c}") for c in observed.columns if c != "package_id"])
    rows = (
        left.join(right, "package_id", "left").join(pinned, "package_id", "left").join(native, "package_id", "left")
    )

    def no(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    code = (
        F.when(no(d("confirmed")) | (F.trim(F.coalesce(d("evidence"), F.lit(""))) == ""), "EXPORT_VERSION_UNCONFIRMED")
        .when(no(d("version") == o("version")), "UNSUPPORTED_EXPORT_VERSION")
        .when(no(F.lower(d("binary_hash")) == F.lower(o("binary_hash"))), "INSTALLATION_IDENTITY_MISMATCH")
        .when(no(d("source_digest") == o("source_digest")), "STALE_VERSION_DECLARATION")
        .when(F.coalesce("_missing", F.lit(0)) > 0, "PINNED_SOURCE_MISSING")
        .when(F.coalesce("_changed", F.lit(0)) > 0, "PINNED_SOURCE_CHANGED")
        .when(o("mapping_code").isNotNull(), o("mapping_code"))
        .when(no(o("origin_ok") & o("layers_match")), "UNSUPPORTED_MAPPING_CONTEXT")
        .when(no(o("dtype") == "float32"), "UNSUPPORTED_NATIVE_FORMAT")
        .when(no(o("candidates") == 1), "AMBIGUOUS_MAPPING_SOURCE")
        .when(no(F.col("_native_ok")), "NATIVE_REFERENCE_MISMATCH")
        .when(no(o("roundtrip_ok")), "MAPPING_ROUNDTRIP_FAILED")
    )
    return rows.select("package_id", code.alias("code")).withColumn(
        "game_mapping_confirmed", F.col("code").isNull()
    )


def package_summary(
    cells: DataFrame, grids: DataFrame, accounting: DataFrame, assertions: DataFrame
) -> DataFrame:
    """One row per package: grid profiles, alignment and the readiness verdict."""
    from platwork.operators.grids import raster_profile

    profile = raster_profile(cells, grids).join(
        grids.select("package_id", "grid_id", "role"), ["package_id", "grid_id"]
    )

    def of_role(role: str, *names: str) -> list[Column]:
        return [
            F.max(F.when(F.col("role") == role, F.col(n))).alias(f"{role}_{n}") for n in names
        ]

    wide = profile.groupBy("package_id").agg(
        *of_role("terrain", "valid_pixels", "valid_min", "valid_max"),
        *of_role("depth", "valid_pixels", "valid_min", "valid_max"),
    )
    facts = wide.join(accounting, "package_id", "left")
    verdict = readiness(
        facts.select(
            "package_id",
            F.col("terrain_valid_pixels").alias("terrain_valid"),
            F.col("depth_valid_pixels").alias("depth_valid"),
            F.col("conservation_code").isNull().alias("conserved"),
            "terrain_missing",
            "depth_outside",
            "unknown",
        ),
        assertions,
    )
    return facts.join(verdict, "package_id").select(
        "package_id",
        "terrain_valid_pixels",
        "terrain_valid_min",
        "terrain_valid_max",
        "depth_valid_pixels",
        "water",
        "land",
        "unknown",
        "complete",
        "blocking",
        "planning_ready",
        "complete_land_water",
    )
