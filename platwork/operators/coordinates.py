"""Coordinate work: reprojection of vertex tables, game-plane mapping, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions.cells import is_finite
from platwork.functions.crs import (
    metric_crs_code,
    tm_forward,
    tm_inverse,
    transform_code,
    with_crs,
)
from platwork.functions.geometry import bbox_of, edges_of
from platwork.functions.rules import blank, first_violation
from platwork.model import (
    COVERAGE_TOLERANCE_M,
    DENSIFY_DEGREES,
    DENSIFY_METRES,
    FOOTPRINT_TOLERANCE_M,
    ROUNDTRIP_TOLERANCE_M,
)


def metric_crs_check(rows: DataFrame, crs: str = "crs") -> DataFrame:
    """Add `crs_code`: NULL for projected metre systems."""
    return (
        with_crs(rows, crs, "_facts")
        .withColumn("crs_code", metric_crs_code(F.col(crs), F.col("_facts")))
        .drop("_facts")
    )


def reproject_vertices(vertices: DataFrame) -> DataFrame:
    """x, y from source_crs to target_crs; rows that cannot be transformed get a code.

    Adds tx, ty and transform_code. Identity when both systems are the same.
    """
    rows = with_crs(with_crs(vertices, "source_crs", "_src"), "target_crs", "_dst")
    same = F.col("source_crs") == F.col("target_crs")
    geographic = F.col("_src.kind") == "geographic"
    out_of_domain = geographic & ~(
        F.col("x").between(-180.0, 180.0) & F.col("y").between(-90.0, 90.0)
    )
    rows = rows.withColumn(
        "transform_code",
        F.when(same, F.lit(None))
        .when(
            transform_code(F.col("_src"), F.col("_dst")).isNotNull(),
            transform_code(F.col("_src"), F.col("_dst")),
        )
        .when(F.coalesce(out_of_domain, F.lit(True)), "INVALID_TRANSFORM_DOMAIN"),
    )
    good = F.col("transform_code").isNull() & ~same
    rows = tm_inverse(
        rows.withColumns(
            {
                "_px": F.when(good & ~geographic, F.col("x")),
                "_py": F.when(good & ~geographic, F.col("y")),
            }
        ),
        "_px", "_py", "_src", "_lon0", "_lat0",
    )
    rows = rows.withColumns(
        {
            "_lon": F.when(good & geographic, F.col("x")).otherwise(F.col("_lon0")),
            "_lat": F.when(good & geographic, F.col("y")).otherwise(F.col("_lat0")),
        }
    )
    rows = tm_forward(rows, "_lon", "_lat", "_dst", "_tx", "_ty")
    return rows.withColumns(
        {
            "tx": F.when(same, F.col("x")).otherwise(F.col("_tx")),
            "ty": F.when(same, F.col("y")).otherwise(F.col("_ty")),
        }
    ).drop("_src", "_dst", "_px", "_py", "_lon0", "_lat0", "_lon", "_lat", "_tx", "_ty")


def densify(features: DataFrame, key: list[str], step: Column) -> DataFrame:
    """Vertices of every ring with no gap longer than `step`, as rows.

    Each edge expands on its own and gives no end, for a ring closes where it began. The
    end of a line, which does not, is added as a vertex of its own.
    """
    edge = F.col("edge")
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    pieces = F.greatest(
        F.ceil(F.coalesce(F.try_divide(F.hypot(dx, dy), F.col("_step")), F.lit(1.0))), F.lit(1)
    )
    share = F.try_divide(F.col("k").cast("double"), F.col("_n").cast("double"))
    carried = [c for c in features.columns if c != "geom" and c not in key]
    ends = (
        features.filter("geom.kind = 'line'")
        .select(*key, *carried, F.posexplode("geom.parts").alias("part", "_rings"))
        .select(*key, *carried, "part", F.posexplode("_rings").alias("ring", "_ring"))
        .filter("size(_ring) > 0")
        .select(
            *key,
            *carried,
            "part",
            "ring",
            (F.size("_ring") - 1).alias("seq"),
            F.lit(0).alias("k"),
            F.element_at("_ring", -1)["x"].alias("x"),
            F.element_at("_ring", -1)["y"].alias("y"),
        )
    )
    dense = (
        features.withColumn("_step", step)
        .select(*key, *carried, "_step", F.expr(f"explode({edges_of('geom')})").alias("edge"))
        .withColumn("_n", pieces)
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .select(
            *key,
            *carried,
            edge["part"].alias("part"),
            edge["ring"].alias("ring"),
            edge["seq"].alias("seq"),
            F.col("k").cast("int").alias("k"),
            (edge["x1"] + share * dx).alias("x"),
            (edge["y1"] + share * dy).alias("y"),
        )
    )
    return dense.unionByName(ends)


def normalize_polygons(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Densified, reprojected ring vertices, and the rejected features with a code.

    features: package_id, face_id, geom, source_crs, target_crs. Steps are 0.001 degree
    or 100 m in the source unit; same source and target leave the vertices alone.
    """
    facts = with_crs(
        with_crs(features.withColumn("_box", F.expr(bbox_of("geom"))), "source_crs", "_src"),
        "target_crs",
        "_dst",
    )
    box = F.col("_box")
    geographic = F.col("_src.kind") == "geographic"
    same = F.col("source_crs") == F.col("target_crs")
    code = (
        F.when(metric_crs_code(F.col("target_crs"), F.col("_dst")).isNotNull(), "NON_METRIC_CRS")
        .when(same, F.lit(None))
        .when(
            transform_code(F.col("_src"), F.col("_dst")).isNotNull(),
            transform_code(F.col("_src"), F.col("_dst")),
        )
        .when(box.isNull(), "INVALID_WATER_GEOMETRY")
        .when(
            geographic
            & ~(
                (box["xmin"] >= -180.0)
                & (box["xmax"] <= 180.0)
                & (box["ymin"] >= -90.0)
                & (box["ymax"] <= 90.0)
            ),
            "INVALID_TRANSFORM_DOMAIN",
        )
        .when(geographic & (box["xmax"] - box["xmin"] > 180.0), "ANTIMERIDIAN_SPLIT_REQUIRED")
    )
    checked = facts.withColumn("code", code).withColumn(
        "_step",
        F.when(same, F.lit(float("inf")))
        .when(geographic, F.lit(DENSIFY_DEGREES))
        .otherwise(F.lit(DENSIFY_METRES) / F.col("_src.unit_factor")),
    )
    rejected = checked.filter("code IS NOT NULL").select("package_id", "face_id", "code")
    kept = checked.filter("code IS NULL").select(
        "package_id", "face_id", "source_crs", "target_crs", "geom", F.col("_step").alias("step_used")
    )
    dense = densify(kept, ["package_id", "face_id"], F.col("step_used"))
    return reproject_vertices(dense), rejected


# --- game plane ---------------------------------------------------------------------


def game_forward(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Game (x, height, z) to map (east, north, height); no extrapolation, no export.

    points: package_id, gx, gh, gz, for_export. mapping: package_id, e0, n0, half_x, half_z.
    """
    x, z = F.col("gx"), F.col("gz")
    finite = is_finite(x) & is_finite(z) & is_finite(F.col("gh"))
    code = (
        F.when(F.col("for_export").isNull(), "INVALID_EXPORT_FLAG")
        .when(F.col("for_export"), "UNCONFIRMED_GAME_MAPPING")
        .when(~finite, "INVALID_COORDINATE")
        .when(
            ~F.coalesce(
                (F.abs(x) <= F.col("half_x")) & (F.abs(z) <= F.col("half_z")), F.lit(False)
            ),
            "OUTSIDE_SOURCE_COVERAGE",
        )
    )
    return points.join(mapping, "package_id", "left").withColumn("code", code).withColumns(
        {
            "east": F.when(F.col("code").isNull(), F.col("e0") + x),
            "north": F.when(F.col("code").isNull(), F.col("n0") + z),
            "height": F.when(F.col("code").isNull(), F.col("gh")),
        }
    )


def game_inverse(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Map (east, north, height) to game (x, height, z), with a 1e-9 m tolerance."""
    x, z = F.col("east") - F.col("e0"), F.col("north") - F.col("n0")
    finite = is_finite(F.col("east")) & is_finite(F.col("north")) & is_finite(F.col("height"))
    code = (
        F.when(F.col("for_export").isNull(), "INVALID_EXPORT_FLAG")
        .when(F.col("for_export"), "UNCONFIRMED_GAME_MAPPING")
        .when(~finite, "INVALID_COORDINATE")
        .when(
            ~F.coalesce(
                (F.abs(x) <= F.col("half_x") + COVERAGE_TOLERANCE_M)
                & (F.abs(z) <= F.col("half_z") + COVERAGE_TOLERANCE_M),
                F.lit(False),
            ),
            "OUTSIDE_SOURCE_COVERAGE",
        )
    )
    return points.join(mapping, "package_id", "left").withColumn("code", code).withColumns(
        {
            "gx": F.when(F.col("code").isNull(), x),
            "gh": F.when(F.col("code").isNull(), F.col("height")),
            "gz": F.when(F.col("code").isNull(), z),
        }
    )


def mapping_from_grids(grids: DataFrame) -> DataFrame:
    """Centre and half extents of each package from its terrain and depth grid.

    Both grids must be north-up, unrotated, in one metre system and share centre and
    footprint within 1e-6 m; otherwise the package gets a code.
    """
    fields = ("a", "b", "c", "d", "e", "f", "width", "height", "crs")

    def side(role: str, tag: str) -> DataFrame:
        chosen = grids.filter(F.col("role") == role)
        return chosen.select("package_id", *[F.col(n).alias(f"{tag}{n}") for n in fields])

    pair = side("terrain", "t_").join(side("depth", "d_"), "package_id", "left")
    pair = with_crs(pair, "t_crs", "_tf")
    pair = with_crs(pair, "d_crs", "_df")

    def centre(tag: str) -> tuple[Column, Column, Column, Column]:
        g = lambda n: F.col(f"{tag}{n}").cast("double")
        half_x, half_z = g("a") * g("width") / 2.0, -g("e") * g("height") / 2.0
        return g("c") + half_x, g("f") - half_z, half_x, half_z

    t, d = centre("t_"), centre("d_")

    def upright(tag: str) -> Column:
        g = lambda n: F.col(f"{tag}{n}")
        return (g("a") > 0) & (g("e") < 0) & (g("b") == 0) & (g("d") == 0)

    def sized(tag: str) -> Column:
        numbers = [is_finite(F.col(f"{tag}{n}")) for n in ("a", "b", "c", "d", "e", "f")]
        good = (F.col(f"{tag}width") > 0) & (F.col(f"{tag}height") > 0)
        for number in numbers:
            good = good & number
        return good

    agree = F.lit(True)
    for mine, other in zip(t, d):
        agree = agree & (F.abs(mine - other) <= FOOTPRINT_TOLERANCE_M)
    code = F.coalesce(
        metric_crs_code(F.col("t_crs"), F.col("_tf")),
        metric_crs_code(F.col("d_crs"), F.col("_df")),
        first_violation(
            (F.col("t_crs") != F.col("d_crs"), "CRS_MISMATCH"),
            (~(sized("t_") & sized("d_")), "INVALID_GRID"),
            (~(upright("t_") & upright("d_")), "UNSUPPORTED_GRID_ORIENTATION"),
            (~agree, "SOURCE_FOOTPRINT_MISMATCH"),
        ),
    )
    pair = pair.withColumn("code", code)
    good = F.col("code").isNull()
    return pair.select(
        "package_id",
        F.when(good, t[0]).alias("e0"),
        F.when(good, t[1]).alias("n0"),
        F.when(good, t[2]).alias("half_x"),
        F.when(good, t[3]).alias("half_z"),
        "code",
    )


def roundtrip_audit(mapping: DataFrame) -> DataFrame:
    """27 control points per package through forward and inverse; largest error."""
    levels = F.array(F.lit(-10.0), F.lit(0.0), F.lit(100.0))

    def ends(name: str) -> Column:
        return F.array(-F.col(name), F.lit(0.0), F.col(name))

    usable = mapping.filter("code IS NULL").drop("code")
    points = (
        usable.select("package_id", F.explode(levels).alias("gh"), "half_x", "half_z")
        .withColumn("gx", F.explode(ends("half_x")))
        .withColumn("gz", F.explode(ends("half_z")))
        .select("package_id", "gx", "gh", "gz", F.lit(False).alias("for_export"))
    )
    there = game_forward(points, usable).select(
        "package_id",
        F.col("gx").alias("x0"),
        F.col("gh").alias("h0"),
        F.col("gz").alias("z0"),
        "east",
        "north",
        "height",
        F.lit(False).alias("for_export"),
    )
    back = game_inverse(there, usable)
    error = F.greatest(
        F.abs(F.col("gx") - F.col("x0")),
        F.abs(F.col("gh") - F.col("h0")),
        F.abs(F.col("gz") - F.col("z0")),
    )
    return back.groupBy("package_id").agg(
        F.count("*").alias("roundtrip_points"),
        F.max(error).alias("maximum_error_m"),
        F.coalesce(
            F.bool_and(F.coalesce(error <= ROUNDTRIP_TOLERANCE_M, F.lit(False))), F.lit(False)
        ).alias("passed"),
    )


def corner_cells(grids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Game coordinates of the four corner cell centres of each terrain grid."""
    row = F.array(F.lit(0), F.col("height") - 1)
    col = F.array(F.lit(0), F.col("width") - 1)
    centres = (
        grids.filter("role = 'terrain'")
        .withColumn("row", F.explode(row))
        .withColumn("col", F.explode(col))
        .select(
            "package_id",
            "row",
            "col",
            (F.col("c") + F.col("a") * (F.col("col") + 0.5)).alias("east"),
            (F.col("f") + F.col("e") * (F.col("row") + 0.5)).alias("north"),
            F.lit(0.0).alias("height"),
            F.lit(False).alias("for_export"),
        )
    )
    usable = mapping.filter("code IS NULL").drop("code")
    return game_inverse(centres, usable).select("package_id", "row", "col", "gx", "gh", "gz", "code")


def tile_audit(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vertices of map tiles through the mapping: outside ones counted, others round-tripped.

    features: package_id, feature_id, geom, props.
    """
    tiles = features.filter(
        (F.element_at("props", "Object") == "MapTile") & F.col("geom").isNotNull()
    )
    usable = mapping.filter("code IS NULL").drop("code")
    vertices = tiles.select(
        "package_id", "feature_id", F.explode(F.flatten(F.flatten("geom.parts"))).alias("v")
    ).select(
        "package_id",
        "feature_id",
        F.col("v.x").alias("east"),
        F.col("v.y").alias("north"),
        F.lit(0.0).alias("height"),
        F.lit(False).alias("for_export"),
    )
    game = game_inverse(vertices, usable).withColumnsRenamed({"code": "back_code"})
    # The way back restores the source point unless the first step already refused.
    east, north = F.col("e0") + F.col("gx"), F.col("n0") + F.col("gz")
    inside = (
        F.col("back_code").isNull()
        & (F.abs("gx") <= F.col("half_x"))
        & (F.abs("gz") <= F.col("half_z"))
    )
    error = F.greatest(F.abs(east - F.col("east")), F.abs(north - F.col("north")))
    per_vertex = game.groupBy("package_id").agg(
        F.count("*").alias("vertices"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("vertices_outside"),
        F.max(F.when(inside, error)).alias("maximum_error_m"),
    )
    per_tile = tiles.groupBy("package_id").agg(F.count("*").alias("map_tiles"))
    return per_tile.join(per_vertex, "package_id", "left")


def projection_audit(
    grids: DataFrame, layers: DataFrame, settings: DataFrame, tolerance_m: float = 0.001
) -> DataFrame:
    """Grid centre of each package against the plane position of longitude 0, latitude 0.

    layers: package_id, crs of each vector layer. settings: package_id, projection,
    x, y, scope, evidence. The centre is an origin candidate, never a proof.
    """
    terrain = grids.filter("role = 'terrain'").select(
        "package_id", "width", "height", "a", "b", "c", "d", "e", "f", "crs"
    )
    depth = grids.filter("role = 'depth'").select("package_id", F.col("crs").alias("depth_crs"))
    rows = (
        terrain.join(depth, "package_id", "left")
        .join(
            layers.join(terrain.select("package_id", F.col("crs").alias("grid_crs")), "package_id")
            .groupBy("package_id")
            .agg(
                F.bool_and(F.coalesce(F.col("crs") == F.col("grid_crs"), F.lit(False))).alias(
                    "_all_match"
                )
            ),
            "package_id",
            "left",
        )
        .join(settings, "package_id", "left")
    )
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    rows = with_crs(rows, "crs", "_facts").withColumns(
        {
            "centre_x": F.col("a") * w / 2 + F.col("b") * h / 2 + F.col("c"),
            "centre_y": F.col("d") * w / 2 + F.col("e") * h / 2 + F.col("f"),
            "_zero": F.lit(0.0),
        }
    )
    rows = tm_forward(rows, "_zero", "_zero", "_facts", "zero_x", "zero_y")
    rows = tm_inverse(rows, "centre_x", "centre_y", "_facts", "centre_lon", "centre_lat")
    finite = is_finite(F.col("x")) & is_finite(F.col("y"))
    code = F.coalesce(
        first_violation(
            (F.col("projection") != "WGS84", "UNSUPPORTED_SETTINGS"),
            (~finite, "INVALID_SETTINGS"),
            ((F.col("x") != 0) | (F.col("y") != 0), "UNSUPPORTED_SETTINGS"),
            (blank(F.col("scope")) | blank(F.col("evidence")), "MISSING_SETTINGS_EVIDENCE"),
        ),
        metric_crs_code(F.col("crs"), F.col("_facts")),
        F.when(F.col("depth_crs").isNull(), "MISSING_CRS").when(
            F.col("depth_crs") != F.col("crs"), "CRS_MISMATCH"
        ),
        F.when(~((F.col("width") > 0) & (F.col("height") > 0)), "INVALID_GRID"),
    )
    rows = rows.withColumn("code", code)
    good = F.col("code").isNull()
    residual = F.hypot(F.col("centre_x") - F.col("zero_x"), F.col("centre_y") - F.col("zero_y"))
    return rows.select(
        "package_id",
        "code",
        F.when(good, F.col("centre_x")).alias("centre_x"),
        F.when(good, F.col("centre_y")).alias("centre_y"),
        F.when(good, F.col("centre_lon")).alias("centre_lon"),
        F.when(good, F.col("centre_lat")).alias("centre_lat"),
        F.when(good, residual).alias("residual_m"),
        F.when(good, F.coalesce("_all_match", F.lit(True))).alias("all_layers_match"),
        (good & F.coalesce(residual <= tolerance_m, F.lit(False))).alias("origin_candidate"),
    )
