"""Spatial conflicts of corridors with zones, objects, protected areas and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions.geometry import (
    area,
    bbox_geom,
    bbox_of,
    crosses_ray,
    edges_of,
    segments_near,
)
from platwork.operators.pairs import bbox_pairs, extent, line_pairs, outlined, shape_pairs
from platwork.operators.quality import with_validity

AREA_TOLERANCE = 1e-9
#: Up to this many edges of all coverage borders together are sent to every task.
FEW_BORDERS = 64


def checked(features: DataFrame, key: str) -> DataFrame:
    """The features with their planar validity: as they bring it along, or found out here."""
    if "is_valid" in features.columns:
        return features
    named = features.withColumns({"layer": F.lit("features"), "source_record_id": F.col(key)})
    return with_validity(named).drop("layer", "source_record_id")


def unsound(features: DataFrame) -> Column:
    """Shapes that must not be matched: empty, with heights, or not known to be valid."""
    lifted = F.coalesce(F.col("geom.has_z"), F.lit(False))
    empty = F.coalesce(F.size("geom.parts") < 1, F.lit(True))
    return lifted | empty | ~F.coalesce(F.col("is_valid"), F.lit(False))


def _sound(features: DataFrame, key: str, *more: str) -> DataFrame:
    given = ["is_valid"] if "is_valid" in features.columns else []
    known = checked(features.select("package_id", key, "geom", *more, *given), key)
    return known.filter(~unsound(known))


def feature_zone_pairs(
    features: DataFrame, zones: DataFrame, key: str, with_area: bool = True, like: DataFrame | None = None
) -> DataFrame:
    """Feature x zone pairs that meet (touching counts), with the area in common if asked for.

    `like` is a table with geom whose shapes are no smaller than the features', where these are
    costly to read twice.

    Both sides need package_id, their key and geom, and may say whether they are valid (is_valid);
    where they don't, it is found out. Unsound features (see `unsound`) meet no zone and unsound
    zones meet no feature, so nothing is ever permitted on their account.
    """
    return shape_pairs(
        outlined(_sound(features, key), ["package_id", key], "f"),
        outlined(_sound(zones, "zone_id", "allow_demolition"), ["package_id", "zone_id", "allow_demolition"], "z"),
        "f",
        "z",
        ["package_id", key, "zone_id", "allow_demolition"],
        with_area,
        extents=(extent(features if like is None else like), extent(zones)),
    )


def permission_rollup(features: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Strictest permission over the matched zones; no match never allows anything.

    Where the features still have their geometry, unsound ones are coded INVALID_GEOMETRY.
    """
    coded = features
    if "geom" in features.columns:
        known = checked(features, key)
        coded = known.withColumn("code", F.when(unsound(known), "INVALID_GEOMETRY")).select(*features.columns, "code")
    area_of = "sum(common_area)" if "common_area" in pairs.columns else "double(NULL)"
    matched = pairs.groupBy("package_id", key).agg(
        F.count("*").alias("zone_count"),
        F.min("zone_id").alias("first_zone"),
        F.max("zone_id").alias("last_zone"),
        F.bool_and("allow_demolition").alias("all_allow"),
        F.expr(area_of).alias("zone_area"),
    )
    return (
        coded.join(matched, ["package_id", key], "left")
        .selectExpr(
            *coded.columns,
            "coalesce(zone_count, 0L) AS zone_count",
            "first_zone",
            "last_zone",
            "coalesce(all_allow, false) AS allow_demolition",
            "if(zone_count > 0, 'matched', 'pending') AS association",
            "coalesce(zone_area, 0D) AS zone_area",
        )
    )


def object_resolution(
    objects: DataFrame, zones: DataFrame, key: str = "object_id", like: DataFrame | None = None
) -> DataFrame:
    """Per object: do its zones cover it, and do they all allow demolition?

    Zones never overlap, so covering is an equality of areas; what has no area, or no valid
    shape, is not covered. Other columns of the objects are kept; the geometry is replaced by
    its area.
    """
    pairs = feature_zone_pairs(objects, zones, key, like=like)
    sized = objects.withColumn("own_area", F.expr(area("geom"))).drop("geom", "is_valid")
    return permission_rollup(sized, pairs, key).withColumn(
        "resolved",
        F.expr(f"zone_count > 0 AND own_area > 0 AND zone_area >= own_area * (1D - {AREA_TOLERANCE}D)"),
    )


def roles(
    objects: DataFrame, zones: DataFrame, key: str = "object_id", like: DataFrame | None = None
) -> DataFrame:
    """package_id, key and role of objects: demolition, mandatory, or unresolved without sound zones all over."""
    return object_resolution(objects, zones, key, like).select(
        "package_id",
        key,
        F.when(F.col("resolved") & F.col("allow_demolition"), "demolition")
        .when(F.col("resolved"), "mandatory")
        .otherwise("unresolved")
        .alias("role"),
    )


def corridor_lines(corridors: DataFrame) -> DataFrame:
    return corridors.select(
        "package_id", "corridor_id", "radius", F.expr(edges_of("geom")).alias("c_edges")
    )


def _with_control(corridors: DataFrame, header: DataFrame) -> DataFrame:
    return corridor_lines(corridors).join(
        header.select("package_id", "control_buffer"), "package_id"
    )


LINE_KEYS = ("package_id", "corridor_id")


def corridor_object_conflicts(
    corridors: DataFrame, objects: DataFrame, header: DataFrame
) -> DataFrame:
    """Objects within corridor radius plus control distance."""
    return line_pairs(
        _with_control(corridors, header),
        outlined(objects, ["package_id", "object_id"], "s"),
        "radius + control_buffer",
        [*LINE_KEYS, "object_id"],
    )


def protection_conflicts(corridors: DataFrame, protected: DataFrame) -> DataFrame:
    """Protected areas within the corridor radius; no control distance here."""
    return line_pairs(
        corridor_lines(corridors),
        outlined(protected, ["package_id", "area_id"], "s"),
        "radius",
        [*LINE_KEYS, "area_id"],
    )


#: Highest admissible tunnel axis below an object; NULL while a level is unknown.
CEILING = (
    "CASE WHEN ground_z IS NOT NULL AND foundation_z IS NOT NULL THEN "
    "least(ground_z - minimum_cover, foundation_z - foundation_clearance) - outer_height / 2D END"
)


def corridor_hits(
    corridors: DataFrame,
    objects: DataFrame,
    protected: DataFrame | None = None,
    guards: DataFrame | None = None,
) -> DataFrame:
    """What each corridor meets, in one pass over lines and shapes: ids only.

    One row per corridor and shape met: tag (object, protected or boundary), id, the layer, record
    and quality of boundary records, and the tunnel ceiling that objects with known levels leave.
    Objects and boundary records count within radius plus control distance, protected areas
    within the radius. `corridors` has geom, radius and the header's distances.
    """
    none = "string(NULL)"
    kinds = [(objects, "object", "object_id", "geom", (none, none, none), "true", ("ground_z", "foundation_z"))]
    unknown = ("double(NULL)", "double(NULL)")
    if protected is not None:
        kinds.append((protected, "protected", "area_id", "geom", (none, none, none), "false", unknown))
    if guards is not None:
        named = ("layer", "source_record_id", "quality")
        kinds.append((guards, "boundary", "object_id", "guard", named, "true", unknown))
    shapes = None
    for df, tag, key, geom, named, controlled, levels in kinds:
        own = df.selectExpr(
            "package_id", f"'{tag}' AS tag", f"{key} AS id", f"{geom} AS geom", f"{controlled} AS controlled",
            *(f"{e} AS {c}" for e, c in zip((*named, *levels), ("layer", "record", "quality", "ground_z", "foundation_z"))),
        )
        shapes = own if shapes is None else shapes.unionByName(own)
    keep = [c for c in shapes.columns if c != "geom"]
    distances = ["control_buffer", "minimum_cover", "foundation_clearance", "outer_height"]
    lines = corridors.select(
        "package_id", "corridor_id", "radius", *distances, F.expr(edges_of("geom")).alias("c_edges")
    )
    return line_pairs(
        lines,
        outlined(shapes, keep, "s"),
        "radius + if(controlled, control_buffer, 0D)",
        [*LINE_KEYS, "tag", "id", "layer", "record", "quality", f"{CEILING} AS ceiling_z"],
        pad="radius + coalesce(control_buffer, 0D)",
    )


def boundary_guards(records: DataFrame) -> DataFrame:
    """Conservative stand-in of each record: itself if valid, else its box, else unknown.

    `records` carries geom and quality.
    """
    return (
        records.withColumn("_box", F.expr(bbox_of("geom")))
        .withColumn(
            "guard",
            F.expr(
                f"CASE WHEN quality = 'VALID_PLANAR_SOURCE' THEN geom ELSE {bbox_geom('_box')} END"
            ),
        )
        .drop("_box")
    )


def boundary_conflicts(corridors: DataFrame, guards: DataFrame, header: DataFrame) -> DataFrame:
    """Located boundary records near a corridor; unlocatable ones concern every corridor
    and are kept as a count per layer (see `unlocatable_counts`)."""
    keys = ("layer", "source_record_id", "quality")
    return line_pairs(
        _with_control(corridors, header),
        outlined(guards, ["package_id", *keys], "s", "guard"),
        "radius + control_buffer",
        [*LINE_KEYS, *keys],
    )


def unlocatable_counts(guards: DataFrame) -> DataFrame:
    return guards.groupBy("package_id", "layer").agg(
        F.count_if(F.col("guard").isNull()).alias("unlocatable")
    )


def coverage_of_envelopes(corridors: DataFrame, coverage: DataFrame) -> DataFrame:
    """Is each corridor envelope covered by the declared coverage polygon of a layer?

    The line must start inside and no border edge may come closer than the radius
    (a common border is allowed). `coverage` has one row per (package, layer).
    """
    keys = ["package_id", "layer", "corridor_id"]
    lines = corridor_lines(corridors).filter("size(c_edges) > 0")
    bordered = coverage.select("package_id", "layer", F.expr(edges_of("geom")).alias("b_edges")).filter(
        "size(b_edges) > 0"
    )
    # Edges travel as plain columns: a_x1, a_y1, ... of the line, b_x1, ... of the border.
    segments = lines.selectExpr("package_id", "corridor_id", "radius", _flat_edges("c_edges", "a"))
    borders = bordered.selectExpr("package_id", "layer", _flat_edges("b_edges", "b"))
    close = segments_near("a", "b", "radius", strict=True).replace("a.", "a_").replace("b.", "b_")
    ray = crosses_ray("b", "a_x1", "a_y1").replace("b.", "b_")
    if len(borders.select("layer").take(FEW_BORDERS + 1)) <= FEW_BORDERS:
        # Counted, so every segment looks at all of them where it is.
        beside = " AND ".join(
            f"least(b_{c}1, b_{c}2) <= greatest(a_{c}1, a_{c}2) + radius AND greatest(b_{c}1, b_{c}2) >= least(a_{c}1, a_{c}2) - radius"
            for c in "xy"
        )
        return (
            segments.join(F.broadcast(borders), "package_id")
            .selectExpr(*keys, f"{beside} AND {close} AS near", f"a_seq = 0 AND {ray} AS ray")
            .groupBy(*keys)
            .agg(F.coalesce(F.bool_or("near"), F.lit(False)).alias("near"), F.count_if("ray").alias("rays"))
            .selectExpr(*keys, "NOT near AND rays % 2 = 1 AS covered")
        )
    # Border and line meet edge by edge in bins; a start looks along its own height only.
    near = (
        bbox_pairs(
            segments.withColumn("a_box", F.expr(_edge_box("a_", "radius"))),
            borders.withColumn("b_box", F.expr(_edge_box("b_", "0D"))),
            "a_box",
            "b_box",
        )
        .filter(close)
        .select(*keys)
        .distinct()
        .withColumn("near", F.lit(True))
    )
    rays = (
        bbox_pairs(
            segments.filter("a_seq = 0").withColumn("a_box", F.expr(_height_box("a_y1", "a_y1"))),
            borders.withColumn("b_box", F.expr(_height_box("b_y1", "b_y2"))),
            "a_box",
            "b_box",
        )
        .filter(ray)
        .groupBy(*keys)
        .agg(F.count("*").alias("rays"))
    )
    return (
        lines.select("package_id", "corridor_id")
        .join(bordered.select("package_id", "layer"), "package_id")
        .join(near, keys, "left")
        .join(rays, keys, "left")
        .selectExpr(*keys, "near IS NULL AND coalesce(rays, 0L) % 2 = 1 AS covered")
    )


def _flat_edges(edges: str, prefix: str) -> str:
    fields = ", ".join(f"'{prefix}_{f}', fe.{f}" for f in ("seq", "x1", "y1", "x2", "y2"))
    return f"inline(transform({edges}, fe -> named_struct({fields})))"


def _edge_box(edge: str, reach: str) -> str:
    x, y = f"{edge}x1, {edge}x2", f"{edge}y1, {edge}y2"
    return (
        f"named_struct('xmin', least({x}) - {reach}, 'ymin', least({y}) - {reach}, "
        f"'xmax', greatest({x}) + {reach}, 'ymax', greatest({y}) + {reach})"
    )


def _height_box(low: str, high: str) -> str:
    return f"named_struct('xmin', 0D, 'ymin', least({low}, {high}), 'xmax', 0D, 'ymax', greatest({low}, {high}))"


def zone_overlaps(zones: DataFrame) -> DataFrame:
    """Zone pairs whose interiors overlap; touching is allowed.

    Sums below a billionth of a square metre are rounding, not area.
    """

    def half(tag: str) -> DataFrame:
        named = zones.withColumnRenamed("zone_id", f"{tag}_zone")
        return outlined(named, ["package_id", f"{tag}_zone"], tag)

    pairs = shape_pairs(half("a"), half("b"), "a", "b", ["package_id", "a_zone", "b_zone"], ordered=True)
    return pairs.filter("common_area > 1e-9D").withColumn(
        "code", F.lit("OVERLAPPING_ZONES")
    )


def merge_boundary_objects(objects: DataFrame, guards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects plus guards with an area (elevations unknown), and the colliding ids."""
    added = guards.filter(f"{area('guard')} > 0").selectExpr(
        "package_id",
        "object_id",
        "guard AS geom",
        "double(NULL) AS ground_z",
        "double(NULL) AS foundation_z",
    )
    columns = ["package_id", "object_id", "geom", "ground_z", "foundation_z"]
    merged = objects.select(*columns).unionByName(added)
    clash = (
        added.select("package_id", "object_id")
        .join(objects, ["package_id", "object_id"], "left_semi")
        .withColumn("code", F.lit("SOURCE_OBJECT_COLLISION"))
    )
    return merged, clash
