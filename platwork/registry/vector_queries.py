"""Registered queries of the spatial and policy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork import fixtures as fx
from platwork.functions.geometry import (
    area,
    bbox_of,
    box_geom,
    point_in_polygon,
    raised,
)
from platwork.operators import conflicts as oc
from platwork.operators.pairs import bbox_pairs, line_pairs, outlined, shaped
from platwork.operators.quality import object_identity, source_quality, with_validity
from platwork.plans import decisions as pd
from platwork.session import stored


def _object_zone_candidates(spark: SparkSession, sf: str) -> DataFrame:
    objects = shaped(fx.objects(spark, sf), ["package_id", "object_id"], "o")
    zones = shaped(fx.zones(spark, sf), ["package_id", "zone_id"], "z")
    return bbox_pairs(objects, zones, "o_box", "z_box")


def sp1_spatial_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _object_zone_candidates(spark, sf).select("object_id", "zone_id")


def sp2_intersects(spark: SparkSession, sf: str) -> DataFrame:
    return oc.feature_zone_pairs(fx.surveyed_objects(spark, sf), fx.surveyed_zones(spark, sf), "object_id", with_area=False).select(
        "object_id", "zone_id"
    )


def sp3_within_distance(spark: SparkSession, sf: str) -> DataFrame:
    return line_pairs(
        oc.corridor_lines(fx.corridors(spark, sf)),
        outlined(fx.objects(spark, sf), ["package_id", "object_id"], "s"),
        "radius + 0.25D",
        [*oc.LINE_KEYS, "object_id"],
    ).drop("package_id")


def sp4_point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    points = shaped(fx.zone_points(spark, sf), ["package_id", "feature_id"], "p")
    zones = shaped(fx.zones(spark, sf), ["package_id", "zone_id"], "z")
    return (
        bbox_pairs(points, zones, "p_box", "z_box")
        .filter(point_in_polygon("z_edges", "p_box.xmin", "p_box.ymin"))
        .select("feature_id", "zone_id")
    )


def sp5_zone_overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every third zone is grown by half a metre, so that it overlaps its neighbours."""
    grown = box_geom("b.xmin - g", "b.ymin - g", "b.xmax + g", "b.ymax + g")
    zones = (
        fx.zones(spark, sf)
        .withColumn("b", F.expr(bbox_of("geom")))
        .withColumn("g", F.expr("if(bigint(substring(zone_id, 2)) % 3 = 0, 0.5D, 0D)"))
        .withColumn("geom", F.expr(grown))
    )
    return oc.zone_overlaps(zones).drop("package_id")


def sp6_intersection_area(spark: SparkSession, sf: str) -> DataFrame:
    return (
        oc.feature_zone_pairs(fx.surveyed_objects(spark, sf), fx.surveyed_zones(spark, sf), "object_id")
        .filter("common_area > 1e-9D")
        .select("object_id", "zone_id", F.round("common_area", 6).alias("common_area"))
    )


def _point_and_object_features(spark: SparkSession, sf: str) -> DataFrame:
    # Every eleventh object carries heights, which no zone may answer for.
    objects = fx.surveyed_objects(spark, sf).select(
        "package_id",
        F.col("object_id").alias("feature_id"),
        F.expr(f"if(bigint(substring(object_id, 2)) % 11 = 4, {raised('geom')}, geom)").alias("geom"),
        "is_valid",
    )
    return fx.zone_points(spark, sf).withColumn("is_valid", F.lit(True)).unionByName(objects)


def jn6_zone_association(spark: SparkSession, sf: str) -> DataFrame:
    features = _point_and_object_features(spark, sf)
    pairs = oc.feature_zone_pairs(features, fx.surveyed_zones(spark, sf), "feature_id", with_area=False)
    return oc.permission_rollup(features, pairs, "feature_id").drop("package_id", "zone_area", "geom", "is_valid")


def jn6_zone_association_pairs(spark: SparkSession, sf: str) -> DataFrame:
    features = _point_and_object_features(spark, sf)
    return oc.feature_zone_pairs(features, fx.surveyed_zones(spark, sf), "feature_id", with_area=False).select(
        "feature_id", "zone_id"
    )


def ag9_permission_rollup(spark: SparkSession, sf: str) -> DataFrame:
    objects = fx.surveyed_objects(spark, sf)
    pairs = oc.feature_zone_pairs(objects, fx.surveyed_zones(spark, sf), "object_id", with_area=False)
    return oc.permission_rollup(objects.select("package_id", "object_id"), pairs, "object_id").drop(
        "package_id", "zone_area"
    )


def jn7_corridor_object_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return oc.corridor_object_conflicts(
        fx.corridors(spark, sf), fx.objects(spark, sf), fx.snapshot_header(spark, sf)
    ).drop("package_id")


def jn8_protection_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return oc.protection_conflicts(fx.corridors(spark, sf), fx.protected(spark, sf)).drop("package_id")


def jn9_zone_cover(spark: SparkSession, sf: str) -> DataFrame:
    return oc.object_resolution(fx.surveyed_objects(spark, sf), fx.surveyed_zones(spark, sf)).select(
        "object_id",
        F.round("own_area", 6).alias("own_area"),
        F.round("zone_area", 6).alias("zone_area"),
        "resolved",
    )


def _live_items(spark: SparkSession, sf: str) -> DataFrame:
    header = fx.snapshot_header(spark, sf)
    live = pd.admitted(fx.corridors(spark, sf), pd.headed(header)).filter("entry_code IS NULL")
    return pd.conflict_items(
        live.select("package_id", "corridor_id", "geom", "radius"),
        fx.surveyed_objects(spark, sf),
        fx.surveyed_zones(spark, sf),
        header,
    )


def ag8_conflict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return pd.conflict_rollup(_live_items(spark, sf)).drop("package_id")


def ag8_conflict_items(spark: SparkSession, sf: str) -> DataFrame:
    return _live_items(spark, sf).drop("package_id")


def _shown(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("permitted_modes", F.array_join("permitted_modes", ",")).drop(
        "package_id"
    )


def d1_decide_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(
        pd.decide_conflicts(
            fx.corridors(spark, sf),
            fx.surveyed_objects(spark, sf),
            fx.surveyed_zones(spark, sf),
            fx.protected(spark, sf),
            fx.snapshot_header(spark, sf),
        )
    )


def d1_incomplete_data(spark: SparkSession, sf: str) -> DataFrame:
    """The same snapshot, its completeness not confirmed."""
    return _shown(
        pd.decide_conflicts(
            fx.corridors(spark, sf),
            fx.surveyed_objects(spark, sf),
            fx.surveyed_zones(spark, sf),
            fx.protected(spark, sf),
            fx.snapshot_header(spark, sf).withColumn("existing_data_complete", F.lit(False)),
        )
    )


def d2_tunnel_ceilings(spark: SparkSession, sf: str) -> DataFrame:
    facts = oc.object_resolution(fx.surveyed_objects(spark, sf), fx.surveyed_zones(spark, sf)).filter(
        "NOT (resolved AND allow_demolition)"
    )
    return facts.join(fx.snapshot_header(spark, sf), "package_id").select(
        "object_id",
        pd.ceiling(F.col("ground_z"), F.col("foundation_z")).alias("ceiling_z"),
        (pd.ceiling(F.col("ground_z"), F.col("foundation_z")) < 100.0).alias("below_100"),
    )


def d4_staleness_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = pd.admitted(fx.corridors(spark, sf), pd.headed(fx.snapshot_header(spark, sf)))
    return rows.groupBy(
        F.when(F.col("entry_code") == "INPUT_REVISION_CHANGED", "stale_input")
        .otherwise("admitted")
        .alias("answer")
    ).agg(F.count("*").alias("corridors"))


def d5_space_gate(spark: SparkSession, sf: str) -> DataFrame:
    corridors = fx.corridors(spark, sf).withColumn(
        "space_id",
        F.when(F.substring("corridor_id", 2, 20).cast("long") % 9 == 4, "elsewhere").otherwise("plane"),
    )
    return pd.admitted(corridors, pd.headed(fx.snapshot_header(spark, sf))).select(
        "corridor_id", "entry_code"
    )


def quality_records(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary records with quality, guard and object id."""
    records = with_validity(fx.boundary_records(spark, sf))
    records = records.withColumn("quality", F.expr(source_quality()))
    return oc.boundary_guards(records).withColumn(
        "object_id", F.expr(object_identity("layer", "revision", "source_record_id"))
    )


def jn10_boundary_affected(spark: SparkSession, sf: str) -> DataFrame:
    """Located records per corridor, and the count of records that concern every corridor."""
    guards = stored(quality_records(spark, sf), "graded")
    located = oc.boundary_conflicts(fx.corridors(spark, sf), guards, fx.snapshot_header(spark, sf))
    everywhere = oc.unlocatable_counts(guards).filter("unlocatable > 0")
    return located.select(
        "corridor_id", F.lit("b").alias("kind"), "source_record_id", "quality"
    ).unionByName(
        everywhere.select(
            F.lit(None).cast("string").alias("corridor_id"),
            F.lit("u").alias("kind"),
            F.col("unlocatable").cast("string").alias("source_record_id"),
            F.col("layer").alias("quality"),
        )
    )


def jn11_coverage_covers_envelope(spark: SparkSession, sf: str) -> DataFrame:
    coverage = fx.water_coverage(spark, sf).withColumn("layer", F.lit("roads"))
    return oc.coverage_of_envelopes(fx.corridors(spark, sf), coverage).select("corridor_id", "covered")


def jn14_boundary_object_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth boundary id is already taken by an object, which must be reported."""
    guards = stored(quality_records(spark, sf), "graded")
    taken = guards.filter(F.col("source_record_id").cast("long") % 15 == 0).filter("guard IS NOT NULL AND layer = 'roads'")
    objects = fx.objects(spark, sf).unionByName(
        taken.select(
            "package_id",
            "object_id",
            F.col("guard").alias("geom"),
            F.lit(0.0).alias("ground_z"),
            F.lit(0.0).alias("foundation_z"),
        )
    )
    merged, clash = oc.merge_boundary_objects(objects, guards)
    clashing = clash.select("object_id", F.col("code"))
    known = F.col("foundation_z").isNotNull()
    return merged.join(clashing, "object_id", "left").select(
        "object_id",
        F.round(F.expr(area("geom")), 6).alias("area"),
        known.alias("levels_known"),
        F.when(~known, F.col("code")).alias("code"),
    )


def boundary_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return fx.water_coverage(spark, sf).select(
        "package_id",
        F.explode(F.array(F.lit("roads"), F.lit("lost"))).alias("layer"),
        F.lit("r1").alias("boundary_revision"),
        F.lit("plane").alias("boundary_space"),
        "geom",
        F.lit(True).alias("coverage_confirmed"),
    )


def d3_decide_with_boundary_quality(spark: SparkSession, sf: str) -> DataFrame:
    corridors = fx.corridors(spark, sf).withColumn(
        "expected_boundary_revision",
        F.when(F.substring("corridor_id", 2, 20).cast("long") % 40 == 1, "r0").otherwise("r1"),
    )
    return _shown(
        pd.decide_with_boundary_quality(
            corridors,
            fx.surveyed_objects(spark, sf),
            fx.surveyed_zones(spark, sf),
            fx.protected(spark, sf),
            fx.snapshot_header(spark, sf),
            # Graded once, used by several joins: a snapshot table in a real lake.
            stored(quality_records(spark, sf), "graded"),
            boundary_snapshots(spark, sf),
        )
    )


QUERIES = {
    q.__name__: q
    for q in (
        sp1_spatial_bins,
        sp2_intersects,
        sp3_within_distance,
        sp4_point_in_polygon,
        sp5_zone_overlap_check,
        sp6_intersection_area,
        jn6_zone_association,
        jn6_zone_association_pairs,
        ag9_permission_rollup,
        jn7_corridor_object_conflicts,
        jn8_protection_conflicts,
        jn9_zone_cover,
        ag8_conflict_rollup,
        ag8_conflict_items,
        d1_decide_conflicts,
        d1_incomplete_data,
        d2_tunnel_ceilings,
        d4_staleness_gate,
        d5_space_gate,
        jn10_boundary_affected,
        jn11_coverage_covers_envelope,
        jn14_boundary_object_merge,
        d3_decide_with_boundary_quality,
    )
}
