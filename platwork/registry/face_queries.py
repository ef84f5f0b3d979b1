"""Registered queries of polygons on grids, layer profiles and geometry quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork import fixtures as fx
from platwork.functions import attributes as fa
from platwork.functions.geometry import area, bbox_of, edges_of, is_empty, length
from platwork.operators import faces as of
from platwork.operators import grids as og
from platwork.operators import quality as oq
from platwork.plans import reports as pr
from platwork.registry.vector_queries import quality_records
from platwork.session import stored


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    return fx.water_faces(spark, sf).unionByName(fx.water_coverage(spark, sf))


def jn3_polygon_to_cells(spark: SparkSession, sf: str) -> DataFrame:
    return of.polygon_to_cells(fx.water_faces(spark, sf), fx.plane_grid(spark, sf)).select(
        "row", "col"
    )


def jn4_classify_water_faces(spark: SparkSession, sf: str) -> DataFrame:
    grid = fx.plane_grid(spark, sf)
    flagged = of.on_cells(fx.plane_cells(spark, sf), _faces(spark, sf), grid)
    assertions = grid.select("package_id", F.lit(True).alias("complete_coverage_confirmed"))
    return of.classify_water_faces(flagged, assertions).select("row", "col", "class")


def jn5_clip_by_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return of.clip_by_polygon(
        fx.plane_cells(spark, sf), fx.water_faces(spark, sf), fx.plane_grid(spark, sf)
    ).select("row", "col", "value")


def sp7_union_coverage_clip(spark: SparkSession, sf: str) -> DataFrame:
    areas = of.union_coverage_clip(_faces(spark, sf))
    return areas.select(*[F.round(c, 6).alias(c) for c in ("union_area", "clipped_area", "outside_area")])


def sp7_touching_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    faces = fx.water_faces(spark, sf).unionByName(fx.rim_faces(spark, sf))
    return of.touching_leftovers(faces, fx.water_coverage(spark, sf)).drop("package_id")


def g3_water_face_report(spark: SparkSession, sf: str) -> DataFrame:
    return pr.water_face_report(
        fx.plane_cells(spark, sf),
        fx.plane_grid(spark, sf),
        _faces(spark, sf),
        fx.plane_grid(spark, sf).select(
            "package_id",
            F.lit(True).alias("complete_coverage_confirmed"),
            F.lit("ft").alias("vertical_unit"),
            F.lit(None).cast("string").alias("vertical_reference"),
        ),
    ).select(
        "water",
        "land",
        "unknown",
        "water_m2",
        "roi_m2",
        "terrain_valid",
        "terrain_missing",
        F.round("terrain_min_m", 6).alias("terrain_min_m"),
        F.round("terrain_max_m", 6).alias("terrain_max_m"),
        F.array_join("diagnostics", ",").alias("diagnostics"),
        "ready",
    )


def w3_window_roi_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Depth cells counted directly and through row rectangles must agree in every tile."""
    return pr.two_route_compare(
        fx.depth_cells(spark, sf), fx.grids(spark, sf).filter("role = 'depth'"), 8
    )


def fn10_source_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return fx.network_features(spark, sf).select(
        "source_record_id",
        F.array_join(fa.source_tokens(F.element_at("props", "Category")), "|").alias("tokens"),
    )


def fn11_normalize_network(spark: SparkSession, sf: str) -> DataFrame:
    return fa.normalize_network(fx.network_features(spark, sf)).select(
        "source_record_id",
        "form",
        "excluded",
        "road_candidate",
        "lanes_source",
        "diagnostic",
        F.array_join("source_object", "|").alias("source_object"),
    )


def ag5_categorical_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fa.attribute_tokens(fx.network_features(spark, sf))
        .groupBy("layer", "attribute", "token")
        .agg(F.count("*").alias("n"))
    )


def q1_scan_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = oq.with_validity(fx.network_features(spark, sf))
    return rows.select("source_record_id", "layer", F.expr(oq.scan_quality()).alias("code"))


def ag4_layer_profile(spark: SparkSession, sf: str) -> DataFrame:
    return pr.layer_profile(fx.network_features(spark, sf)).drop("package_id")


def ag4_layer_profile_with_zones(spark: SparkSession, sf: str) -> DataFrame:
    return pr.layer_profile(fx.network_features(spark, sf), fx.surveyed_zones(spark, sf)).drop("package_id")


def fn24_object_identity(spark: SparkSession, sf: str) -> DataFrame:
    return fx.boundary_records(spark, sf).select(
        "source_record_id",
        F.expr(oq.object_identity("layer", "revision", "source_record_id")).alias("object_id"),
    )


def fn25_geometry_measures(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.objects(spark, sf).select("object_id", "geom", F.expr(bbox_of("geom")).alias("b"))
    return rows.select(
        "object_id",
        F.round(F.expr(area("geom")), 6).alias("area"),
        F.round(F.expr(length(edges_of("geom"))), 6).alias("outline"),
        "b.xmin",
        "b.ymin",
        "b.xmax",
        "b.ymax",
        F.expr(is_empty("geom")).alias("is_empty"),
    )


def fn26_guard_geometry(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality_records(spark, sf).select(
        "layer", "source_record_id", "guard", F.expr(bbox_of("guard")).alias("b")
    )
    return rows.select(
        "layer",
        "source_record_id",
        F.round(F.expr(area("guard")), 6).alias("guard_area"),
        "b.xmin",
        "b.ymin",
        "b.xmax",
        "b.ymax",
        F.col("guard").isNull().alias("unlocatable"),
    )


def q2_source_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_records(spark, sf).select("layer", "source_record_id", "quality")


def q3_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Validity of object footprints, with every third ring twisted into a bow-tie."""
    return oq.with_validity(fx.boundary_records(spark, sf)).select(
        "layer", "source_record_id", "is_valid"
    )


def q4_repair_review(spark: SparkSession, sf: str) -> DataFrame:
    records = oq.with_validity(fx.boundary_records(spark, sf))
    return oq.repair_review(records).select(
        "source_record_id",
        "status",
        "odd_edges",
        "even_edges",
        F.round("source_area", 6).alias("source_area"),
        F.round("candidate_area", 6).alias("candidate_area"),
        "physical_envelope_accepted",
        "review_required",
    )


def ag7_review_counts(spark: SparkSession, sf: str) -> DataFrame:
    records = oq.with_validity(fx.network_features(spark, sf))
    return (
        oq.repair_review(records).groupBy("layer", "status").agg(F.count("*").alias("records"))
    )


def q5_boundary_report(spark: SparkSession, sf: str) -> DataFrame:
    from platwork.sources.wkb import with_wkb

    records = oq.with_candidates(stored(quality_records(spark, sf), "graded"))
    return oq.boundary_report(with_wkb(records), with_sources=True).select(
        "layer",
        "source_record_id",
        "object_id",
        "quality",
        "source_form",
        F.col("source_wkb_sha256").isNull().alias("no_source"),
        F.length("source_wkb_sha256").alias("hash_length"),
        "xmin",
        "ymax",
        "location_known",
        "candidate_status",
        (F.sha2(F.unhex("source_wkb_hex"), 256) == F.col("source_wkb_sha256")).alias("source_agrees"),
        "candidate_accepted",
        "physical_envelope_accepted",
        "automatic_demolition_allowed",
        "review_required",
    )


def ag6_quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return oq.quality_counts(quality_records(spark, sf)).drop("package_id")


def ag6_candidate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The roads layer declares all parts, the other layer one record more than it has."""
    parts = fx.table(spark, sf, "part").select(F.count("*").alias("declared_count"))
    header = parts.selectExpr("'city' AS package_id", "'roads' AS layer", "declared_count").unionByName(
        parts.selectExpr("'city' AS package_id", "'lost' AS layer", "2L AS declared_count")
    )
    return oq.candidate_counts(oq.with_candidates(stored(quality_records(spark, sf), "graded")), header).drop("package_id")


def sp8_segment_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-edges of the twisted rings, cut at their own crossing."""
    records = fx.boundary_records(spark, sf).filter("layer = 'roads'")
    nodes = oq.segment_nodes(records)
    return nodes.select(
        "source_record_id",
        F.round("start.x", 6).alias("x1"),
        F.round("start.y", 6).alias("y1"),
        F.round("end.x", 6).alias("x2"),
        F.round("end.y", 6).alias("y2"),
        "drawn",
    )


def q6_snapshot_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Page bundles as snapshots: some miscount, repeat an id or carry a broken hash."""
    pages = fx.table(spark, sf, "pages").selectExpr(
        "page_id", "page_id div 8 AS bundle", "url", "sha2(binary(html), 256) AS sha256"
    )
    records = pages.selectExpr(
        "bundle AS package_id",
        "'pages' AS layer",
        "string(CASE WHEN bundle % 5 = 2 AND page_id % 8 = 7 THEN page_id - 1 ELSE page_id END) AS source_record_id",
    )
    files = pages.selectExpr(
        "bundle AS package_id",
        "'pages' AS layer",
        "url AS name",
        "CASE WHEN page_id % 41 = 9 THEN substring(sha256, 2) ELSE sha256 END AS sha256",
    )
    header = (
        pages.groupBy("bundle")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "bundle AS package_id",
            "'pages' AS layer",
            "n + if(bundle % 4 = 1, 1, 0) AS declared_count",
            "if(bundle % 7 = 3, ' ', 'plane') AS space_id",
            "bundle % 6 != 5 AS coverage_valid",
            "CASE WHEN bundle % 9 != 8 THEN true END AS coverage_confirmed",
        )
    )
    return oq.snapshot_integrity(header, records, files).select(
        "package_id", "actual_count", F.array_join("codes", ",").alias("codes")
    )


QUERIES = {
    q.__name__: q
    for q in (
        jn3_polygon_to_cells,
        jn4_classify_water_faces,
        jn5_clip_by_polygon,
        sp7_union_coverage_clip,
        sp7_touching_leftovers,
        g3_water_face_report,
        w3_window_roi_compare,
        fn10_source_tokens,
        fn11_normalize_network,
        ag5_categorical_counts,
        q1_scan_quality,
        ag4_layer_profile,
        ag4_layer_profile_with_zones,
        fn24_object_identity,
        fn25_geometry_measures,
        fn26_guard_geometry,
        q2_source_quality,
        q3_validity,
        q4_repair_review,
        ag7_review_counts,
        q5_boundary_report,
        ag6_quality_counts,
        ag6_candidate_counts,
        sp8_segment_nodes,
        q6_snapshot_integrity,
    )
}
