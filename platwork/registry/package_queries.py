"""Registered queries of contracts, coordinates, sources, gates, network and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork import fixtures as fx
from platwork.functions import rules as fr
from platwork.operators import contracts as oc
from platwork.operators import coordinates as co
from platwork.operators import grids as og
from platwork.operators import network as on
from platwork.plans import decisions as pd
from platwork.plans import reports as pr
from platwork.session import new_folder, stored
from platwork.sources import features as sf_
from platwork.sources import files as fl
from platwork.sources import sinks as sk
from platwork.sources import strict_json as sj
from platwork.sources import wkb as sw
from platwork.streaming import jobs as st


def _codes(name: str = "codes") -> F.Column:
    return F.array_join(name, ",").alias(name)


# --- sources ------------------------------------------------------------------------


def src2_features_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Written out as Parquet and read back: no record is lost, null geometry included."""
    folder = new_folder(spark, "features")
    fx.network_features(spark, sf).write.parquet(folder)
    rows = sf_.read_features(spark, folder)
    return rows.select(
        "layer",
        "source_record_id",
        F.col("geom").isNotNull().alias("has_geometry"),
        F.element_at("props", "Object").alias("object"),
        F.size("props").alias("attributes"),
    )


def src2_declared_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sf_.declared_counts(fx.network_features(spark, sf)).drop("package_id")


def src3_geojson_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Objects as FeatureCollection texts of 64 features, parsed back."""
    geometry = (
        "concat('{\"type\":\"Polygon\",\"coordinates\":', "
        "to_json(transform(geom.parts[0], r -> transform(r, v -> array(v.x, v.y)))), '}')"
    )
    number = "bigint(substring(object_id, 2))"
    feature = (
        "concat('{\"type\":\"Feature\",\"id\":\"', object_id, '\",\"properties\":{\"kind\":\"object\"},\"geometry\":', "
        f"CASE WHEN {number} % 31 = 4 THEN 'null' ELSE {geometry} END, '}}')"
    )
    texts = (
        fx.objects(spark, sf)
        .selectExpr(f"{number} div 64 AS collection_id", f"{feature} AS f")
        .groupBy("collection_id")
        .agg(F.array_join(F.collect_list("f"), ",").alias("fs"))
        .selectExpr(
            "collection_id", "concat('{\"type\":\"FeatureCollection\",\"features\":[', fs, ']}') AS text"
        )
    )
    rows = sf_.parse_collections(texts, "EPSG:32631")
    from platwork.functions.geometry import area

    return rows.select(
        "collection_id",
        "feature_id",
        F.round(F.expr(area("geom")), 6).alias("area"),
        F.element_at("props", "kind").alias("kind"),
        "source_crs",
        "code",
    )


def src4_wkb_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary records as WKB, some cut short, decoded again."""
    from platwork.functions.geometry import area, bbox_of

    raw = sw.with_wkb(fx.boundary_records(spark, sf)).drop("geom")
    key = F.col("source_record_id").cast("long")
    cut = raw.withColumn(
        "wkb", F.when(key % 21 == 6, F.expr("substring(wkb, 1, 20)")).otherwise(F.col("wkb"))
    )
    rows = sw.decode_wkb(cut).withColumn("b", F.expr(bbox_of("geom")))
    return rows.select(
        "layer",
        "source_record_id",
        "readable",
        "finite_z",
        F.col("geom.kind").alias("kind"),
        F.col("geom.has_z").alias("has_z"),
        F.expr("size(geom.parts[0][0])").alias("vertices"),
        F.round(F.expr(area("geom")), 6).alias("area"),
        "b.xmin",
        "b.ymax",
    )


def src5_file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages").select(
        F.col("url").alias("path"), F.col("html").cast("binary").alias("content")
    )
    return fl.content_hashes(pages)


def src5_file_manifest_of_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of the given table files themselves."""
    rows = fl.file_manifest(spark, sf, "*.parquet")
    return rows.select(fl.file_name(F.col("path")).alias("file"), "sha256", "bytes")


def src6_layer_component_check(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as layer files: five kinds of file per stem, every seventh one lost."""
    files = fx.table(spark, sf, "part").filter("p_partkey % 7 != 3").selectExpr(
        "p_partkey div 1000 AS package_id",
        "concat('layers/layer', p_partkey div 5, '.', array('shp', 'shx', 'dbf', 'cpg', 'PRJ')[int(p_partkey % 5)]) AS path",
    )
    return fl.layer_component_check(files).select(
        "package_id", "stem", "files", F.array_join("missing", ",").alias("missing"), "code"
    )


def src7_pick_unique_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as the files of one package."""
    files = fx.table(spark, sf, "orders").selectExpr(
        "o_custkey AS package_id",
        "concat('p', o_custkey, '/', o_orderkey, array('_Elevation', '_Depth', '_Photo', '_Notes')[int(o_orderkey % 7 % 4)], "
        "if(o_orderkey % 11 = 2, '.png', '.tif')) AS path",
    )
    return fl.pick_unique_pair(files)


ZONE_JSON = """
CASE
 WHEN k % 16 = 14 THEN '[1,2]' WHEN k % 16 = 15 THEN '{"zone_id": '
 ELSE concat('{"zone_id":', if(k % 16 = 7, '" "', concat('"z', k, '"')),
  if(k % 16 = 2, '', concat(',"land_use":"', CASE WHEN k % 16 = 4 THEN 'castle' WHEN k % 16 = 13 THEN 'office' ELSE 'residential' END, '"')),
  ',"geometry":{"type":"Polygon","coordinates":[', if(k % 16 = 8, '[[0,0],[4,4],[4,0],[0,4],[0,0]]', concat('[[0,0],[', k + 1, ',0],[', k + 1, ',2],[0,2],[0,0]]')), ']}',
  ',"block_size_m":', CASE k % 16 WHEN 5 THEN '12' WHEN 10 THEN '[10]' WHEN 11 THEN '[10,true]' WHEN 12 THEN '[10,0]' ELSE '[10,20.5]' END,
  CASE k % 16 WHEN 9 THEN ',"allow_demolition":"true"' WHEN 0 THEN ',"allow_demolition":true' ELSE '' END,
  CASE k % 16 WHEN 3 THEN ',"scenario_overrides":"abc"' WHEN 6 THEN ',"scenario_overrides":{"trip_rate":-1}' WHEN 13 THEN ',"scenario_overrides":{"trip_rate":1}' WHEN 0 THEN ',"scenario_overrides":{"trip_rate":2.5}' ELSE '' END,
  if(k % 16 = 1, ',"owner":"me"', ''), '}')
END"""


def _zone_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.dealt(fx.table(spark, sf, "customer").selectExpr("c_custkey AS k"), "k").selectExpr(
        "'city' AS package_id", "k AS row_id", f"{ZONE_JSON} AS raw"
    )


def src8_strict_json_zones(spark: SparkSession, sf: str) -> DataFrame:
    zones, rejects = sj.import_zones(_zone_documents(spark, sf))
    good = zones.select(
        "row_id",
        "zone_id",
        "block_h",
        "allow_demolition",
        F.element_at("overrides", "trip_rate").alias("trip_rate"),
        F.lit(None).cast("string").alias("code"),
    )
    bad = rejects.selectExpr(
        "row_id",
        "CAST(NULL AS string) AS zone_id",
        "CAST(NULL AS double) AS block_h",
        "CAST(NULL AS boolean) AS allow_demolition",
        "CAST(NULL AS double) AS trip_rate",
        "code",
    )
    return good.unionByName(bad)


ASSERTION_JSON = """
CASE k % 10
 WHEN 1 THEN '{"carto_source_confirmed":true,"complete_depth_coverage_confirmed":true,"terrain_unit":"m","terrain_vertical_reference":"origin","game_mapping_confirmed":true,"evidence":"note"}'
 WHEN 2 THEN '{"carto_source_confirmed":"true","evidence":"note"}'
 WHEN 3 THEN '{"terrain_unit":"ft","evidence":"note"}'
 WHEN 4 THEN '{"terrain_vertical_reference":" ","evidence":"note"}'
 WHEN 5 THEN '{"game_mapping_confirmed":true}'
 WHEN 6 THEN '{"complete_depth_coverage_confirmed":true,"evidence":"note"}'
 WHEN 7 THEN '{"confirmed_by":"me"}'
 WHEN 8 THEN '[true]'
 WHEN 9 THEN '{"evidence":5}'
 ELSE '{}' END"""


def src9_strict_json_assertions(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr(
        "k AS package_id", f"{ASSERTION_JSON} AS raw"
    )
    return sj.import_assertions(rows).select(
        "package_id", "carto_source_confirmed", "game_mapping_confirmed", "terrain_unit", _codes()
    )


def snk1_zones_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exported documents read back through the strict import."""
    from platwork.functions.geometry import area

    documents = sk.zones_to_json(fx.all_zones(spark, sf)).withColumn("row_id", F.col("zone_id"))
    zones, _ = sj.import_zones(documents)
    return zones.select(
        "zone_id",
        "land_use",
        "block_w",
        "block_h",
        "allow_demolition",
        F.element_at("overrides", "trip_rate").alias("trip_rate"),
        F.round(F.expr(area("geom")), 6).alias("area"),
    )


def _published(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    grids = fx.grids(spark, sf)
    aligned = og.align_nearest(fx.terrain_cells(spark, sf), fx.depth_cells(spark, sf), grids)
    heights = fx.terrain_cells(spark, sf).select("package_id", "row", "col", "value")
    classes = (
        og.classify_aligned(aligned, fx.semantics(grids))
        .join(heights, ["package_id", "row", "col"])
        .selectExpr(
            "package_id",
            "row",
            "col",
            "if(terrain_valid, double(value), double('NaN')) AS height_m",
            "class",
            "int(row div 16) AS tile_row",
        )
    )
    target = new_folder(spark, "package")
    # Classified once for all three outputs.
    outputs = sk.terrain_and_mask(stored(classes, "classes"))
    return target, sk.publish_new(spark, outputs, target, [f"{sf}/orders.parquet"])


def snk2_publish_new(spark: SparkSession, sf: str) -> DataFrame:
    target, _ = _published(spark, sf)
    return (
        spark.read.parquet(f"{target}/class_mask")
        .groupBy("package_id", "class")
        .agg(F.count("*").alias("cells"))
        .withColumn("class", F.col("class").cast("int"))
    )


def snk3_terrain_and_mask_output(spark: SparkSession, sf: str) -> DataFrame:
    target, _ = _published(spark, sf)
    terrain = spark.read.parquet(f"{target}/terrain")
    water = spark.read.parquet(f"{target}/water_extent").select(
        "package_id", "row", "col", F.lit(True).alias("water")
    )
    return terrain.join(water, ["package_id", "row", "col"], "left").selectExpr(
        "package_id", "row", "col", "height_m", "coalesce(water, false) AS water", "tile_row"
    )


def snk4_package_manifest(spark: SparkSession, sf: str) -> DataFrame:
    _, manifest = _published(spark, sf)
    return manifest.groupBy("artifact").agg(
        (F.count("*") > 0).alias("has_files"),
        F.bool_and((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("all_hashed"),
    )


# --- contracts ------------------------------------------------------------------------


def fn12_valid_number(spark: SparkSession, sf: str) -> DataFrame:
    value = F.expr(
        "CASE c_custkey % 6 WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') "
        "WHEN 3 THEN NULL ELSE c_acctbal END"
    )
    rows = fx.table(spark, sf, "customer").select("c_custkey", value.alias("v"), F.expr("if(c_custkey % 8 = 5, ' ', c_name)").alias("id"))
    return rows.select(
        "c_custkey",
        fr.violations(
            (fr.blank(F.col("id")), "INVALID_ID"), (fr.bad_number(F.col("v"), 0.0), "INVALID_NUMBER")
        ).alias("codes"),
    ).withColumn("codes", F.array_join("codes", ","))


def fn13_zone_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Zones with planted faults: shapes, sizes, land use, permission and overrides."""
    from platwork.functions.geometry import ring_geom
    from platwork.operators.quality import with_validity

    bowtie = ring_geom([("0", "0"), ("4", "4"), ("4", "0"), ("0", "4"), ("0", "0")])
    key = "bigint(substring(zone_id, 2))"
    zones = fx.all_zones(spark, sf).selectExpr(
        "package_id",
        "'zones' AS layer",
        "zone_id AS source_record_id",
        f"if({key} % 10 = 1, '  ', zone_id) AS zone_id",
        f"if({key} % 10 = 2, {bowtie}, geom) AS geom",
        f"if({key} % 10 = 3, 'castle', land_use) AS land_use",
        f"CASE WHEN {key} % 10 = 4 THEN NULL ELSE allow_demolition END AS allow_demolition",
        f"CASE WHEN {key} % 10 = 5 THEN double('NaN') ELSE block_w END AS block_w",
        f"if({key} % 10 = 6, 0D, block_h) AS block_h",
        f"CASE WHEN {key} % 10 = 7 THEN map('trip_rate', -1D) ELSE overrides END AS overrides",
    )
    return with_validity(zones).select("source_record_id", fr.zone_rules().alias("codes")).withColumn(
        "codes", F.array_join("codes", ",")
    )


def fn14_object_rules(spark: SparkSession, sf: str) -> DataFrame:
    objects = fx.objects(spark, sf).withColumns(
        {
            "is_valid": F.lit(True),
            "foundation_z": F.expr("if(bigint(substring(object_id, 2)) % 11 = 4, ground_z + 1D, foundation_z)"),
            "object_id": F.col("object_id"),
        }
    )
    return objects.select("object_id", fr.object_rules().alias("codes")).withColumn(
        "codes", F.array_join("codes", ",")
    )


def fn15_corridor_rules(spark: SparkSession, sf: str) -> DataFrame:
    key = "bigint(substring(corridor_id, 2))"
    corridors = fx.corridors(spark, sf).withColumns(
        {
            "radius": F.expr(f"if({key} % 13 = 2, 0D, radius)"),
            "asset_modes": F.expr(
                f"CASE WHEN {key} % 13 = 5 THEN array('rope') WHEN {key} % 13 = 6 THEN slice(asset_modes, 1, 0) ELSE asset_modes END"
            ),
            "space_id": F.expr(f"if({key} % 13 = 7, ' ', space_id)"),
            "minimum_z": F.expr(f"if({key} % 13 = 8, double('NaN'), minimum_z)"),
        }
    )
    return corridors.select("corridor_id", fr.corridor_rules().alias("codes")).withColumn(
        "codes", F.array_join("codes", ",")
    )


def fn16_rules_check(spark: SparkSession, sf: str) -> DataFrame:
    rules = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS package_id",
        "if(s_suppkey % 9 = 1, '', s_name) AS rules_version",
        "double(s_suppkey % 5 - 1) AS control_buffer",
        "3D AS minimum_cover",
        "CASE WHEN s_suppkey % 7 = 2 THEN double('Infinity') ELSE 2D END AS foundation_clearance",
        "double(s_suppkey % 4) AS outer_height",
    )
    return rules.select("package_id", fr.tunnel_rules().alias("codes")).withColumn(
        "codes", F.array_join("codes", ",")
    )


def g2_assertion_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS package_id",
        "c_custkey % 2 = 0 AS carto_source_confirmed",
        "c_custkey % 3 = 0 AS complete_depth_coverage_confirmed",
        "c_custkey % 5 = 0 AS game_mapping_confirmed",
        "CASE c_custkey % 7 WHEN 1 THEN 'm' WHEN 2 THEN 'ft' END AS terrain_unit",
        "CASE c_custkey % 11 WHEN 1 THEN 'sea' WHEN 2 THEN ' ' END AS terrain_vertical_reference",
        "if(c_custkey % 13 < 10, c_name, '') AS evidence",
    )
    return rows.select("package_id", fr.assertion_rules().alias("codes")).withColumn(
        "codes", F.array_join("codes", ",")
    )


def fn17_change_land_use(spark: SparkSession, sf: str) -> DataFrame:
    use = F.expr(
        "array('residential', 'residential_commercial', 'transport')[int(bigint(substring(zone_id, 2)) % 3)]"
    )
    return oc.change_land_use(fx.all_zones(spark, sf), use).select(
        "zone_id", "land_use", F.element_at("overrides", "trip_rate").alias("trip_rate")
    )


def _catalogs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Defaults per land use: sums over the suppliers of a nation class."""
    uses = fx.all_zones(spark, sf).select("package_id", "land_use").distinct()
    named = uses.filter("land_use != 'other'")
    system = named.selectExpr(
        "package_id", "land_use", "inline(array(named_struct('name', 'parking', 'value', 0.5D), named_struct('name', 'trip_rate', 'value', 1D)))"
    )
    user = named.filter("land_use = 'residential'").selectExpr(
        "package_id", "land_use", "'trip_rate' AS name", "2D AS value"
    )
    return system, user


def fn18_resolve_scenario(spark: SparkSession, sf: str) -> DataFrame:
    zones = fx.all_zones(spark, sf).withColumn(
        "overrides",
        F.expr("CASE WHEN bigint(substring(zone_id, 2)) % 17 = 9 THEN map('speed', 3D) ELSE overrides END"),
    )
    values, rejects = oc.resolve_scenario(zones, *_catalogs(spark, sf))
    return values.selectExpr("zone_id", "name", "value", "CAST(NULL AS string) AS code").unionByName(
        rejects.selectExpr("zone_id", "CAST(NULL AS string) AS name", "CAST(NULL AS double) AS value", "code")
    )


def ag12_uniqueness_checks(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.table(spark, sf, "lineitem")
    return oc.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "DUPLICATE_SOURCE_RECORD")


def ag12_declared_counts(spark: SparkSession, sf: str) -> DataFrame:
    header = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_custkey % 3 + 9 AS declared_count"
    )
    return oc.declared_count_check(header, fx.table(spark, sf, "orders"), ["o_custkey"])


# --- coordinates ------------------------------------------------------------------------


def fn8_metric_crs_check(spark: SparkSession, sf: str) -> DataFrame:
    names = "array('EPSG:32631', 'EPSG:4326', 'EPSG:2236', 'EPSG:9', NULL, 'EPSG:32733', 'EPSG:3857')"
    rows = fx.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", f"{names}[int(s_suppkey % 7)] AS crs")
    return co.metric_crs_check(rows)


def _game_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "nation").selectExpr(
        "bigint(n_nationkey) AS package_id",
        "100D + n_nationkey AS e0",
        "200D - n_nationkey AS n0",
        "4000D AS half_x",
        "3000D AS half_z",
    )


def fn19_game_forward(spark: SparkSession, sf: str) -> DataFrame:
    points = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "bigint(c_nationkey) AS package_id",
        "floor(c_acctbal) / 2D AS gx",
        "80D AS gh",
        "CASE WHEN c_custkey % 19 = 3 THEN double('NaN') ELSE (c_custkey % 8000) - 4000D END AS gz",
        "c_custkey % 23 = 5 AS for_export",
    )
    return co.game_forward(points, _game_mapping(spark, sf)).select(
        "id", "east", "north", "height", "code"
    )


def fn20_game_inverse(spark: SparkSession, sf: str) -> DataFrame:
    points = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "bigint(c_nationkey) AS package_id",
        "floor(c_acctbal) / 2D + 1D AS east",
        "(c_custkey % 8000) - 4000D AS north",
        "-10D AS height",
        "false AS for_export",
    )
    return co.game_inverse(points, _game_mapping(spark, sf)).select("id", "gx", "gh", "gz", "code")


def _package_grids(spark: SparkSession, sf: str) -> DataFrame:
    """A terrain and a depth grid per supplier; some pairs disagree in one way."""
    base = fx.table(spark, sf, "supplier").selectExpr("s_suppkey AS k")
    common = ["0D AS b", "0D AS d", "-9999D AS nodata", "'float32' AS dtype", "'m' AS band_unit", "1 AS band_count"]
    terrain = base.selectExpr(
        "k AS package_id", "'terrain' AS role", "concat('t', k) AS grid_id",
        "4 * int(k % 5 + 1) AS width", "8 AS height", "1D AS a", "98D + k AS c", "if(k % 9 = 4, 1D, -1D) AS e", "202D AS f",
        "if(k % 10 = 7, 'EPSG:4326', 'EPSG:32631') AS crs", *common,
    )
    depth = base.selectExpr(
        "k AS package_id", "'depth' AS role", "concat('d', k) AS grid_id",
        "2 * int(k % 5 + 1) AS width", "4 AS height", "2D AS a", "98D + k + if(k % 8 = 3, 1D, 0D) AS c", "-2D AS e", "202D AS f",
        "CASE WHEN k % 10 = 7 THEN 'EPSG:4326' WHEN k % 11 = 6 THEN 'EPSG:32632' ELSE 'EPSG:32631' END AS crs", *common,
    )
    return terrain.unionByName(depth)


def fn21_mapping_from_grids(spark: SparkSession, sf: str) -> DataFrame:
    return co.mapping_from_grids(_package_grids(spark, sf))


def g5_mapping_roundtrip_audit(spark: SparkSession, sf: str) -> DataFrame:
    mapping = co.mapping_from_grids(_package_grids(spark, sf))
    return co.roundtrip_audit(mapping).select("package_id", "roundtrip_points", "passed")


def g5_corner_cells(spark: SparkSession, sf: str) -> DataFrame:
    grids = _package_grids(spark, sf)
    usable = co.mapping_from_grids(grids)
    return co.corner_cells(grids, usable).filter("gx IS NOT NULL").select(
        "package_id", "row", "col", "gx", "gh", "gz"
    )


def ag10_roundtrip_max_error(spark: SparkSession, sf: str) -> DataFrame:
    audit = co.roundtrip_audit(co.mapping_from_grids(_package_grids(spark, sf)))
    return audit.select("package_id", (F.col("maximum_error_m") <= 1e-8).alias("within_tolerance"))


def g6_map_tile_audit(spark: SparkSession, sf: str) -> DataFrame:
    tiles = fx.objects(spark, sf).selectExpr(
        "package_id",
        "object_id AS feature_id",
        "CASE WHEN bigint(substring(object_id, 2)) % 37 = 0 THEN NULL ELSE geom END AS geom",
        "map('Object', if(bigint(substring(object_id, 2)) % 3 = 0, 'MapTile', 'Building')) AS props",
    )
    mapping = fx.plane_grid(spark, sf).selectExpr(
        "package_id", "50D AS e0", "height / 2D AS n0", "40D AS half_x", "height / 2D AS half_z",
        "CAST(NULL AS string) AS code",
    )
    return co.tile_audit(tiles, mapping).select(
        "map_tiles", "vertices", "vertices_outside", F.round("maximum_error_m", 6).alias("maximum_error_m")
    )


def fn22_reproject_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Longitudes and latitudes to zone 31; a few rows break a rule each."""
    rows = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "c_custkey % 601 / 100D AS x",
        "CASE WHEN c_custkey % 13 = 1 THEN 95D ELSE c_custkey * 7 % 1601 / 20D END AS y",
        "if(c_custkey % 11 = 2, 'EPSG:4269', 'EPSG:4326') AS source_crs",
        "if(c_custkey IS NULL, NULL, 'EPSG:32631') AS target_crs",
    )
    return co.reproject_vertices(rows).select(
        "id",
        F.round("tx", 3).alias("east"),
        F.round("ty", 3).alias("north"),
        F.col("transform_code").alias("code"),
    )


def fn22_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """From zone 31 to zone 32 and back to the same metre positions."""
    rows = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "400000D + c_custkey * 37 % 300000 AS x",
        "5000000D + c_custkey * 91 % 500000 AS y",
        "if(c_custkey IS NULL, NULL, 'EPSG:32631') AS source_crs",
        "if(c_custkey IS NULL, NULL, 'EPSG:32632') AS target_crs",
    )
    there = co.reproject_vertices(rows).selectExpr(
        "id", "x AS x0", "y AS y0", "tx AS x", "ty AS y", "target_crs AS source_crs", "source_crs AS target_crs"
    )
    return co.reproject_vertices(there).select(
        "id", F.round("tx", 4).alias("east"), F.round("ty", 4).alias("north")
    )


def fn23_densify(spark: SparkSession, sf: str) -> DataFrame:
    dense = co.densify(fx.all_zones(spark, sf).select("zone_id", "geom"), ["zone_id"], F.lit(4.0))
    return dense.select(
        "zone_id", "seq", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


def fn23_normalize_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Zone boxes read as degrees: densified, projected, or refused with a code."""
    faces = fx.all_zones(spark, sf).selectExpr(
        "package_id",
        "zone_id AS face_id",
        "named_struct('kind', 'polygon', 'has_z', false, 'parts', transform(geom.parts, p -> transform(p, r -> "
        "transform(r, v -> named_struct('x', v.x / 5000D, 'y', v.y / 5000D))))) AS geom",
        "if(zone_id IS NULL, NULL, 'EPSG:4326') AS source_crs",
        "CASE WHEN bigint(substring(zone_id, 2)) % 6 = 5 THEN 'EPSG:25831' WHEN bigint(substring(zone_id, 2)) % 6 = 4 THEN 'EPSG:4326' ELSE 'EPSG:32631' END AS target_crs",
    )
    vertices, rejected = co.normalize_polygons(faces)
    counted = vertices.groupBy("face_id").agg(
        F.count("*").alias("vertices"), F.count_if(F.col("tx").isNull()).alias("lost")
    )
    return counted.selectExpr("face_id", "vertices", "lost", "CAST(NULL AS string) AS code").unionByName(
        rejected.selectExpr("face_id", "0L AS vertices", "0L AS lost", "code")
    )


def g4_projection_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Grids centred on the zone-31 position of lon 0, lat 0, or 100 m off it."""
    base = fx.table(spark, sf, "supplier").selectExpr("s_suppkey AS k")
    common = ["0D AS b", "0D AS d", "10 AS height", "20 AS width"]
    zero_east = 166021.4430805405
    terrain = base.selectExpr(
        "k AS package_id", "'terrain' AS role", f"{zero_east}D - 10D + if(k % 4 = 1, 100D, 0D) AS c", "5D AS f", "1D AS a", "-1D AS e",
        "if(k % 9 = 2, 'EPSG:4326', 'EPSG:32631') AS crs", *common,
    )
    depth = base.filter("k % 10 != 3").selectExpr(
        "k AS package_id", "'depth' AS role", "0D AS c", "0D AS f", "1D AS a", "-1D AS e", "if(k % 9 = 2, 'EPSG:4326', 'EPSG:32631') AS crs", *common,
    )
    layers = base.selectExpr("k AS package_id", "if(k % 6 = 5, 'EPSG:32632', 'EPSG:32631') AS crs")
    settings = base.selectExpr(
        "k AS package_id", "if(k % 11 = 4, 'UTM', 'WGS84') AS projection", "0D AS x", "if(k % 13 = 6, 1D, 0D) AS y",
        "'panel' AS scope", "if(k % 17 = 8, '', 'seen') AS evidence",
    )
    return co.projection_audit(terrain.unionByName(depth), layers, settings).select(
        "package_id", "code", F.round("residual_m", 3).alias("residual_m"), "all_layers_match", "origin_candidate"
    )


# --- manifests and gates --------------------------------------------------------------


def _relative_manifest(spark: SparkSession, sf: str) -> DataFrame:
    relative = F.regexp_replace("path", "^https?://", "")
    return fx.page_manifest(spark, sf).withColumn("path", relative)


def ag13_manifest_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of every fifth bundle keep their scheme, which is not relative."""
    raw = fx.page_manifest(spark, sf).filter("package_id % 5 = 3")
    tidy = _relative_manifest(spark, sf).filter("package_id % 5 != 3").withColumn(
        "path", F.replace(F.col("path"), F.lit("/"), F.lit("\\"))
    )
    return fl.manifest_digest(tidy.unionByName(raw))


def jn13_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return fl.manifest_diff(fx.page_manifest(spark, sf), fx.changed_manifest(spark, sf)).select(
        "path", "state"
    )


def jn13_source_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return fl.source_unchanged(fx.page_manifest(spark, sf), fx.changed_manifest(spark, sf))


def _assertions(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "supplier").filter("s_suppkey % 20 != 19").selectExpr(
        "s_suppkey AS package_id",
        "s_suppkey % 2 = 0 AS carto_source_confirmed",
        "s_suppkey % 4 = 0 AS complete_depth_coverage_confirmed",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'm' END AS terrain_unit",
        "CASE WHEN s_suppkey % 5 != 0 THEN 'origin' END AS terrain_vertical_reference",
        "s_suppkey % 8 != 1 AS game_mapping_confirmed",
    )


def g1_assess_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's lines stand for the cells of one package."""
    profile = (
        fx.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("package_id"))
        .agg(
            F.count("*").alias("terrain_valid"),
            F.count_if(F.expr("l_quantity > 49")).alias("depth_valid"),
            (F.count("*") % 7 != 3).alias("conserved"),
            F.count_if(F.expr("l_linenumber = 7 AND l_quantity < 3")).alias("terrain_missing"),
            F.count_if(F.expr("l_linenumber = 6 AND l_quantity < 2")).alias("depth_outside"),
            F.count_if(F.expr("l_linenumber = 5 AND l_quantity < 2")).alias("unknown"),
        )
    )
    return pr.readiness(profile, _assertions(spark, sf)).withColumn(
        "blocking", F.array_join("blocking", ",")
    )


def g1_optional_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return pr.optional_diagnostics(pr.layer_profile(fx.network_features(spark, sf))).drop("package_id")


def g7_declaration_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Page bundles as packages with a declared and an observed identity."""
    digests = fl.manifest_digest(_relative_manifest(spark, sf)).select("package_id", "digest")
    declared = digests.selectExpr(
        "package_id",
        "package_id % 11 != 3 AS confirmed",
        "if(package_id % 12 = 5, ' ', 'note') AS evidence",
        "if(package_id % 13 = 4, '2.0', '1.0') AS version",
        "if(package_id % 7 = 5, 'old', digest) AS source_digest",
        "upper(substring(digest, 1, 8)) AS binary_hash",
    )
    observed = digests.selectExpr(
        "package_id",
        "'1.0' AS version",
        "digest AS source_digest",
        "if(package_id % 9 = 7, 'ffff', substring(digest, 1, 8)) AS binary_hash",
        "CASE WHEN package_id % 10 = 1 THEN 'SOURCE_FOOTPRINT_MISMATCH' END AS mapping_code",
        "package_id % 8 != 6 AS origin_ok",
        "true AS layers_match",
        "if(package_id % 6 = 2, 'int16', 'float32') AS dtype",
        "1 AS candidates",
        "true AS roundtrip_ok",
    )
    differences = fl.manifest_diff(fx.page_manifest(spark, sf), fx.changed_manifest(spark, sf)).filter(
        "package_id % 2 = 1"
    )
    references = digests.selectExpr(
        "package_id",
        "explode(array('terrain', 'depth')) AS role",
        "array(1D, 1D, if(package_id % 5 = 0, 1.001D, 1D)) AS stated",
        "array(1D, 1D, 1D) AS expected",
    )
    return pr.reconcile_declaration(declared, observed, differences, references)


def g8_package_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles, alignment and readiness of every package of the plane in one row."""
    grids = fx.grids(spark, sf)
    cells = fx.cells(spark, sf)
    return pr.package_summary(
        cells,
        grids,
        og.align_depth(fx.terrain_cells(spark, sf), fx.depth_cells(spark, sf), grids, fx.semantics(grids)),
        fx.semantics(grids).selectExpr(
            "package_id",
            "complete_coverage_confirmed AS carto_source_confirmed",
            "complete_coverage_confirmed AS complete_depth_coverage_confirmed",
            "'m' AS terrain_unit",
            "'origin' AS terrain_vertical_reference",
            "true AS game_mapping_confirmed",
        ),
    ).withColumn("blocking", F.array_join("blocking", ","))


# --- network, trips, streams ----------------------------------------------------------


def gr1_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    source = fx.table(spark, sf, "customer").filter("c_custkey = 0").selectExpr("c_custkey AS node")
    return on.shortest_paths(fx.graph_edges(spark, sf), source).select("node", "distance")


def jn12_snap_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return on.snap_nearest(fx.snap_points(spark, sf), fx.road_nodes(spark, sf)).drop("package_id")


def ag11_od_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = on.od_totals(fx.od_trips(spark, sf))
    return totals.select("origin", "destination", "trips", "records", F.col("level").cast("int").alias("level"))


def st1_stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Corridor requests arriving as event files, decided once each."""
    folder = new_folder(spark, "decisions")
    requests = fx.corridors_of(st.event_stream(spark, sf), "ts")
    tables = (
        fx.surveyed_objects(spark, sf),
        fx.surveyed_zones(spark, sf),
        fx.protected(spark, sf),
        fx.snapshot_header(spark, sf),
    )
    verdicts = st.decide_stream(
        requests, lambda batch: pd.decide_conflicts(batch.drop("ts"), *tables), folder
    )
    return st.answers(spark, verdicts).select(
        "corridor_id", "status", "reason", F.array_join("permitted_modes", ",").alias("permitted_modes"), "n_mandatory"
    )


def st2_stream_profile(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "profile")
    records = st.event_stream(spark, sf).selectExpr("ts", "event_type AS kind", "value")
    out = st.profile_stream(records, folder)
    return spark.read.parquet(out).selectExpr(
        "date_format(start, 'yyyy-MM-dd') AS day", "kind", "records", "positive", "low", "high"
    )


QUERIES = {
    name: query
    for name, query in list(globals().items())
    if name[:2] in ("sr", "sn", "fn", "ag", "g1", "g2", "g4", "g5", "g6", "g7", "g8", "jn", "gr", "st")
    and callable(query)
    and getattr(query, "__module__", "") == __name__
}
