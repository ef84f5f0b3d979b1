"""SQL twins of the source, contract, coordinate, gate and network queries."""

from __future__ import annotations

from platwork.registry.oracle import OK, cte, oracle


def codes(*cases: tuple[str, str]) -> str:
    """Comma list of the codes whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for test, code in cases)
    return f"array_to_string(list_filter([{items}], lambda c: c IS NOT NULL), ',')"


# --- sources ------------------------------------------------------------------------

oracle(
    "src2_features_scan",
    "SELECT layer, source_record_id, code <> 'null_geometry' AS has_geometry, obj AS object, 4 AS attributes FROM d_network",
)
oracle(
    "src2_declared_counts",
    "SELECT layer, count(*) AS records, count(*) FILTER (WHERE code = 'null_geometry') AS null_geometry FROM d_network GROUP BY layer",
)
oracle(
    "src3_geojson_scan",
    """SELECT okey // 64 AS collection_id, object_id AS feature_id, CASE WHEN okey % 31 <> 4 THEN round(CASE WHEN is_box THEN w * h ELSE w * h / 2 END, 6) END AS area,
         'object' AS kind, 'EPSG:32631' AS source_crs, CASE WHEN okey % 31 = 4 THEN 'INVALID_WATER_GEOMETRY' END AS code FROM d_objects""",
)
oracle(
    "src4_wkb_decode",
    """SELECT 'roads' AS layer, okey::VARCHAR AS source_record_id, ok AS readable, true AS finite_z, CASE WHEN ok THEN 'polygon' END AS kind,
         CASE WHEN ok THEN okey % 3 = 2 END AS has_z, CASE WHEN ok THEN 5 END AS vertices,
         CASE WHEN ok THEN round(CASE WHEN okey % 3 = 0 THEN 0 ELSE w * h END, 6) END AS area, CASE WHEN ok THEN x0 END AS xmin, CASE WHEN ok THEN y0 + h END AS ymax
       FROM (SELECT *, okey % 21 <> 6 AS ok FROM d_boundary)
       UNION ALL SELECT 'lost', '0', true, true, NULL, NULL, NULL, NULL, NULL, NULL""",
)
oracle(
    "src5_file_manifest",
    "SELECT url AS path, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages",
)
oracle(
    "src6_layer_component_check",
    """SELECT package_id, stem, files, array_to_string(list_filter(['shp', 'shx', 'dbf'], lambda e: NOT list_contains(exts, e)), ',') AS missing,
         CASE WHEN len(list_intersect(exts, ['shp', 'shx', 'dbf'])) < 3 THEN 'MISSING_SHAPEFILE_COMPONENT' END AS code
       FROM (SELECT p_partkey // 1000 AS package_id, 'layers/layer' || p_partkey // 5 AS stem, count(*) AS files,
               list(['shp', 'shx', 'dbf', 'cpg', 'prj'][p_partkey % 5 + 1]) AS exts FROM part WHERE p_partkey % 7 <> 3 GROUP BY ALL)""",
)
oracle(
    "src7_pick_unique_pair",
    """SELECT package_id, t AS terrain_files, d AS depth_files, CASE WHEN t = 1 AND d = 1 THEN tp END AS terrain_path, CASE WHEN t = 1 AND d = 1 THEN dp END AS depth_path,
         CASE WHEN NOT (t = 1 AND d = 1) THEN 'AMBIGUOUS_INPUT' END AS code
       FROM (SELECT o_custkey AS package_id, count(*) FILTER (WHERE kind = 0 AND tif) AS t, count(*) FILTER (WHERE kind = 1 AND tif) AS d,
               min('p' || o_custkey || '/' || o_orderkey || '_Elevation.tif') FILTER (WHERE kind = 0 AND tif) AS tp,
               min('p' || o_custkey || '/' || o_orderkey || '_Depth.tif') FILTER (WHERE kind = 1 AND tif) AS dp
             FROM (SELECT *, o_orderkey % 7 % 4 AS kind, o_orderkey % 11 <> 2 AS tif FROM orders) GROUP BY o_custkey)""",
)
oracle(
    "src8_strict_json_zones",
    """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 16 = 0 THEN 'z' || c_custkey END AS zone_id, CASE WHEN c_custkey % 16 = 0 THEN 20.5::DOUBLE END AS block_h,
         CASE WHEN c_custkey % 16 = 0 THEN true END AS allow_demolition, CASE WHEN c_custkey % 16 = 0 THEN 2.5::DOUBLE END AS trip_rate,
         [NULL, 'INVALID_SCHEMA', 'INVALID_SCHEMA', 'INVALID_PARAMETERS', 'INVALID_INPUT', 'INVALID_INPUT', 'INVALID_NUMBER', 'INVALID_ID', 'INVALID_GEOMETRY',
          'INVALID_PERMISSION', 'INVALID_BLOCK_SIZE', 'INVALID_NUMBER', 'INVALID_BLOCK_SIZE', 'SCENARIO_LOCKED', 'INVALID_INPUT', 'INVALID_INPUT'][c_custkey % 16 + 1] AS code
       FROM customer""",
)
oracle(
    "src9_strict_json_assertions",
    """SELECT c_custkey AS package_id, CASE WHEN k = 2 THEN NULL ELSE k = 1 END AS carto_source_confirmed, k IN (1, 5) AS game_mapping_confirmed,
         CASE k WHEN 1 THEN 'm' WHEN 3 THEN 'ft' END AS terrain_unit,
         ['', '', 'INVALID_SOURCE_ASSERTION', 'UNSUPPORTED_VERTICAL_UNIT', 'INVALID_VERTICAL_REFERENCE', 'MISSING_ASSERTION_EVIDENCE', 'SOURCE_UNCONFIRMED',
          'UNKNOWN_SOURCE_ASSERTION', 'INVALID_SOURCE_ASSERTION', 'INVALID_SOURCE_ASSERTION'][k + 1] AS codes
       FROM (SELECT c_custkey, c_custkey % 10 AS k FROM customer)""",
)
oracle(
    "snk1_zones_export",
    "SELECT zone_id, land_use, block_w, block_h, allow AS allow_demolition, trip_rate, 150.0::DOUBLE AS area FROM d_allzones",
)
oracle(
    "snk2_publish_new",
    "SELECT package_id, class, count(*) AS cells FROM d_classes GROUP BY ALL",
)
oracle(
    "snk3_terrain_and_mask_output",
    """SELECT package_id, "row", col, CASE WHEN terrain_valid THEN value::DOUBLE ELSE 'nan'::DOUBLE END AS height_m, class = 2 AS water, CAST("row" // 16 AS INT) AS tile_row
       FROM d_classes JOIN d_terrain USING (package_id, "row", col)""",
)
oracle(
    "snk4_package_manifest",
    "SELECT unnest(['terrain', 'class_mask', 'water_extent']) AS artifact, true AS has_files, true AS all_hashed",
)

# --- contracts ------------------------------------------------------------------------

oracle(
    "fn12_valid_number",
    f"""SELECT c_custkey, {codes(("c_custkey % 8 = 5", "INVALID_ID"), ("c_custkey % 6 IN (1, 2, 3) OR c_acctbal < 0", "INVALID_NUMBER"))} AS codes FROM customer""",
)
oracle(
    "fn13_zone_rules",
    "SELECT zone_id AS source_record_id, "
    + codes(
        ("k = 1", "INVALID_ID"),
        ("k = 2", "INVALID_GEOMETRY"),
        ("k = 3", "INVALID_LAND_USE"),
        ("k = 4", "INVALID_PERMISSION"),
        ("k = 5", "INVALID_NUMBER"),
        ("k = 6", "INVALID_BLOCK_SIZE"),
        ("k = 7", "INVALID_NUMBER"),
        (
            "(k = 7 AND land_use NOT IN ('residential', 'residential_commercial')) OR (k = 3 AND trip_rate IS NOT NULL)",
            "SCENARIO_LOCKED",
        ),
    )
    + " AS codes FROM (SELECT *, zkey % 10 AS k FROM d_allzones)",
)
oracle(
    "fn14_object_rules",
    f"SELECT object_id, {codes(('okey % 11 = 4', 'INVALID_ELEVATION'))} AS codes FROM d_objects",
)
oracle(
    "fn15_corridor_rules",
    "SELECT corridor_id, "
    + codes(
        ("event_id % 13 = 7", "INVALID_ID"),
        ("event_id % 13 = 2", "INVALID_ENVELOPE"),
        ("event_id % 13 IN (5, 6)", "INVALID_ASSET"),
        ("event_id % 13 = 8", "INVALID_NUMBER"),
    )
    + " AS codes FROM d_corridors",
)
oracle(
    "fn16_rules_check",
    "SELECT s_suppkey AS package_id, "
    + codes(
        ("s_suppkey % 9 = 1", "INVALID_ID"),
        ("s_suppkey % 5 = 0 OR s_suppkey % 7 = 2", "INVALID_NUMBER"),
        ("s_suppkey % 4 = 0", "INVALID_TUNNEL_RULE"),
    )
    + " AS codes FROM supplier",
)
oracle(
    "g2_assertion_rules",
    "SELECT k AS package_id, "
    + codes(
        ("k % 7 = 2", "UNSUPPORTED_VERTICAL_UNIT"),
        ("k % 11 = 2", "INVALID_VERTICAL_REFERENCE"),
        (
            "k % 13 >= 10 AND (k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 OR k % 7 IN (1, 2) OR k % 11 IN (1, 2))",
            "MISSING_ASSERTION_EVIDENCE",
        ),
        ("k % 3 = 0 AND k % 2 <> 0", "SOURCE_UNCONFIRMED"),
    )
    + " AS codes FROM (SELECT c_custkey AS k FROM customer)",
)
oracle(
    "fn17_change_land_use",
    """SELECT zone_id, ['residential', 'residential_commercial', 'transport'][zkey % 3 + 1] AS land_use, CASE WHEN zkey % 3 < 2 THEN trip_rate END AS trip_rate FROM d_allzones""",
)
cte(
    "d_resolved",
    """
    SELECT zone_id, land_use, CASE WHEN zkey % 17 = 9 THEN NULL ELSE trip_rate END AS own, zkey % 17 = 9 AS alien,
      land_use = 'other' AS no_default, zkey % 17 = 9 AND land_use NOT IN ('residential', 'residential_commercial') AS locked FROM d_allzones""",
)
oracle(
    "fn18_resolve_scenario",
    """SELECT zone_id, 'parking' AS name, 0.5::DOUBLE AS value, NULL::VARCHAR AS code FROM d_resolved WHERE NOT no_default AND NOT alien
       UNION ALL SELECT zone_id, 'trip_rate', coalesce(own, CASE WHEN land_use = 'residential' THEN 2.0 ELSE 1.0 END), NULL FROM d_resolved WHERE NOT no_default AND NOT alien
       UNION ALL SELECT zone_id, NULL, NULL, 'MISSING_DEFAULTS' FROM d_resolved WHERE no_default
       UNION ALL SELECT zone_id, NULL, NULL, 'UNKNOWN_PARAMETER' FROM d_resolved WHERE alien
       UNION ALL SELECT zone_id, NULL, NULL, 'SCENARIO_LOCKED' FROM d_resolved WHERE locked""",
)
oracle(
    "ag12_uniqueness_checks",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies, 'DUPLICATE_SOURCE_RECORD' AS code FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
oracle(
    "ag12_declared_counts",
    """SELECT c_custkey AS o_custkey, c_custkey % 3 + 9 AS declared_count, count(o_orderkey) AS actual_count,
         CASE WHEN count(o_orderkey) <> c_custkey % 3 + 9 THEN 'SOURCE_RECORDS_DROPPED' END AS code
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)

# --- coordinates ------------------------------------------------------------------------

oracle(
    "fn8_metric_crs_check",
    """SELECT s_suppkey AS id, ['EPSG:32631', 'EPSG:4326', 'EPSG:2236', 'EPSG:9', NULL, 'EPSG:32733', 'EPSG:3857'][s_suppkey % 7 + 1] AS crs,
         [NULL, 'NON_METRIC_CRS', 'NON_METRIC_CRS', 'INVALID_CRS', 'MISSING_CRS', NULL, NULL][s_suppkey % 7 + 1] AS crs_code FROM supplier""",
)
cte(
    "d_game",
    """
    SELECT c_custkey AS id, c_nationkey AS n, floor(c_acctbal) / 2 AS gx, CASE WHEN c_custkey % 19 = 3 THEN NULL ELSE c_custkey % 8000 - 4000.0::DOUBLE END AS gz,
      c_custkey % 23 = 5 AS for_export, c_custkey % 8000 - 4000.0::DOUBLE AS north FROM customer""",
)
oracle(
    "fn19_game_forward",
    """SELECT id, CASE WHEN code IS NULL THEN 100 + n + gx END AS east, CASE WHEN code IS NULL THEN 200 - n + gz END AS north, CASE WHEN code IS NULL THEN 80.0::DOUBLE END AS height, code
       FROM (SELECT *, CASE WHEN for_export THEN 'UNCONFIRMED_GAME_MAPPING' WHEN gz IS NULL THEN 'INVALID_COORDINATE' WHEN abs(gx) > 4000 OR abs(gz) > 3000 THEN 'OUTSIDE_SOURCE_COVERAGE' END AS code FROM d_game)""",
)
oracle(
    "fn20_game_inverse",
    """SELECT id, CASE WHEN code IS NULL THEN x END AS gx, CASE WHEN code IS NULL THEN -10.0::DOUBLE END AS gh, CASE WHEN code IS NULL THEN z END AS gz, code
       FROM (SELECT *, CASE WHEN abs(x) > 4000 OR abs(z) > 3000 THEN 'OUTSIDE_SOURCE_COVERAGE' END AS code FROM (SELECT id, gx + 1 - 100 - n AS x, north - 200 + n AS z FROM d_game))""",
)
cte(
    "d_pairs",
    """
    SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 7 THEN 'NON_METRIC_CRS' WHEN s_suppkey % 11 = 6 THEN 'CRS_MISMATCH' WHEN s_suppkey % 9 = 4 THEN 'UNSUPPORTED_GRID_ORIENTATION'
        WHEN s_suppkey % 8 = 3 THEN 'SOURCE_FOOTPRINT_MISMATCH' END AS code, 2.0::DOUBLE * (s_suppkey % 5 + 1) AS half_x FROM supplier""",
)
oracle(
    "fn21_mapping_from_grids",
    """SELECT k AS package_id, CASE WHEN code IS NULL THEN 98 + k + half_x END AS e0, CASE WHEN code IS NULL THEN 198.0::DOUBLE END AS n0,
         CASE WHEN code IS NULL THEN half_x END AS half_x, CASE WHEN code IS NULL THEN 4.0::DOUBLE END AS half_z, code FROM d_pairs""",
)
oracle(
    "g5_mapping_roundtrip_audit",
    "SELECT k AS package_id, 27 AS roundtrip_points, true AS passed FROM d_pairs WHERE code IS NULL",
)
oracle(
    "g5_corner_cells",
    """SELECT k AS package_id, r AS "row", c AS col, c + 0.5 - half_x AS gx, 0.0::DOUBLE AS gh, 3.5::DOUBLE - r AS gz
       FROM (SELECT *, unnest([0, 0, 7, 7]) AS r, unnest([0, (2 * half_x - 1)::INT, 0, (2 * half_x - 1)::INT]) AS c FROM d_pairs WHERE code IS NULL)""",
)
oracle(
    "ag10_roundtrip_max_error",
    "SELECT k AS package_id, true AS within_tolerance FROM d_pairs WHERE code IS NULL",
)
oracle(
    "g6_map_tile_audit",
    """SELECT (SELECT count(*) FROM d_objects WHERE okey % 3 = 0 AND okey % 37 <> 0) AS map_tiles, count(*) AS vertices,
         count(*) FILTER (WHERE x < 10 OR x > 90 OR y < 0 OR y > (SELECT high FROM d_plane)) AS vertices_outside, 0.0::DOUBLE AS maximum_error_m
       FROM (SELECT okey, unnest(CASE WHEN is_box THEN [x0, x0 + w, x0 + w, x0, x0] ELSE [x0, x0 + w, x0, x0] END) AS x,
               unnest(CASE WHEN is_box THEN [y0, y0, y0 + h, y0 + h, y0] ELSE [y0, y0, y0 + h, y0] END) AS y FROM d_objects WHERE okey % 3 = 0 AND okey % 37 <> 0)""",
)
# Transverse Mercator written out to the fourth order for the one ellipsoid in use.
cte(
    "d_geo",
    """
    SELECT c_custkey AS id, c_custkey % 601 / 100.0::DOUBLE AS lon, CASE WHEN c_custkey % 13 = 1 THEN 95.0::DOUBLE ELSE c_custkey * 7 % 1601 / 20.0::DOUBLE END AS lat,
      CASE WHEN c_custkey % 11 = 2 THEN 'DATUM_OPERATION_REQUIRED' WHEN c_custkey % 13 = 1 THEN 'INVALID_TRANSFORM_DOMAIN' END AS code,
      0.0016792203863837047::DOUBLE AS n, 0.08181919084262149::DOUBLE AS e FROM customer""",
)
cte(
    "d_tm",
    """
    SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM (
      SELECT *, radians(lon - 3) AS lam, sinh(asinh(tan(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM d_geo WHERE code IS NULL)""",
)
TM_TERMS = (
    "n/2 - 2*n*n/3 + 5*n*n*n/16 + 41*n*n*n*n/180",
    "13*n*n/48 - 3*n*n*n/5 + 557*n*n*n*n/1440",
    "61*n*n*n/240 - 103*n*n*n*n/140",
    "49561*n*n*n*n/161280",
)
EAST = " + ".join(f"({c}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(TM_TERMS, 1))
NORTH = " + ".join(f"({c}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(TM_TERMS, 1))
SCALE = "0.9996 * 6378137.0::DOUBLE / (1 + n) * (1 + n*n/4 + n*n*n*n/64)"
oracle(
    "fn22_reproject_vertices",
    f"""SELECT id, round(500000 + {SCALE} * (eta + {EAST}), 3) AS east, round({SCALE} * (xi + {NORTH}), 3) AS north, NULL::VARCHAR AS code FROM d_tm
        UNION ALL SELECT id, NULL, NULL, code FROM d_geo WHERE code IS NOT NULL""",
)
oracle(
    "fn22_roundtrip",
    """SELECT c_custkey AS id, 400000.0::DOUBLE + c_custkey * 37 % 300000 AS east, 5000000.0::DOUBLE + c_custkey * 91 % 500000 AS north FROM customer""",
)
oracle(
    "fn23_densify",
    """SELECT zone_id, seq, k, round(ax + (qx - ax) * k / n, 6) AS x, round(ay + (qy - ay) * k / n, 6) AS y FROM (
         SELECT *, unnest(range(n))::INT AS k FROM (
           SELECT zone_id, unnest([0, 1, 2, 3]) AS seq, unnest([3, 4, 3, 4]) AS n, unnest([zx0, zx1, zx1, zx0]) AS ax, unnest([zy0, zy0, zy1, zy1]) AS ay,
             unnest([zx1, zx1, zx0, zx0]) AS qx, unnest([zy0, zy1, zy1, zy0]) AS qy FROM d_allzones))""",
)
oracle(
    "fn23_normalize_polygons",
    """SELECT zone_id AS face_id, CASE WHEN zkey % 6 < 4 THEN (2 * greatest(1, ceil((zx1 / 5000 - zx0 / 5000) / 0.001)) + 2 * greatest(1, ceil((zy1 / 5000 - zy0 / 5000) / 0.001)))::BIGINT ELSE 0 END AS vertices,
         0 AS lost, CASE zkey % 6 WHEN 5 THEN 'DATUM_OPERATION_REQUIRED' WHEN 4 THEN 'NON_METRIC_CRS' END AS code FROM d_allzones""",
)
oracle(
    "g4_projection_audit",
    """SELECT k AS package_id, code, CASE WHEN code IS NULL THEN CASE WHEN k % 4 = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END AS residual_m,
         CASE WHEN code IS NULL THEN k % 6 <> 5 END AS all_layers_match, code IS NULL AND k % 4 <> 1 AS origin_candidate
       FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 4 OR s_suppkey % 13 = 6 THEN 'UNSUPPORTED_SETTINGS' WHEN s_suppkey % 17 = 8 THEN 'MISSING_SETTINGS_EVIDENCE'
             WHEN s_suppkey % 9 = 2 THEN 'NON_METRIC_CRS' WHEN s_suppkey % 10 = 3 THEN 'MISSING_CRS' END AS code FROM supplier)""",
)

# --- manifests and gates --------------------------------------------------------------

cte(
    "d_digest",
    """
    SELECT package_id, count(*) AS files, sha256('{' || string_agg('"' || path || '":"' || sha || '"', ',' ORDER BY path) || '}') AS digest
    FROM (SELECT page_id // 8 AS package_id, regexp_replace(url, '^https?://', '') AS path, sha256(html) AS sha FROM pages) GROUP BY package_id""",
)
oracle(
    "ag13_manifest_digest",
    """SELECT package_id, files, CASE WHEN package_id % 5 <> 3 THEN digest END AS digest, CASE WHEN package_id % 5 = 3 THEN 'INVALID_SOURCE_MANIFEST' END AS code FROM d_digest""",
)
oracle(
    "jn13_manifest_diff",
    """SELECT url AS path, CASE WHEN page_id % 25 = 7 THEN 'missing' ELSE 'changed' END AS state FROM pages WHERE page_id % 25 = 7 OR page_id % 10 = 3""",
)
cte(
    "d_bundles",
    """
    SELECT page_id // 8 AS k, count(*) FILTER (WHERE page_id % 25 = 7) AS missing, count(*) FILTER (WHERE page_id % 25 <> 7 AND page_id % 10 = 3) AS changed FROM pages GROUP BY 1""",
)
oracle(
    "jn13_source_unchanged",
    """SELECT k AS package_id, missing + changed AS differences, CASE WHEN missing + changed > 0 THEN 'SOURCE_CHANGED' END AS code FROM d_bundles""",
)
READY = (
    ("empty", "RASTER_EMPTY"),
    ("NOT conserved", "GRID_UNVERIFIED"),
    ("tm > 0", "TERRAIN_MISSING"),
    ("dout > 0", "DEPTH_OUTSIDE_ROI"),
    ("NOT src", "CARTO_SOURCE_UNCONFIRMED"),
    ("NOT dc", "DEPTH_COVERAGE_UNCONFIRMED"),
    ("unk > 0", "LAND_WATER_UNKNOWN"),
    ("NOT unit", "TERRAIN_UNIT_UNCONFIRMED"),
    ("NOT ref", "VERTICAL_REFERENCE_UNCONFIRMED"),
    ("NOT map", "GAME_MAPPING_UNCONFIRMED"),
)
oracle(
    "g1_assess_readiness",
    f"""SELECT k AS package_id, blocking, blocking = '' AS planning_ready, NOT empty AS can_read_rasters, conserved AS can_partition_grid, unk = 0 AND dc AND src AS complete_land_water FROM (
        SELECT *, {codes(*READY)} AS blocking FROM (
          SELECT l_suppkey AS k, count(*) FILTER (WHERE l_quantity > 49) = 0 AS empty, count(*) % 7 <> 3 AS conserved,
            count(*) FILTER (WHERE l_linenumber = 7 AND l_quantity < 3) AS tm, count(*) FILTER (WHERE l_linenumber = 6 AND l_quantity < 2) AS dout,
            count(*) FILTER (WHERE l_linenumber = 5 AND l_quantity < 2) AS unk, l_suppkey % 20 <> 19 AND l_suppkey % 2 = 0 AS src, l_suppkey % 20 <> 19 AND l_suppkey % 4 = 0 AS dc,
            l_suppkey % 20 <> 19 AND l_suppkey % 3 = 0 AS unit, l_suppkey % 20 <> 19 AND l_suppkey % 5 <> 0 AS ref, l_suppkey % 20 <> 19 AND l_suppkey % 8 <> 1 AS map
          FROM lineitem GROUP BY l_suppkey))""",
)
oracle(
    "g1_optional_diagnostics",
    """SELECT layer, 'OPTIONAL_LAYER_QUARANTINE' AS code, count(*) AS issues, 'degraded' AS severity FROM d_network WHERE code <> 'valid_planar_geometry' GROUP BY layer""",
)
oracle(
    "g7_declaration_reconciliation",
    """SELECT k AS package_id, code, code IS NULL AS game_mapping_confirmed FROM (SELECT k, CASE
        WHEN k % 11 = 3 OR k % 12 = 5 THEN 'EXPORT_VERSION_UNCONFIRMED' WHEN k % 13 = 4 THEN 'UNSUPPORTED_EXPORT_VERSION' WHEN k % 9 = 7 THEN 'INSTALLATION_IDENTITY_MISMATCH'
        WHEN k % 7 = 5 THEN 'STALE_VERSION_DECLARATION' WHEN k % 2 = 1 AND missing > 0 THEN 'PINNED_SOURCE_MISSING' WHEN k % 2 = 1 AND changed > 0 THEN 'PINNED_SOURCE_CHANGED'
        WHEN k % 10 = 1 THEN 'SOURCE_FOOTPRINT_MISMATCH' WHEN k % 8 = 6 THEN 'UNSUPPORTED_MAPPING_CONTEXT' WHEN k % 6 = 2 THEN 'UNSUPPORTED_NATIVE_FORMAT'
        WHEN k % 5 = 0 THEN 'NATIVE_REFERENCE_MISMATCH' END AS code FROM d_bundles)""",
)
oracle(
    "g8_package_summary",
    f"""SELECT package_id, terrain_valid_pixels, terrain_valid_min, terrain_valid_max, depth_valid_pixels, water, land, unk AS unknown, unk = 0 AND tm = 0 AS complete, blocking,
          blocking = '' AS planning_ready, unk = 0 AND dc AND src AS complete_land_water FROM (
        SELECT *, {codes(*READY)} AS blocking FROM (
          SELECT *, NOT (terrain_valid_pixels > 0 AND coalesce(depth_valid_pixels, 0) > 0) AS empty, true AS conserved, package_id % 2 = 0 AS src, package_id % 2 = 0 AS dc, true AS unit, true AS ref, true AS map
          FROM (SELECT package_id, count(*) FILTER (WHERE {OK}) AS terrain_valid_pixels, min(value) FILTER (WHERE {OK})::DOUBLE AS terrain_valid_min, max(value) FILTER (WHERE {OK})::DOUBLE AS terrain_valid_max FROM d_terrain GROUP BY 1)
          LEFT JOIN (SELECT package_id, count(*) FILTER (WHERE {OK}) AS depth_valid_pixels FROM d_depth GROUP BY 1) USING (package_id)
          JOIN (SELECT package_id, count(*) FILTER (WHERE class = 2) AS water, count(*) FILTER (WHERE class = 1) AS land, count(*) FILTER (WHERE class IN (0, 3)) AS unk,
                  count(*) FILTER (WHERE NOT terrain_valid) AS tm, count(*) FILTER (WHERE NOT covered) AS dout FROM d_classes GROUP BY 1) USING (package_id)))""",
)

# --- network, trips, streams ----------------------------------------------------------

cte(
    "d_edges",
    """SELECT o_custkey AS src, o_orderkey * 7919 % (SELECT count(*) FROM customer) AS dst, floor(o_totalprice / 1000) AS weight FROM orders""",
)
cte(
    "d_hops",
    """
    SELECT 0::BIGINT AS node, 0.0::DOUBLE AS distance, 0 AS hops
    UNION ALL
    SELECT node, distance, hops FROM (SELECT e.dst AS node, min(h.distance + e.weight) AS distance, max(h.hops) + 1 AS hops
      FROM d_hops h JOIN d_edges e ON e.src = h.node WHERE h.hops < 60 GROUP BY e.dst)""",
)
oracle("gr1_shortest_path", "SELECT node, min(distance) AS distance FROM d_hops GROUP BY node")
oracle(
    "jn12_snap_nearest",
    """WITH n AS (SELECT vec_id, round(embedding[1]::DOUBLE * 64) AS x, round(embedding[2]::DOUBLE * 64) AS y FROM embeddings),
         p AS (SELECT event_id, (user_id * 13 % 129 - 64)::DOUBLE AS x, (event_id * 7 % 129 - 64)::DOUBLE AS y FROM events)
       SELECT event_id AS point_id, best.id AS node_id, best.d2 AS distance_sq FROM (
         SELECT event_id, min({'d2': (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), 'id': vec_id}) AS best FROM p, n GROUP BY event_id)""",
)
oracle(
    "ag11_od_totals",
    """SELECT l_suppkey AS origin, l_partkey % 10 AS destination, sum(l_quantity) AS trips, count(*) AS records, grouping(l_suppkey, l_partkey % 10)::INT AS level
       FROM lineitem GROUP BY CUBE (l_suppkey, l_partkey % 10)""",
)
oracle(
    "st1_stream_decisions",
    """SELECT corridor_id, status, reason, permitted_modes, CASE WHEN stale OR barred THEN 0 ELSE nm END AS n_mandatory FROM d_verdicts""",
)
oracle(
    "st2_stream_profile",
    """SELECT strftime(day, '%Y-%m-%d') AS day, kind, records, positive, low, high FROM (
         SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS records, count(*) FILTER (WHERE value > 0) AS positive, min(value) AS low, max(value) AS high
         FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
