"""SQL twins of the face, layer and quality queries."""

from __future__ import annotations

from platwork.registry.oracle import cte, oracle

cte(
    "d_faces",
    """
    SELECT 'w' || n_nationkey AS face_id, x, y, true AS is_box FROM (SELECT n_nationkey, (n_nationkey * 11 % 90)::DOUBLE AS x,
        (n_nationkey * (SELECT high FROM d_plane) // 25)::DOUBLE AS y FROM nation)
    UNION ALL
    SELECT 't' || n_nationkey, x + 4, y, false FROM (SELECT n_nationkey, (n_nationkey * 11 % 90)::DOUBLE AS x,
        (n_nationkey * (SELECT high FROM d_plane) // 25)::DOUBLE AS y FROM nation) WHERE n_nationkey % 2 = 1""",
)
# Triangle (0,0) (12,1) (0,12): inside test by its three sides.
INSIDE = (
    "(is_box AND cx > x AND cx < x + 8 AND cy > y AND cy < y + 5) OR (NOT is_box AND cx > x "
    "AND (cx - x) * 1 - (cy - y) * 12 < 0 AND (cx - x) * 11 + (cy - y) * 12 < 144)"
)
cte(
    "d_wet",
    f"""
    SELECT r."row", c.col FROM (SELECT range AS "row", (SELECT high FROM d_plane) - range - 0.5 AS cy FROM range((SELECT high FROM d_plane))) r,
      (SELECT range AS col, range + 0.5 AS cx FROM range(100)) c
    WHERE EXISTS (SELECT 1 FROM d_faces WHERE {INSIDE})""",
)
oracle("jn3_polygon_to_cells", 'SELECT "row"::BIGINT AS "row", col FROM d_wet')
cte(
    "d_plane_cells",
    """SELECT CAST(package_id * 50 + "row" AS INT) AS "row", col, value, mask FROM d_terrain""",
)
cte(
    "d_face_classes",
    """SELECT c.*, CASE WHEN c.col >= 80 THEN 0 WHEN w.col IS NOT NULL THEN 2 ELSE 1 END AS class
       FROM d_plane_cells c LEFT JOIN d_wet w ON w."row" = c."row" AND w.col = c.col""",
)
oracle("jn4_classify_water_faces", 'SELECT "row", col, class FROM d_face_classes')
oracle(
    "jn5_clip_by_polygon",
    'SELECT c."row", c.col, c.value FROM d_plane_cells c JOIN d_wet w ON w."row" = c."row" AND w.col = c.col',
)
oracle(
    "g3_water_face_report",
    """SELECT water, land, unknown, water::DOUBLE AS water_m2, cells::DOUBLE AS roi_m2, terrain_valid, cells - terrain_valid AS terrain_missing,
         round(low * 0.3048, 6) AS terrain_min_m, round(high * 0.3048, 6) AS terrain_max_m,
         array_to_string(list_filter([CASE WHEN unknown > 0 THEN 'WATER_COVERAGE_UNKNOWN' END, CASE WHEN terrain_valid < cells THEN 'TERRAIN_MISSING' END,
           'VERTICAL_REFERENCE_UNCONFIRMED'], lambda c: c IS NOT NULL), ',') AS diagnostics, false AS ready
       FROM (SELECT count(*) FILTER (WHERE class = 2) AS water, count(*) FILTER (WHERE class = 1) AS land, count(*) FILTER (WHERE class = 0) AS unknown,
           count(*) AS cells, count(*) FILTER (WHERE mask > 0 AND NOT isnan(value) AND value <> -9999) AS terrain_valid,
           min(value) FILTER (WHERE mask > 0 AND NOT isnan(value) AND value <> -9999)::DOUBLE AS low,
           max(value) FILTER (WHERE mask > 0 AND NOT isnan(value) AND value <> -9999)::DOUBLE AS high FROM d_face_classes)""",
)
# Union area by vertical slabs between all corner and crossing abscissae.
cte(
    "d_face_sides",
    """
    SELECT face_id, unnest(CASE WHEN is_box THEN [x, x] ELSE [x, x] END) AS x1, unnest(CASE WHEN is_box THEN [y, y + 5] ELSE [y, y + 12] END) AS y1,
      unnest(CASE WHEN is_box THEN [x + 8, x + 8] ELSE [x + 12, x + 12] END) AS x2, unnest(CASE WHEN is_box THEN [y, y + 5] ELSE [y + 1, y + 1] END) AS y2,
      unnest([0, 1]) AS upper FROM d_faces""",
)
cte(
    "d_breaks",
    """
    SELECT DISTINCT b FROM (SELECT x1 AS b FROM d_face_sides UNION ALL SELECT x2 FROM d_face_sides UNION ALL SELECT 80.0
      UNION ALL SELECT p.x1 + ((q.y1 - p.y1) + (p.x1 - q.x1) * (q.y2 - q.y1) / (q.x2 - q.x1)) / ((p.y2 - p.y1) / (p.x2 - p.x1) - (q.y2 - q.y1) / (q.x2 - q.x1)) AS b
        FROM d_face_sides p JOIN d_face_sides q ON (p.y2 - p.y1) / (p.x2 - p.x1) > (q.y2 - q.y1) / (q.x2 - q.x1)
      UNION ALL SELECT p.x1 + (h - p.y1) * (p.x2 - p.x1) / (p.y2 - p.y1) FROM d_face_sides p, (SELECT 0.0 AS h UNION ALL SELECT high FROM d_plane) WHERE p.y1 <> p.y2)""",
)
cte(
    "d_slabs",
    """SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM d_breaks""",
)
cte(
    "d_spans",
    """
    SELECT lo, hi, y_low, y_high FROM (
      SELECT s.lo, s.hi, f.face_id, min(y1 + ((s.lo + s.hi) / 2 - x1) * (y2 - y1) / (x2 - x1)) AS y_low,
        max(y1 + ((s.lo + s.hi) / 2 - x1) * (y2 - y1) / (x2 - x1)) AS y_high
      FROM d_slabs s JOIN d_face_sides f ON f.x1 < (s.lo + s.hi) / 2 AND f.x2 > (s.lo + s.hi) / 2 GROUP BY s.lo, s.hi, f.face_id)""",
)


def _covered(low: str, high: str) -> str:
    """Length of the union of [low, high] per slab, times its width."""
    return f"""
    SELECT sum((hi - lo) * greatest(0, top - greatest(bottom, coalesce(before, bottom)))) FROM (
      SELECT *, max(top) OVER (PARTITION BY lo ORDER BY bottom, top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT lo, hi, {low} AS bottom, {high} AS top FROM d_spans) WHERE top > bottom)"""


oracle(
    "sp7_union_coverage_clip",
    f"""SELECT round(u, 6) AS union_area, round(c, 6) AS clipped_area, round(greatest(0, u - c), 6) AS outside_area FROM (
        SELECT ({_covered('y_low', 'y_high')}) AS u,
          ({_covered('greatest(y_low, 0)', 'least(y_high, (SELECT high FROM d_plane))').replace('FROM d_spans', 'FROM d_spans WHERE hi <= 80')}) AS c)""",
)
oracle(
    "sp7_touching_leftovers",
    """SELECT face_id, 'LineString' AS form FROM d_faces WHERE x = 80 OR (is_box AND x + 8 = 0) OR y = (SELECT high FROM d_plane)
       UNION ALL SELECT 'e' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'LineString' ELSE 'Point' END FROM nation""",
)
oracle(
    "w3_window_roi_compare",
    """SELECT package_id, CAST("row" // 8 AS INT) AS tile_row, CAST(col // 8 AS INT) AS tile_col, count(*) AS direct_cells, count(*) AS face_cells, true AS agree
       FROM d_depth WHERE value > 0 GROUP BY ALL""",
)

# --- attributes -------------------------------------------------------------------------

cte(
    "d_network",
    """
    SELECT p_partkey AS k, p_partkey::VARCHAR AS source_record_id, CASE WHEN p_partkey % 4 = 0 THEN 'Building' ELSE 'Network' END AS layer,
      ['Road', 'Track', 'Pathway', 'Taxiway', 'Runway', 'Tram', 'Road, Tram'][p_partkey % 7 + 1] AS obj,
      ['Small, Tram', 'Cargo', 'Tram', ' Large ,,Small', NULL][p_size % 5 + 1] AS cat,
      ['Normal', 'Elevated', 'Tunnel', 'Normal,Tunnel', NULL][p_partkey % 5 + 1] AS form, (p_partkey % 4 + 1)::VARCHAR AS lane,
      CASE p_partkey % 29 WHEN 3 THEN 'null_geometry' WHEN 5 THEN 'empty_geometry' WHEN 7 THEN 'invalid_geometry'
        WHEN 11 THEN 'z_geometry_requires_adapter' ELSE 'valid_planar_geometry' END AS code
    FROM part""",
)
oracle(
    "fn10_source_tokens",
    """SELECT source_record_id, CASE cat WHEN 'Small, Tram' THEN 'Small|Tram' WHEN ' Large ,,Small' THEN 'Large|Small' ELSE coalesce(cat, '') END AS tokens FROM d_network""",
)
cte(
    "d_normal",
    """
    SELECT *, CASE form WHEN 'Normal' THEN 'SURFACE' WHEN 'Elevated' THEN 'ELEVATED' WHEN 'Tunnel' THEN 'TUNNEL' END AS nform,
      obj IN ('Pathway', 'Taxiway', 'Runway', 'Tram', 'Road, Tram') OR (obj = 'Track' AND cat IS NOT NULL AND (cat LIKE '%Tram%' OR cat = 'Cargo')) AS excluded
    FROM d_network""",
)
oracle(
    "fn11_normalize_network",
    """SELECT source_record_id, nform AS form, excluded, obj = 'Road' AS road_candidate, lane AS lanes_source,
         CASE WHEN nform IS NULL THEN 'UNKNOWN_OR_AMBIGUOUS_FORM' END AS diagnostic, replace(obj, ', ', '|') AS source_object FROM d_normal""",
)
oracle(
    "ag5_categorical_counts",
    """SELECT layer, attribute, trim(token) AS token, count(*) AS n FROM (
         SELECT layer, 'Object' AS attribute, unnest(string_split(obj, ',')) AS token FROM d_network
         UNION ALL SELECT layer, 'Category', unnest(string_split(cat, ',')) FROM d_network
         UNION ALL SELECT layer, 'Form', unnest(string_split(form, ',')) FROM d_network)
       WHERE trim(token) <> '' GROUP BY ALL""",
)
oracle("q1_scan_quality", "SELECT source_record_id, layer, code FROM d_network")
oracle(
    "ag4_layer_profile",
    """SELECT layer, count(*) AS records_read, count(*) FILTER (WHERE code = 'null_geometry') AS null_geometry,
         count(*) FILTER (WHERE code = 'empty_geometry') AS empty_geometry, count(*) FILTER (WHERE code = 'invalid_geometry') AS invalid_geometry,
         count(*) FILTER (WHERE code = 'z_geometry_requires_adapter') AS z_geometry_requires_adapter,
         count(*) FILTER (WHERE ok) AS valid_planar_geometry,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform = 'SURFACE') AS form_surface,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform = 'ELEVATED') AS form_elevated,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform = 'TUNNEL') AS form_tunnel,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform IS NULL) AS form_unknown,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND excluded) AS excluded_background,
         count(*) FILTER (WHERE ok AND layer = 'Building' AND met) AS associated,
         count(*) FILTER (WHERE ok AND layer = 'Building' AND NOT met) AS pending_association,
         count(*) FILTER (WHERE ok AND layer = 'Building') AS foundation_unknown
       FROM (SELECT *, false AS met, code = 'valid_planar_geometry' AS ok FROM d_normal) GROUP BY layer""",
)
oracle(
    "ag4_layer_profile_with_zones",
    """SELECT layer, count(*) AS records_read, count(*) FILTER (WHERE code = 'null_geometry') AS null_geometry,
         count(*) FILTER (WHERE code = 'empty_geometry') AS empty_geometry, count(*) FILTER (WHERE code = 'invalid_geometry') AS invalid_geometry,
         count(*) FILTER (WHERE code = 'z_geometry_requires_adapter') AS z_geometry_requires_adapter,
         count(*) FILTER (WHERE ok) AS valid_planar_geometry,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform = 'SURFACE') AS form_surface,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform = 'ELEVATED') AS form_elevated,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform = 'TUNNEL') AS form_tunnel,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND nform IS NULL) AS form_unknown,
         count(*) FILTER (WHERE ok AND layer = 'Network' AND excluded) AS excluded_background,
         count(*) FILTER (WHERE ok AND layer = 'Building' AND met) AS associated,
         count(*) FILTER (WHERE ok AND layer = 'Building' AND NOT met) AS pending_association,
         count(*) FILTER (WHERE ok AND layer = 'Building') AS foundation_unknown
       FROM (SELECT *, source_record_id IN (SELECT okey::VARCHAR FROM d_objects
           JOIN d_zones ON zone_ok AND x0 <= zx1 AND zx0 <= x0 + w AND y0 <= zy1 AND zy0 <= y0 + h) AS met, code = 'valid_planar_geometry' AS ok FROM d_normal) GROUP BY layer""",
)

# --- geometry quality ---------------------------------------------------------------------

LOST = "SELECT 'lost' AS layer, '0' AS source_record_id"
oracle(
    "fn24_object_identity",
    """SELECT okey::VARCHAR AS source_record_id, boundary_id AS object_id FROM d_boundary
       UNION ALL SELECT '0', 'boundary:' || substr(sha256('lost' || chr(0) || 'r1'), 1, 16) || ':0'""",
)
oracle(
    "fn25_geometry_measures",
    """SELECT object_id, round(CASE WHEN is_box THEN w * h ELSE w * h / 2 END, 6) AS area,
         round(CASE WHEN is_box THEN 2 * (w + h) ELSE w + h + sqrt(w * w + h * h) END, 6) AS outline,
         x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax, false AS is_empty FROM d_objects""",
)
oracle(
    "fn26_guard_geometry",
    """SELECT 'roads' AS layer, okey::VARCHAR AS source_record_id, round(w * h, 6) AS guard_area, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax, false AS unlocatable FROM d_boundary
       UNION ALL SELECT 'lost', '0', NULL, NULL, NULL, NULL, NULL, true""",
)
oracle(
    "q2_source_quality",
    """SELECT 'roads' AS layer, okey::VARCHAR AS source_record_id, quality FROM d_boundary UNION ALL SELECT 'lost', '0', 'NULL_GEOMETRY'""",
)
oracle(
    "q3_validity",
    """SELECT 'roads' AS layer, okey::VARCHAR AS source_record_id, okey % 3 <> 0 AS is_valid FROM d_boundary UNION ALL SELECT 'lost', '0', NULL""",
)
# A bow-tie over a w x h box: two triangles of half the box together, four half diagonals and two sides.
oracle(
    "q4_repair_review",
    """SELECT okey::VARCHAR AS source_record_id, 'POLYGON_CANDIDATE' AS status, 6 AS odd_edges, 0 AS even_edges,
         0.0::DOUBLE AS source_area, round(w * h / 2, 6) AS candidate_area, false AS physical_envelope_accepted, true AS review_required
       FROM d_boundary WHERE okey % 3 = 0""",
)
oracle(
    "ag7_review_counts",
    """SELECT layer, CASE code WHEN 'empty_geometry' THEN 'UNSUPPORTED_REVIEW' ELSE 'POLYGON_CANDIDATE' END AS status, count(*) AS records
       FROM d_network WHERE code IN ('empty_geometry', 'invalid_geometry') GROUP BY ALL""",
)
oracle(
    "q5_boundary_report",
    """SELECT 'roads' AS layer, okey::VARCHAR AS source_record_id, boundary_id AS object_id, quality,
         ['Normal', 'Elevated', 'Tunnel'][okey // 3 % 3 + 1] AS source_form, false AS no_source, 64 AS hash_length, x0 AS xmin, y0 + h AS ymax,
         true AS location_known, CASE WHEN okey % 3 = 0 THEN 'POLYGON_CANDIDATE' END AS candidate_status, true AS source_agrees,
         false AS candidate_accepted, false AS physical_envelope_accepted, false AS automatic_demolition_allowed, true AS review_required
       FROM d_boundary WHERE quality <> 'VALID_PLANAR_SOURCE'
       UNION ALL SELECT 'lost', '0', 'boundary:' || substr(sha256('lost' || chr(0) || 'r1'), 1, 16) || ':0', 'NULL_GEOMETRY', NULL, true, NULL, NULL, NULL, false, NULL, NULL, false, false, false, true""",
)
oracle(
    "ag6_quality_counts",
    """SELECT 'roads' AS layer, quality, count(*) AS records, count(*) FILTER (WHERE quality <> 'VALID_PLANAR_SOURCE') AS degraded, 0 AS unlocatable
       FROM d_boundary GROUP BY quality UNION ALL SELECT 'lost', 'NULL_GEOMETRY', 1, 1, 1""",
)
oracle(
    "ag6_candidate_counts",
    """SELECT 'roads' AS layer, (SELECT count(*) FROM d_boundary) AS declared_count, (SELECT count(*) FROM d_boundary) AS retained, 0 AS dropped,
         CASE WHEN okey % 3 = 0 THEN 'POLYGON_CANDIDATE' END AS candidate_status, count(*) AS records
       FROM d_boundary GROUP BY ALL UNION ALL SELECT 'lost', 2, 1, 1, NULL, 1""",
)
oracle(
    "sp8_segment_nodes",
    """SELECT source_record_id, round(least_x, 6) AS x1, round(least_y, 6) AS y1, round(most_x, 6) AS x2, round(most_y, 6) AS y2, 1 AS drawn FROM (
         SELECT okey::VARCHAR AS source_record_id,
           CASE WHEN (ax, ay) <= (qx, qy) THEN ax ELSE qx END AS least_x, CASE WHEN (ax, ay) <= (qx, qy) THEN ay ELSE qy END AS least_y,
           CASE WHEN (ax, ay) <= (qx, qy) THEN qx ELSE ax END AS most_x, CASE WHEN (ax, ay) <= (qx, qy) THEN qy ELSE ay END AS most_y
         FROM (
           SELECT okey, unnest([x0, x0 + w, x0 + w, x0]) AS ax, unnest([y0, y0, y0 + h, y0 + h]) AS ay,
             unnest([x0 + w, x0 + w, x0, x0]) AS qx, unnest([y0, y0 + h, y0 + h, y0]) AS qy FROM d_boundary WHERE okey % 3 <> 0
           UNION ALL
           SELECT okey, unnest([x0, x0 + w / 2, x0 + w, x0 + w, x0 + w / 2, x0]), unnest([y0, y0 + h / 2, y0 + h, y0, y0 + h / 2, y0 + h]),
             unnest([x0 + w / 2, x0 + w, x0 + w, x0 + w / 2, x0, x0]), unnest([y0 + h / 2, y0 + h, y0, y0 + h / 2, y0 + h, y0]) FROM d_boundary WHERE okey % 3 = 0))""",
)
oracle(
    "q6_snapshot_integrity",
    """SELECT bundle AS package_id, n AS actual_count, array_to_string(list_filter([
           CASE WHEN bundle % 7 = 3 THEN 'INVALID_BOUNDARY_SNAPSHOT' END, CASE WHEN bundle % 4 = 1 THEN 'SOURCE_RECORDS_DROPPED' END,
           CASE WHEN bundle % 5 = 2 AND n = 8 THEN 'DUPLICATE_SOURCE_RECORD' END, CASE WHEN broken THEN 'INVALID_SOURCE_HASH' END,
           CASE WHEN bundle % 6 = 5 THEN 'INVALID_COVERAGE' END, CASE WHEN bundle % 9 = 8 THEN 'INVALID_COVERAGE_ASSERTION' END], lambda c: c IS NOT NULL), ',') AS codes
       FROM (SELECT page_id // 8 AS bundle, count(*) AS n, bool_or(page_id % 41 = 9) AS broken FROM pages GROUP BY 1)""",
)
