"""SQL twins of the vector and policy queries."""

from __future__ import annotations

from platwork.registry.oracle import cte, oracle

LAND_USE_SQL = (
    "['residential','residential_commercial','commercial','industrial','office',"
    "'public_service','transport','protection','other']"
)

cte(
    "d_allzones",
    f"""
    SELECT 'z' || s_suppkey AS zone_id, s_suppkey AS zkey, s_suppkey % 10 * 10.0::DOUBLE AS zx0, s_suppkey // 10 * 15.0::DOUBLE AS zy0,
      s_suppkey % 10 * 10.0::DOUBLE + 10 AS zx1, s_suppkey // 10 * 15.0::DOUBLE + 15 AS zy1,
      {LAND_USE_SQL}[s_nationkey % 9 + 1] AS land_use, s_suppkey % 3 <> 0 AS allow,
      (s_suppkey % 5 + 1) * 20.0::DOUBLE AS block_w, (s_suppkey % 4 + 1) * 30.0::DOUBLE AS block_h,
      CASE WHEN s_nationkey % 9 IN (0, 1) AND s_suppkey % 4 = 1 THEN s_suppkey / 8.0::DOUBLE END AS trip_rate
    FROM supplier""",
)
# Invalid zones and objects (a spike in their ring) cover what their boxes cover, but match nothing.
cte("d_zones", "SELECT *, zkey % 13 <> 7 AS zone_ok FROM d_allzones WHERE zkey % 13 <> 5")
cte(
    "d_objects",
    """
    SELECT 'b' || p_partkey AS object_id, p_partkey AS okey, p_partkey % 2 = 0 AS is_box, p_partkey % 38 <> 4 AS object_ok,
      (p_partkey * 37 % 400) / 4.0::DOUBLE AS x0, (p_partkey * 3 // 10) / 4.0::DOUBLE AS y0,
      (p_size % 8 + 1) / 4.0::DOUBLE AS w, (p_partkey % 5 + 1) / 4.0::DOUBLE AS h, p_size,
      floor(p_retailprice) / 8.0::DOUBLE AS ground,
      CASE WHEN p_partkey % 7 <> 0 THEN floor(p_retailprice) / 8.0::DOUBLE - p_size / 4.0::DOUBLE END AS foundation
    FROM part""",
)
cte(
    "d_corridors",
    """
    SELECT *, vx0 + event_id % 8 / 4.0::DOUBLE + 0.5 AS vx1, vy0 + event_id % 5 / 4.0::DOUBLE AS vy1,
      vx0 + event_id % 8 / 4.0::DOUBLE + 1.0 AS vx2, vy0 + event_id % 5 / 4.0::DOUBLE - 0.25 AS vy2,
      (event_id % 4 + 1) / 8.0::DOUBLE AS radius, 'c' || event_id AS corridor_id,
      CASE event_type WHEN 'purchase' THEN 'elevated' WHEN 'error' THEN 'elevated' WHEN 'signup' THEN 'tunnel' ELSE 'surface' END AS mode,
      CASE event_type WHEN 'error' THEN ['elevated', 'surface'] WHEN 'signup' THEN ['tunnel']
        ELSE ['elevated', 'surface', 'tunnel'] END AS assets,
      CASE WHEN event_id % 5 = 0 THEN 100.0::DOUBLE END AS minimum_z, event_id % 50 = 0 AS stale
    FROM (SELECT event_id, event_type, ts, (user_id * 13 % 360) / 4.0::DOUBLE AS vx0, (event_id * 6 // 100) / 4.0::DOUBLE AS vy0 FROM events)""",
)
cte(
    "d_segments",
    """
    SELECT corridor_id, event_id, radius, least(vx0, vx1, vx2) AS cx0, greatest(vx0, vx1, vx2) AS cx1,
      least(vy0, vy1, vy2) AS cy0, greatest(vy0, vy1, vy2) AS cy1, vx0, vy0,
      unnest([vx0, vx1]) AS ax, unnest([vy0, vy1]) AS ay, unnest([vx1, vx2]) AS bx, unnest([vy1, vy2]) AS by
    FROM d_corridors""",
)
cte(
    "d_object_edges",
    """
    SELECT object_id AS shape_id, x0 AS sx0, y0 AS sy0, x0 + w AS sx1, y0 + h AS sy1,
      unnest(CASE WHEN is_box THEN [x0, x0 + w, x0 + w, x0] ELSE [x0, x0 + w, x0] END) AS px,
      unnest(CASE WHEN is_box THEN [y0, y0, y0 + h, y0 + h] ELSE [y0, y0, y0 + h] END) AS py,
      unnest(CASE WHEN is_box THEN [x0 + w, x0 + w, x0, x0] ELSE [x0 + w, x0, x0] END) AS qx,
      unnest(CASE WHEN is_box THEN [y0, y0 + h, y0 + h, y0] ELSE [y0, y0 + h, y0] END) AS qy
    FROM d_objects""",
)


def _cross(ax, ay, bx, by, px, py):
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def _near(px, py, x1, y1, x2, y2, reach):
    dot = f"(({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1}))"
    span = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    return (
        f"(CASE WHEN {dot} <= 0 THEN ({px}-{x1})*({px}-{x1}) + ({py}-{y1})*({py}-{y1}) <= {reach}*{reach} "
        f"WHEN {dot} >= {span} THEN ({px}-{x2})*({px}-{x2}) + ({py}-{y2})*({py}-{y2}) <= {reach}*{reach} "
        f"ELSE {_cross(x1, y1, x2, y2, px, py)}*{_cross(x1, y1, x2, y2, px, py)} <= {reach}*{reach}*{span} END)"
    )


def convex_hits(edge_table: str, control: str) -> str:
    """Corridor x convex counter-clockwise shape pairs within radius + control, brute force."""
    reach = f"(s.radius + {control})"
    a, b, p, q = ("s.ax", "s.ay"), ("s.bx", "s.by"), ("e.px", "e.py"), ("e.qx", "e.qy")
    return f"""
    SELECT s.corridor_id, s.event_id, e.shape_id FROM d_segments s JOIN {edge_table} e
      ON s.cx0 - {reach} <= e.sx1 AND e.sx0 <= s.cx1 + {reach} AND s.cy0 - {reach} <= e.sy1 AND e.sy0 <= s.cy1 + {reach}
    GROUP BY s.corridor_id, s.event_id, e.shape_id
    HAVING bool_or(
        ({_cross(*p, *q, *a)} * {_cross(*p, *q, *b)} < 0 AND {_cross(*a, *b, *p)} * {_cross(*a, *b, *q)} < 0)
        OR {_near(*a, *p, *q, reach)} OR {_near(*b, *p, *q, reach)}
        OR {_near(*p, *a, *b, reach)} OR {_near(*q, *a, *b, reach)})
      OR bool_and({_cross(*p, *q, 's.vx0', 's.vy0')} >= 0)"""


cte("d_hits", convex_hits("d_object_edges", "0.25::DOUBLE"))
cte(
    "d_protected_edges",
    """
    SELECT 'n' || n_nationkey AS shape_id, x AS sx0, y AS sy0, x + 3 AS sx1, y + 2 AS sy1,
      unnest([x, x + 3, x + 3, x]) AS px, unnest([y, y, y + 2, y + 2]) AS py,
      unnest([x + 3, x + 3, x, x]) AS qx, unnest([y, y + 2, y + 2, y]) AS qy
    FROM (SELECT n_nationkey, (n_nationkey * 17 % 96)::DOUBLE AS x,
            (n_nationkey * (SELECT high FROM d_plane) // 25)::DOUBLE AS y FROM nation)""",
)
cte("d_protection", convex_hits("d_protected_edges", "0"))
# Closed contact and common area of a box or lower-left right triangle with a zone box.
cte(
    "d_object_zones",
    """
    SELECT object_id, okey, zone_id, allow, w * h * (CASE WHEN is_box THEN 1 ELSE 0.5 END) AS own,
      CASE WHEN b <= a OR d <= c THEN 0 WHEN is_box THEN (b - a) * (d - c)
        ELSE (xd - a) * (d - c) + (h - c) * (xc - xd) - h / (2 * w) * (xc * xc - xd * xd) END AS common
    FROM (SELECT *, least(greatest(w * (1 - d / h), a), b) AS xd, least(greatest(w * (1 - c / h), a), b) AS xc
      FROM (SELECT o.*, z.zone_id, z.allow, greatest(zx0 - x0, 0) AS a, least(zx1 - x0, w) AS b,
              greatest(zy0 - y0, 0) AS c, least(zy1 - y0, h) AS d
            FROM d_objects o JOIN d_zones z ON o.object_ok AND z.zone_ok AND x0 <= zx1 AND zx0 <= x0 + w AND y0 <= zy1 AND zy0 <= y0 + h
              AND (is_box OR greatest(zx0 - x0, 0) * h + greatest(zy0 - y0, 0) * w <= w * h)))""",
)
cte(
    "d_resolution",
    """
    SELECT o.object_id, o.okey, o.ground, o.foundation, count(z.zone_id) AS zone_count, min(z.zone_id) AS first_zone,
      max(z.zone_id) AS last_zone, coalesce(bool_and(z.allow), false) AS allow_demolition,
      coalesce(sum(z.common), 0) AS zone_area, any_value(o.w * o.h * (CASE WHEN o.is_box THEN 1 ELSE 0.5 END)) AS own_area
    FROM d_objects o LEFT JOIN d_object_zones z ON z.object_id = o.object_id GROUP BY ALL""",
)
cte(
    "d_roles",
    """
    SELECT *, CASE WHEN NOT (zone_count > 0 AND zone_area >= own_area * (1 - 1e-9)) THEN 'unresolved'
        WHEN allow_demolition THEN 'demolition' ELSE 'mandatory' END AS role,
      CASE WHEN foundation IS NOT NULL THEN least(ground - 3, foundation - 2) - 2 END AS ceiling_z
    FROM d_resolution""",
)
cte(
    "d_rollup",
    """
    SELECT h.corridor_id, h.event_id, count(*) FILTER (WHERE role <> 'demolition') AS n_mandatory,
      count(*) FILTER (WHERE role = 'demolition') AS n_demolition, count(*) FILTER (WHERE role = 'unresolved') AS n_unresolved,
      count(*) FILTER (WHERE role <> 'demolition' AND ceiling_z IS NULL) AS n_level_unknown,
      min(ceiling_z) FILTER (WHERE role <> 'demolition') AS lowest_ceiling,
      min(object_id) FILTER (WHERE role <> 'demolition') AS first_mandatory,
      max(object_id) FILTER (WHERE role <> 'demolition') AS last_mandatory
    FROM d_hits h JOIN d_roles r ON r.object_id = h.shape_id GROUP BY ALL""",
)

oracle(
    "sp1_spatial_bins",
    """SELECT object_id, zone_id FROM d_objects, d_zones
       WHERE x0 <= zx1 AND zx0 <= x0 + w AND y0 <= zy1 AND zy0 <= y0 + h""",
)
oracle("sp2_intersects", "SELECT object_id, zone_id FROM d_object_zones")
oracle("sp3_within_distance", "SELECT corridor_id, shape_id AS object_id FROM d_hits")
cte(
    "d_points",
    """SELECT 'p' || event_id AS feature_id, (user_id * 13 % 400) / 4.0::DOUBLE AS x,
         (event_id * 6 // 100) / 4.0::DOUBLE AS y FROM events""",
)
oracle(
    "sp4_point_in_polygon",
    """SELECT feature_id, zone_id FROM d_points JOIN d_zones ON x >= zx0 AND x < zx1 AND y >= zy0 AND y < zy1""",
)
oracle(
    "sp5_zone_overlap_check",
    """WITH grown AS (SELECT zone_id, zx0 - g AS ax, zy0 - g AS ay, zx1 + g AS bx, zy1 + g AS by
         FROM (SELECT *, CASE WHEN zkey % 3 = 0 THEN 0.5 ELSE 0 END AS g FROM d_zones))
       SELECT l.zone_id AS a_zone, r.zone_id AS b_zone,
         (least(l.bx, r.bx) - greatest(l.ax, r.ax)) * (least(l.by, r.by) - greatest(l.ay, r.ay)) AS common_area,
         'OVERLAPPING_ZONES' AS code
       FROM grown l JOIN grown r ON l.zone_id < r.zone_id AND l.ax < r.bx AND r.ax < l.bx AND l.ay < r.by AND r.ay < l.by""",
)
oracle(
    "sp6_intersection_area",
    "SELECT object_id, zone_id, round(common, 6) AS common_area FROM d_object_zones WHERE common > 0",
)
oracle(
    "jn6_zone_association",
    """SELECT feature_id, count(zone_id) AS zone_count, min(zone_id) AS first_zone, max(zone_id) AS last_zone,
         coalesce(bool_and(allow), false) AS allow_demolition,
         CASE WHEN count(zone_id) > 0 THEN 'matched' ELSE 'pending' END AS association,
         CASE WHEN bool_or(lifted) THEN 'INVALID_GEOMETRY' END AS code
       FROM (SELECT feature_id, zone_id, allow, false AS lifted FROM d_points LEFT JOIN d_zones ON zone_ok AND x BETWEEN zx0 AND zx1 AND y BETWEEN zy0 AND zy1
             UNION ALL SELECT o.object_id, CASE WHEN o.okey % 11 <> 4 THEN zone_id END, CASE WHEN o.okey % 11 <> 4 THEN allow END, o.okey % 11 = 4 OR NOT o.object_ok
             FROM d_objects o LEFT JOIN d_object_zones z USING (object_id))
       GROUP BY feature_id""",
)
oracle(
    "jn6_zone_association_pairs",
    """SELECT feature_id, zone_id FROM d_points JOIN d_zones ON zone_ok AND x BETWEEN zx0 AND zx1 AND y BETWEEN zy0 AND zy1
       UNION ALL SELECT object_id, zone_id FROM d_object_zones z WHERE z.okey % 11 <> 4""",
)
oracle(
    "ag9_permission_rollup",
    """SELECT object_id, zone_count, first_zone, last_zone, allow_demolition,
         CASE WHEN zone_count > 0 THEN 'matched' ELSE 'pending' END AS association FROM d_resolution""",
)
oracle("jn7_corridor_object_conflicts", "SELECT corridor_id, shape_id AS object_id FROM d_hits")
oracle("jn8_protection_conflicts", "SELECT corridor_id, shape_id AS area_id FROM d_protection")
oracle(
    "jn9_zone_cover",
    """SELECT object_id, round(own_area, 6) AS own_area, round(zone_area, 6) AS zone_area,
         zone_count > 0 AND zone_area >= own_area * (1 - 1e-9) AS resolved FROM d_resolution""",
)
oracle(
    "ag8_conflict_rollup",
    """SELECT corridor_id, n_mandatory, n_demolition, n_unresolved, n_level_unknown, lowest_ceiling,
         first_mandatory, last_mandatory FROM d_rollup WHERE event_id % 50 <> 0""",
)
oracle(
    "ag8_conflict_items",
    """SELECT h.corridor_id, r.object_id, r.role, r.ceiling_z
       FROM d_hits h JOIN d_roles r ON r.object_id = h.shape_id WHERE h.event_id % 50 <> 0""",
)
cte(
    "d_facts",
    """
    SELECT c.corridor_id, c.event_id, c.mode, c.assets, c.minimum_z, c.stale, p.corridor_id IS NOT NULL AS barred,
      coalesce(n_mandatory, 0) AS nm, coalesce(n_demolition, 0) AS nd, coalesce(n_unresolved, 0) AS nu,
      coalesce(n_level_unknown, 0) AS nl, lowest_ceiling AS low
    FROM d_corridors c LEFT JOIN (SELECT DISTINCT corridor_id FROM d_protection) p USING (corridor_id)
      LEFT JOIN d_rollup r ON r.corridor_id = c.corridor_id""",
)


def verdict(source: str, foreign: str = "false", complete: str = "true") -> str:
    """The policy cases spelled as one row of (status | reason | modes) per case."""
    return f"""
    SELECT *, split_part(verdict, '|', 1) AS status, split_part(verdict, '|', 2) AS reason,
      CASE split_part(verdict, '|', 3) WHEN 't' THEN 'tunnel' WHEN 'a' THEN array_to_string(assets, ',') ELSE '' END AS permitted_modes
    FROM (SELECT *, CASE
        WHEN stale THEN 'stale_input|INPUT_REVISION_CHANGED|'
        WHEN {foreign} THEN 'error|COORDINATE_SPACE_MISMATCH|'
        WHEN barred THEN 'no_feasible_solution|HARD_PROTECTION_CONFLICT|'
        WHEN nm > 0 AND NOT list_contains(assets, 'tunnel') THEN 'no_feasible_solution|TUNNEL_ASSET_UNSUPPORTED|'
        WHEN NOT {complete} OR nu > 0 THEN 'data_insufficient|EXISTING_COVERAGE_OR_ZONES_UNKNOWN|' || CASE WHEN nm > 0 THEN 't' ELSE 'a' END
        WHEN nm = 0 AND NOT list_contains(assets, mode) THEN 'no_feasible_solution|REQUESTED_MODE_UNSUPPORTED|'
        WHEN nm = 0 THEN 'policy_clear|NO_NON_DEMOLISHABLE_CONFLICT|a'
        WHEN nl > 0 THEN 'data_insufficient|UNDERGROUND_ENVELOPE_MISSING|t'
        WHEN low < minimum_z THEN 'no_feasible_solution|UNDERGROUND_DEPTH_RANGE_EMPTY|'
        ELSE 'tunnel_required|LOWER_ONLY_NO_OVERPASS|t' END AS verdict FROM {source})"""


cte("d_verdicts", verdict("d_facts"))
VERDICT_OUT = """SELECT corridor_id, 'r1' AS input_revision, status, reason, permitted_modes,
      CASE WHEN stale OR barred THEN 0 ELSE nm END AS n_mandatory, CASE WHEN stale OR barred THEN 0 ELSE nd END AS n_demolition,
      CASE WHEN stale OR barred THEN 0 ELSE nu END AS n_unresolved,
      CASE WHEN reason IN ('UNDERGROUND_DEPTH_RANGE_EMPTY', 'LOWER_ONLY_NO_OVERPASS') THEN low END AS lowest_ceiling,
      NOT stale AND NOT barred AND nm > 0 AS lower_only"""
oracle("d1_decide_conflicts", f"{VERDICT_OUT} FROM d_verdicts")
cte("d_partial", verdict("d_facts", complete="(event_id < 0)"))
oracle("d1_incomplete_data", f"{VERDICT_OUT} FROM d_partial")
oracle(
    "d2_tunnel_ceilings",
    """SELECT object_id, ceiling_z, ceiling_z < 100 AS below_100
       FROM d_roles WHERE role <> 'demolition'""",
)
oracle(
    "d4_staleness_gate",
    """SELECT CASE WHEN stale THEN 'stale_input' ELSE 'admitted' END AS answer, count(*) AS corridors
       FROM d_corridors GROUP BY 1""",
)
oracle(
    "d5_space_gate",
    """SELECT corridor_id, CASE WHEN stale THEN 'INPUT_REVISION_CHANGED' WHEN event_id % 9 = 4 THEN 'COORDINATE_SPACE_MISMATCH' END AS entry_code
       FROM d_corridors""",
)

# --- boundaries -----------------------------------------------------------------------

cte(
    "d_boundary",
    """
    SELECT *, 'boundary:' || substr(sha256('roads' || chr(0) || 'r1'), 1, 16) || ':' || okey AS boundary_id,
      CASE okey % 3 WHEN 0 THEN 'INVALID_GEOMETRY' WHEN 1 THEN 'VALID_PLANAR_SOURCE' ELSE 'Z_GEOMETRY_UNVERIFIED' END AS quality
    FROM d_objects""",
)
cte(
    "d_guard_edges",
    """
    SELECT okey AS shape_id, x0 AS sx0, y0 AS sy0, x0 + w AS sx1, y0 + h AS sy1,
      unnest([x0, x0 + w, x0 + w, x0]) AS px, unnest([y0, y0, y0 + h, y0 + h]) AS py,
      unnest([x0 + w, x0 + w, x0, x0]) AS qx, unnest([y0, y0 + h, y0 + h, y0]) AS qy
    FROM d_boundary""",
)
cte("d_guard_hits", convex_hits("d_guard_edges", "0.25::DOUBLE"))
cte(
    "d_guard_roles",
    """
    SELECT b.okey, CASE WHEN count(z.zone_id) = 0 OR coalesce(sum(greatest(0, least(zx1, x0 + w) - greatest(zx0, x0)) * greatest(0, least(zy1, y0 + h) - greatest(zy0, y0))), 0)
          < any_value(w * h) * (1 - 1e-9) THEN 'unresolved' WHEN bool_and(z.allow) THEN 'demolition' ELSE 'mandatory' END AS role
    FROM d_boundary b LEFT JOIN d_zones z ON z.zone_ok AND x0 <= zx1 AND zx0 <= x0 + w AND y0 <= zy1 AND zy0 <= y0 + h GROUP BY b.okey""",
)
cte(
    "d_guard_rollup",
    """
    SELECT corridor_id, count(*) FILTER (WHERE role <> 'demolition') AS bm, count(*) FILTER (WHERE role = 'demolition') AS bd,
      count(*) FILTER (WHERE role = 'unresolved') AS bu, count(*) FILTER (WHERE quality <> 'VALID_PLANAR_SOURCE') AS dg,
      count(*) FILTER (WHERE quality <> 'VALID_PLANAR_SOURCE' AND role <> 'demolition') AS twice,
      count(*) FILTER (WHERE quality <> 'VALID_PLANAR_SOURCE' AND role = 'demolition') AS kept
    FROM d_guard_hits h JOIN d_guard_roles r ON r.okey = h.shape_id JOIN d_boundary b ON b.okey = h.shape_id GROUP BY corridor_id""",
)
cte(
    "d_covered",
    """
    SELECT corridor_id, least(vx0, vx1, vx2) - radius >= 0 AND greatest(vx0, vx1, vx2) + radius <= 80
      AND least(vy0, vy1, vy2) - radius >= 0 AND greatest(vy0, vy1, vy2) + radius <= (SELECT high FROM d_plane) AS covered
    FROM d_corridors""",
)
oracle(
    "jn10_boundary_affected",
    """SELECT corridor_id, 'b' AS kind, shape_id::VARCHAR AS source_record_id, quality
       FROM d_guard_hits h JOIN d_boundary b ON b.okey = h.shape_id
       UNION ALL SELECT NULL, 'u', '1', 'lost'""",
)
oracle(
    "jn11_coverage_covers_envelope",
    "SELECT corridor_id, covered FROM d_covered",
)
oracle(
    "jn14_boundary_object_merge",
    """SELECT object_id, round(w * h * CASE WHEN is_box THEN 1 ELSE 0.5 END, 6) AS area, foundation IS NOT NULL AS levels_known, NULL::VARCHAR AS code FROM d_objects
       UNION ALL SELECT boundary_id, round(w * h, 6), false, CASE WHEN okey % 15 = 0 THEN 'SOURCE_OBJECT_COLLISION' END FROM d_boundary
       UNION ALL SELECT boundary_id, round(w * h, 6), true, NULL FROM d_boundary WHERE okey % 15 = 0""",
)
cte("d_layers", "SELECT 'roads' AS layer UNION ALL SELECT 'lost'")
cte(
    "d_quality_facts",
    """
    SELECT f.* REPLACE (f.stale OR f.event_id % 40 = 1 AS stale, nm + CASE WHEN layer = 'roads' THEN coalesce(bm, 0) ELSE 0 END AS nm,
        nd + CASE WHEN layer = 'roads' THEN coalesce(bd, 0) ELSE 0 END AS nd, nu + CASE WHEN layer = 'roads' THEN coalesce(bu, 0) ELSE 0 END AS nu,
        nl + CASE WHEN layer = 'roads' THEN coalesce(bm, 0) ELSE 0 END AS nl),
      layer, covered, CASE WHEN layer = 'roads' THEN coalesce(dg, 0) ELSE 1 END AS dg, CASE WHEN layer = 'roads' THEN coalesce(twice, 0) ELSE 0 END AS twice,
      CASE WHEN layer = 'roads' THEN coalesce(kept, 0) ELSE 0 END AS kept
    FROM d_facts f CROSS JOIN d_layers JOIN d_covered c ON c.corridor_id = f.corridor_id
      LEFT JOIN d_guard_rollup g ON g.corridor_id = f.corridor_id""",
)
cte("d_quality_verdicts", verdict("d_quality_facts"))
oracle(
    "d3_decide_with_boundary_quality",
    """SELECT corridor_id, layer, 'r1' AS input_revision,
         CASE step WHEN 'cover' THEN 'data_insufficient' WHEN 'lost' THEN 'data_insufficient' WHEN 'review' THEN 'data_insufficient' WHEN 'no' THEN 'no_feasible_solution' ELSE status END AS status,
         CASE step WHEN 'stale' THEN 'BOUNDARY_OR_INPUT_REVISION_CHANGED' WHEN 'cover' THEN 'BOUNDARY_COVERAGE_UNKNOWN' WHEN 'lost' THEN 'UNLOCATABLE_BOUNDARY_RETAINED'
           WHEN 'review' THEN 'DEGRADED_BOUNDARY_REVIEW_REQUIRED' WHEN 'no' THEN 'TUNNEL_ASSET_UNSUPPORTED' ELSE reason END AS reason,
         CASE WHEN step IN ('cover', 'lost', 'no') THEN '' WHEN step = 'review' THEN 'tunnel' ELSE permitted_modes END AS permitted_modes,
         CASE WHEN step = 'stale' THEN 0 WHEN barred THEN dg WHEN step = 'base' THEN nm ELSE nm + dg - twice END AS n_mandatory,
         CASE WHEN step = 'stale' OR barred THEN 0 WHEN step = 'base' THEN nd ELSE nd - kept END AS n_demolition,
         CASE WHEN step = 'stale' OR barred THEN 0 ELSE nu END AS n_unresolved,
         CASE WHEN step IN ('infeasible', 'base', 'cover', 'lost') AND reason IN ('UNDERGROUND_DEPTH_RANGE_EMPTY', 'LOWER_ONLY_NO_OVERPASS') THEN low END AS lowest_ceiling,
         step <> 'stale' AND (step IN ('review', 'no') OR (NOT barred AND nm > 0)) AS lower_only
       FROM (SELECT *, CASE WHEN stale THEN 'stale' WHEN status = 'no_feasible_solution' THEN 'infeasible' WHEN NOT covered THEN 'cover'
           WHEN layer = 'lost' THEN 'lost' WHEN dg > 0 AND list_contains(assets, 'tunnel') THEN 'review' WHEN dg > 0 THEN 'no' ELSE 'base' END AS step
         FROM d_quality_verdicts)""",
)
