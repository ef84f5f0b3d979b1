"""SQL twins of the registered queries, written independently for DuckDB."""

from __future__ import annotations

import re

# Derived tables, see FIXTURES.md. Each may use the ones named in braces.
CTES: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needs(sql: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b{name}\b", sql)]


def with_tables(sql: str) -> str:
    """Prefix a statement with the derived tables it mentions, in definition order."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += _needs(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in wanted]
    if not parts:
        return sql
    body = re.sub(r"^\s*WITH\s+", ",\n", sql) if re.match(r"\s*WITH\s", sql) else "\n" + sql
    return "WITH RECURSIVE " + ",\n".join(parts) + body


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = with_tables(sql)


# --- grids ------------------------------------------------------------------------

cte("d_plane", "SELECT count(*) // 100 AS high FROM orders")
cte(
    "d_terrain",
    """
    SELECT o_orderkey // 5000 AS package_id, 'terrain-' || (o_orderkey // 5000) AS grid_id,
      CAST(o_orderkey // 100 % 50 AS INT) AS "row", CAST(o_orderkey % 100 AS INT) AS col,
      CAST(CASE WHEN o_orderkey % 97 = 13 THEN -9999 WHEN o_orderkey % 101 = 7 THEN 'nan'::DOUBLE
           ELSE floor(o_totalprice / 1000) / 4 END AS FLOAT) AS value,
      CASE WHEN o_orderkey % 103 = 5 THEN 0 ELSE 255 END AS mask
    FROM orders""",
)
cte(
    "d_depth",
    """
    SELECT c_custkey // 1250 AS package_id, 'depth-' || (c_custkey // 1250) AS grid_id,
      CAST(c_custkey // 50 % 25 AS INT) AS "row", CAST(c_custkey % 50 AS INT) AS col,
      CAST(CASE WHEN c_custkey % 7 = 3 THEN -9999 WHEN c_custkey % 11 = 4 THEN 0
           ELSE floor(c_acctbal / 100) / 8 END AS FLOAT) AS value, 255 AS mask
    FROM customer""",
)
cte("d_cells", "SELECT * FROM d_terrain UNION ALL SELECT * FROM d_depth")
cte(
    "d_grids",
    """
    SELECT package_id, 'terrain' AS role, grid_id, 100 AS width, CAST(max("row") + 1 AS INT) AS height,
      1.0::DOUBLE AS cell, (SELECT high FROM d_plane) - package_id * 50.0::DOUBLE AS top
    FROM d_terrain GROUP BY package_id, grid_id
    UNION ALL
    SELECT package_id, 'depth', grid_id, 50, CAST(max("row") + 1 AS INT), 2.0::DOUBLE,
      (SELECT high FROM d_plane) - package_id * 50.0::DOUBLE
    FROM d_depth GROUP BY package_id, grid_id""",
)
# Validity restated: unmasked, a number, not infinite, not the NoData marker.
OK = "(mask > 0 AND NOT isnan(value) AND NOT isinf(value) AND value <> -9999)"
cte(
    "d_aligned",
    f"""
    SELECT t.package_id, t.grid_id, t."row", t.col, {OK.replace('mask', 't.mask').replace('value', 't.value')} AS terrain_valid,
      g.grid_id IS NOT NULL AND t."row" // 2 < g.height AS covered, d.value AS depth
    FROM d_terrain t
    LEFT JOIN (SELECT * FROM d_grids WHERE role = 'depth') g ON g.package_id = t.package_id
    LEFT JOIN d_depth d ON d.package_id = t.package_id AND d."row" = t."row" // 2 AND d.col = t.col // 2""",
)
cte(
    "d_classes",
    """
    SELECT *, CASE WHEN NOT covered THEN 0
        WHEN depth = -9999 THEN (CASE WHEN package_id % 2 = 0 THEN 1 ELSE 0 END)
        WHEN depth > 0 THEN 2 WHEN depth = 0 THEN 3 ELSE 0 END AS class
    FROM d_aligned""",
)

oracle(
    "src1_cells_scan",
    """SELECT package_id, grid_id, "row", col, value, mask, 0 AS tile_row, col // 256 AS tile_col
       FROM d_cells WHERE NOT (package_id % 3 = 2 AND grid_id LIKE 'terrain%')""",
)
oracle(
    "fn1_nodata_pixels",
    """SELECT package_id, grid_id, "row", col, value = -9999 AS as_float,
         CASE WHEN isnan(value) THEN false ELSE value = -9999 END AS as_int16,
         false AS as_uint8, isnan(value) AS as_nan_marker
       FROM d_cells""",
)
oracle(
    "fn2_valid_pixels",
    f'SELECT package_id, grid_id, "row", col, {OK} AS is_valid FROM d_cells',
)
oracle(
    "fn3_classify_depth",
    """SELECT package_id, "row", col,
         CASE WHEN value = -9999 THEN (CASE WHEN package_id % 2 = 0 THEN 'land' ELSE 'unknown' END)
           WHEN abs(value) <= 1 THEN 'uncertain' WHEN value > 1 THEN 'water' ELSE 'unknown' END AS class
       FROM d_depth""",
)
oracle(
    "fn4_pixel_area",
    """SELECT s_suppkey AS grid_key, CASE WHEN abs(a * e - b * d) > 0 THEN abs(a * e - b * d) END AS pixel_area_m2
       FROM (SELECT s_suppkey, (s_suppkey % 4)::DOUBLE AS a, (s_suppkey % 3) / 2.0 AS b,
               (s_suppkey % 2)::DOUBLE AS d, -((s_suppkey % 5) / 4.0) AS e FROM supplier)""",
)
oracle(
    "fn5_grid_footprint",
    """SELECT grid_id, unnest([0, 1, 2, 3]) AS corner,
         unnest([0.0, width * cell, width * cell, 0.0])::DOUBLE AS x,
         unnest([top, top, top - height * cell, top - height * cell])::DOUBLE AS y FROM d_grids""",
)
oracle(
    "fn6_grid_metadata",
    """SELECT package_id, grid_id, width, height, 'EPSG:32631' AS crs, 'float32' AS dtype,
         -9999.0::DOUBLE AS nodata, 'm' AS band_unit, 0.0::DOUBLE AS left_x, top - height * cell AS bottom_y,
         width * cell AS right_x, top AS top_y, cell * cell AS pixel_area_m2,
         'unknown' AS vertical_datum, NULL::VARCHAR AS code FROM d_grids""",
)
oracle(
    "fn7_tile_assign",
    """SELECT package_id, grid_id, r.tile_row, c.tile_col,
         least(32, width - c.tile_col * 32) AS tile_width, least(32, height - r.tile_row * 32) AS tile_height
       FROM d_grids, (SELECT unnest(range(0, 2))::INT AS tile_row) r, (SELECT unnest(range(0, 4))::INT AS tile_col) c
       WHERE r.tile_row * 32 < height AND c.tile_col * 32 < width""",
)
oracle(
    "fn9_vertical_scale",
    """SELECT c_custkey, round(v * f, 6) AS metres, CASE WHEN f IS NULL THEN 'MISSING_VERTICAL_UNIT' END AS code
       FROM (SELECT c_custkey, floor(c_acctbal / 100) / 8 AS v,
               CASE c_custkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.3048::DOUBLE
                 WHEN 2 THEN 1200.0::DOUBLE / 3937 END AS f FROM customer)""",
)
oracle(
    "ag1_raster_profile",
    f"""SELECT package_id, grid_id, count(*) FILTER (WHERE {OK}) AS valid_pixels,
          count(*) FILTER (WHERE NOT isnan(value) AND NOT isinf(value)) AS finite_pixels,
          count(*) FILTER (WHERE {OK} AND value = 0) AS valid_zero_pixels,
          count(*) FILTER (WHERE {OK} AND value < 0) AS valid_negative_pixels,
          min(value) FILTER (WHERE {OK})::DOUBLE AS valid_min, max(value) FILTER (WHERE {OK})::DOUBLE AS valid_max
        FROM d_cells GROUP BY ALL""",
)
oracle(
    "jn1_align_nearest",
    """SELECT package_id, "row", col, covered, depth, terrain_valid FROM d_aligned""",
)
ACCOUNT = """SELECT package_id, count(*) FILTER (WHERE class = 2) AS water,
      count(*) FILTER (WHERE class = 1) AS land, count(*) FILTER (WHERE class IN (0, 3)) AS unknown,
      count(*) FILTER (WHERE class = 3) AS near_zero_uncertain,
      count(*) FILTER (WHERE NOT terrain_valid) AS terrain_missing,
      count(*) FILTER (WHERE NOT covered) AS depth_outside, count(*) AS expected_cells"""
oracle(
    "ag2_class_accounting",
    f"""SELECT *, water::DOUBLE AS water_m2, land::DOUBLE AS land_m2, unknown::DOUBLE AS unknown_m2,
          expected_cells::DOUBLE AS roi_m2, NULL::VARCHAR AS conservation_code,
          unknown = 0 AND terrain_missing = 0 AS complete
        FROM ({ACCOUNT} FROM d_classes GROUP BY package_id)""",
)
oracle(
    "ag3_area_conservation",
    """SELECT package_id, count(*) AS classified_cells,
         (SELECT sum(width * height)::BIGINT FROM d_grids g WHERE g.role = 'terrain' AND g.package_id = c.package_id) AS expected_cells,
         CASE WHEN package_id % 4 = 1 THEN 'AREA_CONSERVATION' END AS conservation_code
       FROM d_classes c WHERE NOT (package_id % 4 = 1 AND "row" = 0 AND col < 7) GROUP BY package_id""",
)
cte(
    "d_bilinear",
    f"""
    SELECT t.package_id, t."row", t.col, sum(w * s.value) AS ws, sum(w) AS sw FROM (
      SELECT package_id, "row", col, dr.v AS dr, dc.v AS dc, "row" + dr.v AS srow, col + dc.v AS scol,
        (CASE dr.v WHEN 0 THEN 0.75 ELSE 0.25 END) * (CASE dc.v WHEN 0 THEN 0.75 ELSE 0.25 END) AS w
      FROM d_terrain, (VALUES (0), (1)) dr(v), (VALUES (0), (1)) dc(v)) t
    JOIN d_terrain s ON s.package_id = t.package_id AND s."row" = t.srow AND s.col = t.scol
    WHERE {OK.replace('mask', 's.mask').replace('value', 's.value')} GROUP BY ALL""",
)
oracle(
    "jn2_resample_bilinear",
    """SELECT package_id, "row", col, round(ws / sw, 6) AS value FROM d_bilinear""",
)
cte(
    "d_heights",
    f'SELECT package_id, "row", col, CASE WHEN {OK} THEN value::DOUBLE END AS z FROM d_terrain',
)
oracle(
    "w1_terrain_gradient",
    """WITH z AS (SELECT * FROM d_heights), g AS (SELECT z.package_id, z."row", z.col, z.z, l.z AS lz, r.z AS rz, u.z AS uz, d.z AS dz,
          l.col IS NULL AS no_l, r.col IS NULL AS no_r, u.col IS NULL AS no_u, d.col IS NULL AS no_d
          FROM z LEFT JOIN z l ON l.package_id = z.package_id AND l."row" = z."row" AND l.col = z.col - 1
          LEFT JOIN z r ON r.package_id = z.package_id AND r."row" = z."row" AND r.col = z.col + 1
          LEFT JOIN z u ON u.package_id = z.package_id AND u."row" = z."row" - 1 AND u.col = z.col
          LEFT JOIN z d ON d.package_id = z.package_id AND d."row" = z."row" + 1 AND d.col = z.col),
        s AS (SELECT package_id, "row", col,
          CASE WHEN no_l THEN rz - z WHEN no_r THEN z - lz ELSE (rz - lz) / 2 END AS dz_dx,
          CASE WHEN no_u THEN dz - z WHEN no_d THEN z - uz ELSE (dz - uz) / 2 END AS dz_dy FROM g)
        SELECT package_id, "row", col, dz_dx, dz_dy, round(sqrt(dz_dx * dz_dx + dz_dy * dz_dy), 6) AS slope FROM s""",
)
oracle(
    "w2_row_run_rectangles",
    """SELECT package_id, "row", min(col) AS col_start, max(col) AS col_end,
         min(col) * 2.0::DOUBLE AS xmin, max(col) * 2.0::DOUBLE + 2 AS xmax,
         (SELECT high FROM d_plane) - package_id * 50.0::DOUBLE - "row" * 2 - 2 AS ymin,
         (SELECT high FROM d_plane) - package_id * 50.0::DOUBLE - "row" * 2 AS ymax
       FROM (SELECT *, count(*) FILTER (WHERE value <= 0) OVER (PARTITION BY package_id, "row" ORDER BY col) AS island
             FROM d_depth) WHERE value > 0 GROUP BY package_id, "row", island""",
)
