"""Planning tables derived from the star-schema test tables (see FIXTURES.md).

The whole plane is 100 m wide and count(orders)/100 m high. It is cut into
packages of 50 m strips, so that grid work always runs over many packages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.functions.geometry import bbox_of, box_geom, line_geom, point_geom, raised, ring_geom
from platwork.model import GEOMETRY, LAND_USES

STRIP = 50
NODATA = -9999.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key before they grow into shapes: a file of a few MB holds a million of them.

    The number of parts is given, or so few MB are put together again, and the rows are spelled out
    afterwards, or filters on shapes are worked out where the file is read.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"'{c}', {c}" for c in rows.columns)
    return rows.repartition(parts, key).selectExpr(f"inline(array(named_struct({fields})))")


def city(key: str) -> str:
    """Package of a plane row, read off the row so that joins keep it as a real key."""
    return f"if({key} IS NULL, 'nowhere', 'city') AS package_id"


def plane_height(spark: SparkSession, folder: str) -> int:
    """Metres; answered from Parquet footers."""
    return table(spark, folder, "orders").count() // 100


def _strip_grids(rows: DataFrame, strip: int) -> DataFrame:
    return rows.groupBy((F.col("r") / strip).cast("long").alias("package_id")).agg(
        (F.max("r") % strip + 1).cast("int").alias("height")
    )


def grids(spark: SparkSession, folder: str) -> DataFrame:
    """One terrain grid per package, one depth grid where depth cells exist."""
    high = plane_height(spark, folder)
    terrain = _strip_grids(
        table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("r")), STRIP
    )
    depth = _strip_grids(
        table(spark, folder, "customer").select(F.floor(F.col("c_custkey") / 50).alias("r")),
        STRIP // 2,
    )

    def described(df: DataFrame, role: str, width: int, cell: float) -> DataFrame:
        return df.select(
            "package_id",
            F.lit(role).alias("role"),
            F.concat(F.lit(role + "-"), F.col("package_id")).alias("grid_id"),
            F.lit(width).alias("width"),
            "height",
            F.lit(cell).alias("a"),
            F.lit(0.0).alias("b"),
            F.lit(0.0).alias("c"),
            F.lit(0.0).alias("d"),
            F.lit(-cell).alias("e"),
            (F.lit(float(high)) - F.col("package_id") * float(STRIP)).alias("f"),
            F.lit("EPSG:32631").alias("crs"),
            F.lit(NODATA).alias("nodata"),
            F.lit("float32").alias("dtype"),
            F.lit("m").alias("band_unit"),
            F.lit(1).alias("band_count"),
        )

    return described(terrain, "terrain", 100, 1.0).unionByName(described(depth, "depth", 50, 2.0))


def terrain_cells(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    row = F.floor(key / 100)
    package = F.floor(row / STRIP)
    return table(spark, folder, "orders").select(
        package.alias("package_id"),
        F.concat(F.lit("terrain-"), package).alias("grid_id"),
        (row % STRIP).cast("int").alias("row"),
        (key % 100).cast("int").alias("col"),
        F.when(key % 97 == 13, F.lit(NODATA))
        .when(key % 101 == 7, F.lit(float("nan")))
        .otherwise(F.floor(F.col("o_totalprice") / 1000) / 4)
        .cast("float")
        .alias("value"),
        F.when(key % 103 == 5, 0).otherwise(255).alias("mask"),
    )


def depth_cells(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    row = F.floor(key / 50)
    package = F.floor(row / (STRIP // 2))
    return table(spark, folder, "customer").select(
        package.alias("package_id"),
        F.concat(F.lit("depth-"), package).alias("grid_id"),
        (row % (STRIP // 2)).cast("int").alias("row"),
        (key % 50).cast("int").alias("col"),
        F.when(key % 7 == 3, F.lit(NODATA))
        .when(key % 11 == 4, F.lit(0.0))
        .otherwise(F.floor(F.col("c_acctbal") / 100) / 8)
        .cast("float")
        .alias("value"),
        F.lit(255).alias("mask"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return terrain_cells(spark, folder).unionByName(depth_cells(spark, folder))


def semantics(grid_table: DataFrame) -> DataFrame:
    """Declared depth rules: every second package asserts that NoData is land."""
    return grid_table.filter("role = 'terrain'").select(
        "package_id",
        (F.col("package_id") % 2 == 0).alias("nodata_is_land"),
        (F.col("package_id") % 2 == 0).alias("complete_coverage_confirmed"),
        F.lit(0.0).alias("near_zero_m"),
    )


# --- vector tables ------------------------------------------------------------

_USES = "array(" + ", ".join(f"'{u}'" for u in LAND_USES) + ")"


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zones with gaps between them, for what has to cope with ground outside every zone."""
    return all_zones(spark, folder).filter("bigint(substring(zone_id, 2)) % 13 != 5")


def surveyed_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The same zones with their planar validity; every thirteenth has a spike and is invalid."""
    box = "_b.xmin AS x, _b.ymin AS y, _b.xmax - _b.xmin AS w, _b.ymax - _b.ymin AS h"
    spoiled = "bigint(substring(zone_id, 2)) % 13 = 7"
    rows = zones(spark, folder)
    return (
        rows.selectExpr("*", f"{bbox_of('geom')} AS _b").selectExpr("*", *box.split(", "))
        .withColumns({"geom": F.expr(f"if({spoiled}, {SPIKED}, geom)"), "is_valid": F.expr(f"NOT ({spoiled})")})
        .select(*rows.columns, "is_valid")
    )


def all_zones(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return (
        dealt(suppliers, "s_suppkey")
        .selectExpr(
            "s_suppkey AS key",
            "s_suppkey % 10 * 10D AS x",
            "s_suppkey div 10 * 15D AS y",
            f"{_USES}[s_nationkey % 9] AS land_use",
        )
        .selectExpr(
            city("key"),
            "concat('z', key) AS zone_id",
            f"{box_geom('x', 'y', 'x + 10', 'y + 15')} AS geom",
            "land_use",
            "(key % 5 + 1) * 20D AS block_w",
            "(key % 4 + 1) * 30D AS block_h",
            "key % 3 != 0 AS allow_demolition",
            "CASE WHEN land_use IN ('residential', 'residential_commercial') AND key % 4 = 1 "
            "THEN map('trip_rate', key / 8D) END AS overrides",
        )
    )


def _footprints(spark: SparkSession, folder: str) -> DataFrame:
    """Part rows with the frame of their footprint: x, y, w, h."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return dealt(parts, "p_partkey").selectExpr(
        city("p_partkey"),
        "p_partkey AS key",
        "p_size",
        "floor(p_retailprice) / 8D AS ground_z",
        "(p_partkey * 37 % 400) / 4D AS x",
        "(p_partkey * 3 div 10) / 4D AS y",
        "(p_size % 8 + 1) / 4D AS w",
        "(p_partkey % 5 + 1) / 4D AS h",
    )


PLAIN = box_geom("x", "y", "x + w", "y + h")
TRIANGLE = ring_geom([("x", "y"), ("x + w", "y"), ("x", "y + h"), ("x", "y")])
BOWTIE = ring_geom([("x", "y"), ("x + w", "y + h"), ("x + w", "y"), ("x", "y + h"), ("x", "y")])
#: A box whose ring runs to its middle and back: covers what the box covers, but is invalid.
SPIKED = ring_geom(
    [("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h"), ("x + w / 2", "y + h / 2"), ("x", "y + h"), ("x", "y")]
)
DIAGONAL = line_geom([("x", "y"), ("x + w", "y + h")])


_OBJECT = (
    "package_id",
    "concat('b', key) AS object_id",
    "ground_z",
    "CASE WHEN key % 7 != 0 THEN ground_z - p_size / 4D END AS foundation_z",
)


def objects(spark: SparkSession, folder: str) -> DataFrame:
    return _footprints(spark, folder).selectExpr(
        *_OBJECT, f"CASE WHEN key % 2 = 0 THEN {PLAIN} ELSE {TRIANGLE} END AS geom"
    )


def surveyed_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The objects with their planar validity; some boxes have a spike and are invalid."""
    return _footprints(spark, folder).selectExpr(
        *_OBJECT,
        f"CASE WHEN key % 38 = 4 THEN {SPIKED} WHEN key % 2 = 0 THEN {PLAIN} ELSE {TRIANGLE} END AS geom",
        "key % 38 != 4 AS is_valid",
    )


def corridors_of(events: DataFrame, *extra: str) -> DataFrame:
    """Corridor requests out of event rows; shared by the batch and stream forms."""
    return (
        events.selectExpr(
            "*",
            "(user_id * 13 % 360) / 4D AS x0",
            "(event_id * 6 div 100) / 4D AS y0",
            "(event_id % 8) / 4D + 0.5D AS dx",
            "(event_id % 5) / 4D AS dy",
        )
        .selectExpr(
            *extra,
            city("event_id"),
            "concat('c', event_id) AS corridor_id",
            "'plane' AS space_id",
            line_geom(
                [("x0", "y0"), ("x0 + dx", "y0 + dy"), ("x0 + dx + 0.5D", "y0 + dy - 0.25D")]
            )
            + " AS geom",
            "(event_id % 4 + 1) / 8D AS radius",
            "CASE event_type WHEN 'purchase' THEN 'elevated' WHEN 'error' THEN 'elevated' "
            "WHEN 'signup' THEN 'tunnel' ELSE 'surface' END AS requested_mode",
            "CASE event_type WHEN 'error' THEN array('elevated', 'surface') "
            "WHEN 'signup' THEN array('tunnel') "
            "ELSE array('elevated', 'surface', 'tunnel') END AS asset_modes",
            "CASE WHEN event_id % 5 = 0 THEN 100D END AS minimum_z",
            "if(event_id % 50 = 0, 'r0', 'r1') AS expected_revision",
        )
    )


def corridors(spark: SparkSession, folder: str) -> DataFrame:
    return corridors_of(table(spark, folder, "events"))


def protected(spark: SparkSession, folder: str) -> DataFrame:
    high = plane_height(spark, folder)
    return (
        table(spark, folder, "nation")
        .selectExpr(
            "n_nationkey AS key",
            "double(n_nationkey * 17 % 96) AS x",
            f"double(n_nationkey * {high}L div 25) AS y",
        )
        .selectExpr(
            city("key"),
            "concat('n', key) AS area_id",
            f"{box_geom('x', 'y', 'x + 3', 'y + 2')} AS geom",
        )
    )


def snapshot_header(spark: SparkSession, folder: str) -> DataFrame:
    """One header per package; the test plane is one package."""
    return (
        table(spark, folder, "region")
        .groupBy()
        .agg(F.count("*").alias("n"))
        .selectExpr(
            city("nullif(n, 0)"),
            "'r1' AS revision",
            "'plane' AS space_id",
            "n > 0 AS existing_data_complete",
            "'v1' AS rules_version",
            "0.25D AS control_buffer",
            "3D AS minimum_cover",
            "2D AS foundation_clearance",
            "4D AS outer_height",
        )
    )


def boundary_records(spark: SparkSession, folder: str) -> DataFrame:
    """Two boundary layers: the footprints of all parts, and one lost record."""
    records = (
        _footprints(spark, folder)
        .withColumn("plain", F.expr(PLAIN))
        .selectExpr(
            "package_id",
            "'roads' AS layer",
            "'r1' AS revision",
            "string(key) AS source_record_id",
            "array('Normal', 'Elevated', 'Tunnel')[key div 3 % 3] AS source_form",
            f"CASE WHEN key % 3 = 0 THEN {BOWTIE} WHEN key % 3 = 1 THEN plain "
            f"ELSE {raised('plain')} END AS geom",
        )
    )
    lost = (
        table(spark, folder, "region")
        .filter("r_regionkey = 0")
        .selectExpr(
            city("r_regionkey"),
            "'lost' AS layer",
            "'r1' AS revision",
            "'0' AS source_record_id",
            "string(NULL) AS source_form",
            f"CAST(NULL AS {GEOMETRY}) AS geom",
        )
    )
    return records.unionByName(lost)


def _pick(values: list, index: str) -> str:
    words = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"array({words})[int({index})]"


def network_features(spark: SparkSession, folder: str) -> DataFrame:
    """Vector layers with free attributes; some records have no or odd geometry."""
    objects_ = ["Road", "Track", "Pathway", "Taxiway", "Runway", "Tram", "Road, Tram"]
    categories = ["Small, Tram", "Cargo", "Tram", " Large ,,Small", None]
    forms = ["Normal", "Elevated", "Tunnel", "Normal,Tunnel", None]
    return (
        _footprints(spark, folder)
        .withColumn("plain", F.expr(PLAIN))
        .selectExpr(
            "package_id",
            "if(key % 4 = 0, 'Building', 'Network') AS layer",
            "string(key) AS source_record_id",
            "CASE WHEN key % 29 = 3 THEN NULL "
            "WHEN key % 29 = 5 THEN named_struct('kind', 'line', 'has_z', false, "
            "'parts', slice(plain.parts, 1, 0)) "
            f"WHEN key % 29 = 7 THEN {BOWTIE} WHEN key % 29 = 11 THEN {raised('plain')} "
            f"WHEN key % 4 = 0 THEN plain ELSE {DIAGONAL} END AS geom",
            f"map('Object', {_pick(objects_, 'key % 7')}, 'Category', {_pick(categories, 'p_size % 5')}, "
            f"'Form', {_pick(forms, 'key % 5')}, 'Lane', string(key % 4 + 1)) AS props",
        )
    )


def plane_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The whole plane as one terrain grid of package 'city'."""
    high = plane_height(spark, folder)
    return (
        table(spark, folder, "region")
        .groupBy()
        .agg(F.count("*").alias("n"))
        .selectExpr(
            city("nullif(n, 0)"),
            "'terrain' AS role",
            "'plane' AS grid_id",
            "100 AS width",
            f"{high} AS height",
            "1D AS a",
            "0D AS b",
            "0D AS c",
            "0D AS d",
            "-1D AS e",
            f"double({high}) AS f",
            "'EPSG:32631' AS crs",
            f"{NODATA}D AS nodata",
            "'float32' AS dtype",
            "'m' AS band_unit",
            "1 AS band_count",
        )
    )


def plane_cells(spark: SparkSession, folder: str) -> DataFrame:
    strips = terrain_cells(spark, folder)
    return strips.select(
        F.expr(city("package_id")),
        F.lit("plane").alias("grid_id"),
        (F.col("package_id") * STRIP + F.col("row")).cast("int").alias("row"),
        "col",
        "value",
        "mask",
    )


def water_faces(spark: SparkSession, folder: str) -> DataFrame:
    """Water polygons that overlap on purpose."""
    high = plane_height(spark, folder)
    frames = table(spark, folder, "nation").selectExpr(
        "n_nationkey AS key",
        "double(n_nationkey * 11 % 90) AS x",
        f"double(n_nationkey * {high}L div 25) AS y",
    )
    triangle = ring_geom([("x + 4", "y"), ("x + 16", "y + 1"), ("x + 4", "y + 12"), ("x + 4", "y")])
    boxes = frames.selectExpr(
        "key",
        "concat('w', key) AS face_id", f"{box_geom('x', 'y', 'x + 8', 'y + 5')} AS geom"
    )
    triangles = frames.filter("key % 2 = 1").selectExpr(
        "key",
        "concat('t', key) AS face_id", f"{triangle} AS geom"
    )
    return boxes.unionByName(triangles).selectExpr(
        city("key"), "'water' AS role", "face_id", "geom"
    )


def rim_faces(spark: SparkSession, folder: str) -> DataFrame:
    """Water faces outside the coverage that touch its right border: boxes along it, triangles in a point."""
    high = plane_height(spark, folder)
    tip = ring_geom([("80", "y + 1"), ("84", "y"), ("84", "y + 2"), ("80", "y + 1")])
    return (
        table(spark, folder, "nation")
        .selectExpr("n_nationkey AS key", f"double(n_nationkey * {high}L div 25) AS y")
        .selectExpr(
            city("key"),
            "'water' AS role",
            "concat('e', key) AS face_id",
            f"CASE WHEN key % 2 = 0 THEN {box_geom('80', 'y', '84', 'y + 3')} ELSE {tip} END AS geom",
        )
    )


def water_coverage(spark: SparkSession, folder: str) -> DataFrame:
    high = plane_height(spark, folder)
    return (
        table(spark, folder, "region")
        .groupBy()
        .agg(F.count("*").alias("n"))
        .selectExpr(
            city("nullif(n, 0)"),
            "'coverage' AS role",
            "'cover' AS face_id",
            f"{box_geom('0', '0', '80', str(high))} AS geom",
        )
    )


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    n_nodes = table(spark, folder, "customer").count()
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("src"),
        (F.col("o_orderkey") * 7919 % n_nodes).alias("dst"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("weight"),
    )


def od_trips(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("origin"),
        (F.col("l_partkey") % 10).alias("destination"),
        F.col("l_quantity").alias("trips"),
    )


def road_nodes(spark: SparkSession, folder: str) -> DataFrame:
    scaled = lambda i: F.round(F.element_at("embedding", i).cast("double") * 64, 0)
    return table(spark, folder, "embeddings").select(
        F.expr(city("vec_id")),
        F.col("vec_id").alias("node_id"),
        scaled(1).alias("x"),
        scaled(2).alias("y"),
    )


def snap_points(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        F.expr(city("event_id")),
        key.alias("point_id"),
        ((F.col("user_id") * 13 % 129) - 64).cast("double").alias("x"),
        ((key * 7 % 129) - 64).cast("double").alias("y"),
    )


def page_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 8).alias("package_id"),
        F.col("url").alias("path"),
        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"),
    )


def changed_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The same files later: some altered, some gone."""
    key = F.col("page_id")
    return (
        table(spark, folder, "pages")
        .filter(key % 25 != 7)
        .select(
            F.floor(key / 8).alias("package_id"),
            F.col("url").alias("path"),
            F.sha2(
                F.when(key % 10 == 3, F.concat("html", F.lit("!")))
                .otherwise(F.col("html"))
                .cast("binary"),
                256,
            ).alias("sha256"),
        )
    )


def zone_points(spark: SparkSession, folder: str) -> DataFrame:
    """Point features on a quarter grid, many of them on zone borders."""
    return table(spark, folder, "events").selectExpr(
        city("event_id"),
        "concat('p', event_id) AS feature_id",
        point_geom("(user_id * 13 % 400) / 4D", "(event_id * 6 div 100) / 4D") + " AS geom",
    )
