"""Feature layers in: Parquet, JSON lines and GeoJSON; every record is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.model import GEOMETRY

FEATURE_SCHEMA = (
    f"package_id string, layer string, source_record_id string, geom {GEOMETRY}, "
    "props map<string,string>"
)


def read_features(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Features with null geometry and all attributes kept, from Parquet or JSON lines."""
    return spark.read.schema(FEATURE_SCHEMA).format(form).load(path)


def declared_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("package_id", "layer").agg(
        F.count("*").alias("records"), F.count_if(F.col("geom").isNull()).alias("null_geometry")
    )


# Coordinates of each GeoJSON type as nested arrays, lifted to part -> ring -> vertex.
_LIFTS = {
    "Point": ("array<double>", "array(array(array(c)))", "point"),
    "MultiPoint": ("array<array<double>>", "transform(c, v -> array(array(v)))", "point"),
    "LineString": ("array<array<double>>", "array(array(c))", "line"),
    "MultiLineString": ("array<array<array<double>>>", "transform(c, l -> array(l))", "line"),
    "Polygon": ("array<array<array<double>>>", "array(c)", "polygon"),
    "MultiPolygon": ("array<array<array<array<double>>>>", "c", "polygon"),
}


def geojson_geometry(text: str) -> str:
    """SQL text: a GeoJSON geometry string as geometry struct, NULL when unreadable."""
    cases = []
    for name, (shape, lift, kind) in _LIFTS.items():
        coordinates = f"from_json(get_json_object({text}, '$.coordinates'), '{shape}')"
        lifted = f"aggregate(array({coordinates}), CAST(NULL AS array<array<array<array<double>>>>), (z, c) -> {lift})"
        struct = (
            f"aggregate(array({lifted}), CAST(NULL AS {GEOMETRY}), (z, p) -> "
            "CASE WHEN p IS NOT NULL AND forall(flatten(flatten(p)), v -> size(v) >= 2) THEN "
            f"named_struct('kind', '{kind}', "
            "'has_z', exists(flatten(flatten(p)), v -> size(v) > 2), "
            "'parts', transform(p, q -> transform(q, r -> transform(r, v -> "
            "named_struct('x', v[0], 'y', v[1]))))) END)"
        )
        cases.append(f"WHEN '{name}' THEN {struct}")
    return f"CASE get_json_object({text}, '$.type') {' '.join(cases)} END"


def parse_collections(texts: DataFrame, source_crs: str | None) -> DataFrame:
    """Features of FeatureCollection texts (collection_id, text).

    The coordinate system has to be declared; a null feature geometry is an error row, and
    so is a text that is no collection (INVALID_FEATURE_COLLECTION); neither is dropped. A
    collection without features is one row without a position and without a code.
    """
    if not source_crs:
        raise ValueError("EXPLICIT_GEOJSON_CRS_REQUIRED: declare the coordinate system")
    feature = "struct<id:string,geometry:string,properties:map<string,string>>"
    rows = texts.selectExpr(
        "collection_id",
        f"from_json(text, 'struct<type:string,features:array<{feature}>>') AS d",
    ).selectExpr(
        "collection_id",
        "d.type IS NULL OR d.type <> 'FeatureCollection' OR d.features IS NULL AS broken",
        "d.features AS fs",
    ).selectExpr("collection_id", "broken", "posexplode_outer(if(broken, NULL, fs)) AS (position, f)")
    return rows.selectExpr("*", f"{geojson_geometry('f.geometry')} AS geom").selectExpr(
        "collection_id",
        "position",
        "f.id AS feature_id",
        "geom",
        "f.properties AS props",
        f"'{source_crs}' AS source_crs",
        "CASE WHEN broken THEN 'INVALID_FEATURE_COLLECTION'"
        " WHEN position IS NOT NULL AND geom IS NULL THEN 'INVALID_WATER_GEOMETRY' END AS code",
    )


def read_geojson(spark: SparkSession, path: str, source_crs: str | None) -> DataFrame:
    """FeatureCollection files, one text per file."""
    texts = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("collection_id"), F.col("value").alias("text")
    )
    return parse_collections(texts, source_crs)
