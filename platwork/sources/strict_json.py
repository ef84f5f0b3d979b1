"""Strict JSON import: closed field lists and exact JSON types; bad rows get a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions.rules import assertion_rules
from platwork.model import EDITABLE_LAND_USES, LAND_USES
from platwork.operators.quality import with_validity
from platwork.session import stored
from platwork.sources.features import geojson_geometry

# --- fixed values: field lists of the two documents -------------------------------
ZONE_FIELDS = (
    "zone_id",
    "geometry",
    "land_use",
    "block_size_m",
    "allow_demolition",
    "scenario_overrides",
)
ZONE_REQUIRED = ("zone_id", "geometry", "land_use", "block_size_m")
ASSERTION_FIELDS = (
    "carto_source_confirmed",
    "complete_depth_coverage_confirmed",
    "terrain_unit",
    "terrain_vertical_reference",
    "game_mapping_confirmed",
    "evidence",
)


def _type_of(field: str) -> Column:
    """JSON type of a field: BOOLEAN, STRING, BIGINT, ..., VOID for null; NULL if absent."""
    return F.expr(f"schema_of_variant(variant_get(_doc, '$.{field}', 'variant'))")


def _opened(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumn("_doc", F.expr("try_parse_json(raw)")).withColumn(
        "_object",
        F.coalesce(F.expr("schema_of_variant(_doc) LIKE 'OBJECT%'"), F.lit(False)),
    )
    keys = F.when(F.col("_object"), F.expr("json_object_keys(raw)"))
    return rows.withColumn("_keys", keys).withColumns(
        {f"_t_{name}": F.when(F.col("_object"), _type_of(name)) for name in fields}
    )


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def import_zones(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zone documents (package_id, row_id, raw) to zone rows and rejected rows.

    The first failing check names the code; input can never grant itself rights.
    """
    t = lambda name: F.col(f"_t_{name}")
    opened = _opened(rows, ZONE_FIELDS)
    overrides_given = t("scenario_overrides").isNotNull() & (t("scenario_overrides") != "VOID")
    read = opened.withColumns(
        {
            "zone_id": F.when(t("zone_id") == "STRING", F.expr("get_json_object(raw, '$.zone_id')")),
            "land_use": F.when(t("land_use") == "STRING", F.expr("get_json_object(raw, '$.land_use')")),
            "geom": F.expr(geojson_geometry("get_json_object(raw, '$.geometry')")),
            "_sizes": F.when(
                t("block_size_m").startswith("ARRAY"),
                F.expr("variant_get(_doc, '$.block_size_m', 'array<variant>')"),
            ),
            "allow_demolition": F.when(
                t("allow_demolition") == "BOOLEAN",
                F.expr("get_json_object(raw, '$.allow_demolition') = 'true'"),
            ).when(t("allow_demolition").isNull(), False),
            "_params": F.when(
                overrides_given & t("scenario_overrides").startswith("OBJECT"),
                F.expr("variant_get(_doc, '$.scenario_overrides', 'map<string,variant>')"),
            ),
            "layer": F.lit("zones"),
            "source_record_id": F.col("row_id").cast("string"),
        }
    )
    # A number written as text or a boolean is not a number.
    strict = (
        "CASE WHEN schema_of_variant(v) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' "
        "THEN CAST(v AS double) END"
    )
    read = read.withColumns(
        {
            "_numbers": F.expr(f"transform(_sizes, v -> {strict})"),
            "overrides": F.expr(f"transform_values(_params, (k, v) -> {strict})"),
        }
    ).drop("_doc", "_params", "raw")
    # Documents are parsed once; their validity and both results look at what was read.
    read = with_validity(stored(read, "documents"))

    def no(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    in_shape = (
        (F.size(F.array_except("_keys", _words(ZONE_FIELDS))) == 0)
        & (F.size(F.array_except(_words(ZONE_REQUIRED), "_keys")) == 0)
    )
    bad_value = F.exists(
        F.map_values("overrides"),
        lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")),
    )
    usable = F.expr(
        "geom.kind = 'polygon' AND NOT geom.has_z AND is_valid AND size(flatten(flatten(geom.parts))) > 0"
    )
    finite_sizes = F.forall(
        "_numbers", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    code = (
        F.when(~F.col("_object"), "INVALID_INPUT")
        .when(no(in_shape), "INVALID_SCHEMA")
        .when(overrides_given & F.col("overrides").isNull(), "INVALID_PARAMETERS")
        .when(
            F.col("geom").isNull() | no(F.col("land_use").isin(*LAND_USES)) | F.col("_sizes").isNull(),
            "INVALID_INPUT",
        )
        .when(
            F.coalesce(F.exists(F.map_keys("overrides"), lambda k: F.trim(k) == ""), F.lit(False)),
            "INVALID_ID",
        )
        .when(F.coalesce(bad_value, F.lit(False)), "INVALID_NUMBER")
        .when(F.trim(F.coalesce("zone_id", F.lit(""))) == "", "INVALID_ID")
        .when(no(usable), "INVALID_GEOMETRY")
        .when(F.col("allow_demolition").isNull(), "INVALID_PERMISSION")
        .when(F.size("_sizes") != 2, "INVALID_BLOCK_SIZE")
        .when(no(finite_sizes), "INVALID_NUMBER")
        .when(F.exists("_numbers", lambda v: v <= 0), "INVALID_BLOCK_SIZE")
        .when(
            F.col("overrides").isNotNull() & ~F.col("land_use").isin(*EDITABLE_LAND_USES),
            "SCENARIO_LOCKED",
        )
    )
    judged = read.withColumn("code", code)
    zones = judged.filter("code IS NULL").select(
        "package_id",
        "row_id",
        "zone_id",
        "geom",
        "land_use",
        F.col("_numbers")[0].alias("block_w"),
        F.col("_numbers")[1].alias("block_h"),
        "allow_demolition",
        "overrides",
    )
    return zones, judged.filter("code IS NOT NULL").select("package_id", "row_id", "code")


def import_assertions(rows: DataFrame) -> DataFrame:
    """Declared source facts (package_id, raw) with the codes they violate.

    Absent fields take their cautious default; a wrong JSON type is never coerced.
    """
    t = lambda name: F.col(f"_t_{name}")
    opened = _opened(rows, ASSERTION_FIELDS)
    flags = ("carto_source_confirmed", "complete_depth_coverage_confirmed", "game_mapping_confirmed")
    texts = ("terrain_unit", "terrain_vertical_reference", "evidence")
    read = opened.withColumns(
        {
            **{
                name: F.when(t(name).isNull(), False).when(
                    t(name) == "BOOLEAN", F.expr(f"get_json_object(raw, '$.{name}') = 'true'")
                )
                for name in flags
            },
            **{
                name: F.when(t(name) == "STRING", F.expr(f"get_json_object(raw, '$.{name}')"))
                for name in texts
            },
        }
    )
    odd_text = F.lit(False)
    for name in ("terrain_unit", "terrain_vertical_reference"):
        odd_text = odd_text | (t(name).isNotNull() & ~t(name).isin("STRING", "VOID"))
    odd_text = odd_text | (t("evidence").isNotNull() & (t("evidence") != "STRING"))
    unknown = F.size(F.array_except("_keys", _words(ASSERTION_FIELDS))) > 0
    codes = (
        F.when(~F.col("_object"), F.array(F.lit("INVALID_SOURCE_ASSERTION")))
        .when(unknown, F.array(F.lit("UNKNOWN_SOURCE_ASSERTION")))
        .when(odd_text, F.array(F.lit("INVALID_SOURCE_ASSERTION")))
        .otherwise(assertion_rules())
    )
    return read.select("package_id", *flags, *texts, codes.alias("codes"))
