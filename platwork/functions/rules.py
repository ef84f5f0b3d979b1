"""Row rules of the contracts: each returns the list of codes a row violates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platwork.functions.cells import is_finite
from platwork.functions.geometry import all_finite, edges_of, is_empty, length
from platwork.model import EDITABLE_LAND_USES, LAND_USES, MODES


def violations(*checks: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in rule order; an undecidable rule counts as broken."""
    return F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), code) for bad, code in checks]),
        lambda code: code.isNotNull(),
    )


def first_violation(*checks: tuple[Column, str]) -> Column:
    """The first broken rule, or NULL."""
    return F.get(violations(*checks), 0)


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def bad_number(value: Column, minimum: float | None = None) -> Column:
    bad = ~F.coalesce(is_finite(value), F.lit(False))
    return bad if minimum is None else bad | (value < minimum)


def bad_optional_number(value: Column) -> Column:
    return value.isNotNull() & bad_number(value)


def bad_polygon() -> Column:
    """For rows with geom and is_valid."""
    return F.expr(
        f"NOT coalesce(geom.kind = 'polygon' AND NOT {is_empty('geom')} AND is_valid "
        f"AND NOT geom.has_z AND {all_finite('geom')}, false)"
    )


def bad_parameters(params: Column) -> list[tuple[Column, str]]:
    names = F.coalesce(F.map_keys(params), F.array().cast("array<string>"))
    values = F.coalesce(F.map_values(params), F.array().cast("array<double>"))
    return [
        (F.exists(names, lambda n: blank(n)), "INVALID_ID"),
        (F.exists(values, lambda v: bad_number(v, 0.0)), "INVALID_NUMBER"),
    ]


def zone_rules() -> Column:
    """Zone rows: zone_id, geom, land_use, block_w, block_h, allow_demolition, overrides."""
    block_bad = bad_number(F.col("block_w")) | bad_number(F.col("block_h"))
    return violations(
        (blank(F.col("zone_id")), "INVALID_ID"),
        (bad_polygon(), "INVALID_GEOMETRY"),
        (~F.col("land_use").isin(*LAND_USES), "INVALID_LAND_USE"),
        (F.col("allow_demolition").isNull(), "INVALID_PERMISSION"),
        (block_bad, "INVALID_NUMBER"),
        (~block_bad & ((F.col("block_w") <= 0) | (F.col("block_h") <= 0)), "INVALID_BLOCK_SIZE"),
        *bad_parameters(F.col("overrides")),
        (
            F.col("overrides").isNotNull()
            & ~F.coalesce(F.col("land_use").isin(*EDITABLE_LAND_USES), F.lit(False)),
            "SCENARIO_LOCKED",
        ),
    )


def object_rules() -> Column:
    ground, foundation = F.col("ground_z"), F.col("foundation_z")
    numbers_bad = bad_optional_number(ground) | bad_optional_number(foundation)
    return violations(
        (blank(F.col("object_id")), "INVALID_ID"),
        (bad_polygon(), "INVALID_GEOMETRY"),
        (numbers_bad, "INVALID_NUMBER"),
        (
            ~numbers_bad & F.coalesce(foundation > ground, F.lit(False)),
            "INVALID_ELEVATION",
        ),
    )


def corridor_rules() -> Column:
    line_ok = F.expr(
        f"geom.kind = 'line' AND NOT {is_empty('geom')} AND NOT geom.has_z "
        f"AND {all_finite('geom')} AND {length(edges_of('geom'))} > 0"
    )
    modes = F.array(*[F.lit(m) for m in MODES])
    assets = F.col("asset_modes")
    assets_ok = (
        F.col("requested_mode").isin(*MODES)
        & (F.size(assets) > 0)
        & (F.size(F.array_except(assets, modes)) == 0)
    )
    radius_bad = bad_number(F.col("radius"))
    return violations(
        (blank(F.col("corridor_id")) | blank(F.col("space_id")), "INVALID_ID"),
        (~F.coalesce(line_ok, F.lit(False)), "INVALID_GEOMETRY"),
        (radius_bad, "INVALID_NUMBER"),
        (~radius_bad & (F.col("radius") <= 0), "INVALID_ENVELOPE"),
        (~F.coalesce(assets_ok, F.lit(False)), "INVALID_ASSET"),
        (bad_optional_number(F.col("minimum_z")), "INVALID_NUMBER"),
    )


def tunnel_rules() -> Column:
    height_bad = bad_number(F.col("outer_height"))
    distances = ("control_buffer", "minimum_cover", "foundation_clearance")
    any_bad = F.lit(False)
    for name in distances:
        any_bad = any_bad | bad_number(F.col(name), 0.0)
    return violations(
        (blank(F.col("rules_version")), "INVALID_ID"),
        (any_bad | height_bad, "INVALID_NUMBER"),
        (~height_bad & (F.col("outer_height") <= 0), "INVALID_TUNNEL_RULE"),
    )


def assertion_rules() -> Column:
    """Declared source facts: they need evidence, and coverage needs a confirmed source."""
    flags = (
        "carto_source_confirmed",
        "complete_depth_coverage_confirmed",
        "game_mapping_confirmed",
    )
    flag_missing = F.lit(False)
    for name in flags:
        flag_missing = flag_missing | F.col(name).isNull()
    said = F.lit(False)
    for name in flags:
        said = said | F.coalesce(F.col(name), F.lit(False))
    said = (
        said
        | F.col("terrain_unit").isNotNull()
        | F.col("terrain_vertical_reference").isNotNull()
    )
    return violations(
        (flag_missing, "INVALID_SOURCE_ASSERTION"),
        (
            F.col("terrain_unit").isNotNull() & (F.col("terrain_unit") != "m"),
            "UNSUPPORTED_VERTICAL_UNIT",
        ),
        (
            F.col("terrain_vertical_reference").isNotNull()
            & blank(F.col("terrain_vertical_reference")),
            "INVALID_VERTICAL_REFERENCE",
        ),
        (said & blank(F.col("evidence")), "MISSING_ASSERTION_EVIDENCE"),
        (
            F.coalesce(F.col("complete_depth_coverage_confirmed"), F.lit(False))
            & ~F.coalesce(F.col("carto_source_confirmed"), F.lit(False)),
            "SOURCE_UNCONFIRMED",
        ),
    )
