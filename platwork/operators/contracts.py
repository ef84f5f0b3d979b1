"""Zone contracts as table jobs: scenario values, land use changes, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.model import EDITABLE_LAND_USES


def change_land_use(zones: DataFrame, new_use: Column) -> DataFrame:
    """Set the land use; overrides survive only where the new use may have them."""
    kept = F.when(new_use.isin(*EDITABLE_LAND_USES), F.col("overrides"))
    return zones.withColumns({"land_use": new_use, "overrides": kept})


def resolve_scenario(
    zones: DataFrame, system: DataFrame, user: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Parameter values per zone: zone override before user default before system default.

    `system` and `user` hold package_id, land_use, name, value. Returns the values and
    the rejected zones with a code: no system default for the use, a parameter the
    system does not know, or values where the use is locked.
    """
    keys = ["package_id", "zone_id"]
    wide = zones.select(*keys, "land_use", "overrides")
    own = wide.select(*keys, "land_use", F.explode("overrides").alias("name", "zone_value"))
    by_use = ["package_id", "land_use"]
    params = wide.select(*keys, "land_use").join(
        system.withColumnRenamed("value", "system_value"), by_use
    )
    user = user.withColumnRenamed("value", "user_value")
    values = (
        params.join(user, [*by_use, "name"], "left")
        .join(own.drop("land_use"), [*keys, "name"], "left")
        .select(*keys, "name", F.coalesce("zone_value", "user_value", "system_value").alias("value"))
    )
    editable = F.col("land_use").isin(*EDITABLE_LAND_USES)
    known = system.select(*by_use, "name")
    unknown_own = own.join(known, [*by_use, "name"], "left_anti").select(*keys)
    unknown_user = (
        user.join(known, [*by_use, "name"], "left_anti")
        .select(*by_use)
        .distinct()
        .join(wide.select(*keys, "land_use"), by_use)
        .select(*keys)
    )
    no_default = wide.join(system.select(*by_use).distinct(), by_use, "left_anti").select(*keys)
    locked = own.filter(~editable).select(*keys).unionByName(
        user.filter(~editable)
        .select(*by_use)
        .distinct()
        .join(wide.select(*keys, "land_use"), by_use)
        .select(*keys)
    )
    rejects = (
        no_default.withColumn("code", F.lit("MISSING_DEFAULTS"))
        .unionByName(
            unknown_own.unionByName(unknown_user).withColumn("code", F.lit("UNKNOWN_PARAMETER"))
        )
        .unionByName(locked.withColumn("code", F.lit("SCENARIO_LOCKED")))
        .distinct()
    )
    return values.join(rejects.select(*keys), keys, "left_anti"), rejects


def duplicate_keys(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
        .withColumn("code", F.lit(code))
    )


def declared_count_check(header: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Declared against actual record counts."""
    actual = rows.groupBy(*keys).agg(F.count("*").alias("actual_count"))
    return header.join(actual, keys, "left").select(
        *keys,
        "declared_count",
        F.coalesce("actual_count", F.lit(0)).cast("long").alias("actual_count"),
        F.when(
            ~F.col("declared_count").eqNullSafe(F.coalesce("actual_count", F.lit(0)).cast("long")),
            "SOURCE_RECORDS_DROPPED",
        ).alias("code"),
    )
