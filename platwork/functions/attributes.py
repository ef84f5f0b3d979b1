"""Attribute text: token lists and network normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.model import (
    BACKGROUND_OBJECTS,
    BACKGROUND_TRACK_CATEGORIES,
    NETWORK_FORMS,
    TOKEN_ATTRIBUTES,
)


def source_tokens(text: Column) -> Column:
    """Sorted distinct nonblank parts of a comma list; NULL gives an empty list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_network(features: DataFrame) -> DataFrame:
    """Form, background and road-candidate flags of network features; nothing is asserted.

    Tram lanes do not make a road a background object, road freight neither.
    """
    props = F.col("props")
    tokens = {
        f"_{name.lower()}": source_tokens(F.element_at(props, name))
        for name in ("Object", "Category", "Form")
    }
    form = F.lit(None).cast("string")
    for source, name in NETWORK_FORMS.items():
        form = F.when(F.element_at("_form", 1) == source, name).otherwise(form)
    excluded = F.arrays_overlap("_object", _words(BACKGROUND_OBJECTS)) | (
        F.array_contains("_object", "Track")
        & F.arrays_overlap("_category", _words(BACKGROUND_TRACK_CATEGORIES))
    )
    return (
        features.withColumns(tokens)
        .withColumns(
            {
                "form": F.when(F.size("_form") == 1, form),
                "excluded": excluded,
                "lanes_source": F.element_at(props, "Lane"),
                "speed_source": F.element_at(props, "Limit"),
                "elevation_source": F.element_at(props, "Elevation"),
                "direction_source": F.element_at(props, "Direction"),
            }
        )
        .withColumns(
            {
                "road_candidate": (F.col("_object") == F.array(F.lit("Road")))
                & ~F.col("excluded"),
                "topology_verified": F.lit(False),
                "vertical_geometry_verified": F.lit(False),
                "diagnostic": F.when(F.col("form").isNull(), "UNKNOWN_OR_AMBIGUOUS_FORM"),
            }
        )
        .withColumnsRenamed(
            {"_object": "source_object", "_category": "source_category", "_form": "source_form"}
        )
    )


def attribute_tokens(features: DataFrame) -> DataFrame:
    """One row per feature, interpreted attribute and token."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("attribute"),
                source_tokens(F.element_at("props", name)).alias("tokens"),
            )
            for name in TOKEN_ATTRIBUTES
        ]
    )
    return (
        features.select("package_id", "layer", F.explode(pairs).alias("p"))
        .select("package_id", "layer", "p.attribute", F.explode("p.tokens").alias("token"))
    )
