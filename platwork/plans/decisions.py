"""The corridor decision: which construction modes are admissible, and why.

Verdicts carry counts and limits only, so the roll-up state of a corridor is fixed in
size however many objects it meets; the objects themselves are rows of the item table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.functions.geometry import area
from platwork.operators import conflicts as oc
from platwork.session import stored


def no_modes() -> Column:
    return F.array().cast("array<string>")


def tunnel_only() -> Column:
    return F.array(F.lit("tunnel"))


def admitted(corridors: DataFrame, header: DataFrame) -> DataFrame:
    """Corridors with their package's snapshot header and an entry code.

    A stale request is answered before anything else; a foreign coordinate space is an
    error. A package without a header counts as stale.
    """
    return corridors.join(header, "package_id", "left").withColumn(
        "entry_code",
        F.when(
            ~F.col("expected_revision").eqNullSafe(F.col("revision")), "INPUT_REVISION_CHANGED"
        ).when(
            ~F.col("space_id").eqNullSafe(F.col("snapshot_space")), "COORDINATE_SPACE_MISMATCH"
        ),
    )


def headed(header: DataFrame) -> DataFrame:
    return header.withColumnRenamed("space_id", "snapshot_space")


def ceiling(ground: Column, foundation: Column) -> Column:
    """Highest admissible tunnel axis below an object; NULL while a level is unknown."""
    cover = ground - F.col("minimum_cover")
    clear = foundation - F.col("foundation_clearance")
    return F.when(
        ground.isNotNull() & foundation.isNotNull(),
        F.least(cover, clear) - F.col("outer_height") / 2.0,
    )


DISTANCES = ("control_buffer", "minimum_cover", "foundation_clearance", "outer_height")


def _features_met(hits: DataFrame, objects: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """The objects (and guards with an area) that any corridor meets: package_id, feature (tag, id), geom, is_valid."""

    def met(df: DataFrame, tag: str, geom: str, valid: str) -> DataFrame:
        ids = hits.filter(F.col("tag") == tag).select("package_id", F.col("id").alias("object_id"))
        return df.join(ids, ["package_id", "object_id"], "left_semi").selectExpr(
            "package_id", f"named_struct('tag', '{tag}', 'id', object_id) AS feature", f"{geom} AS geom", *([valid] if valid else [])
        )

    given = "is_valid" if "is_valid" in objects.columns else ""
    own = met(objects, "object", "geom", given)
    if guards is None:
        return own
    # A guard is a valid source or a box.
    solid = met(guards.filter(f"{area('guard')} > 0"), "boundary", "guard", "true AS is_valid")
    return (own if given else oc.checked(own, "feature")).unionByName(solid)


def hit_roles(hits: DataFrame, objects: DataFrame, zones: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """package_id, tag, id and role of what corridors meet; only that is compared with zones."""
    like = objects.select("geom")
    if guards is not None:
        like = like.unionByName(guards.select(F.col("guard").alias("geom")))
    return oc.roles(_features_met(hits, objects, guards), zones, "feature", like).select(
        "package_id", "feature.tag", "feature.id", "role"
    )


def conflict_items(
    corridors: DataFrame, objects: DataFrame, zones: DataFrame, header: DataFrame
) -> DataFrame:
    """One row per corridor and object met, with its role and tunnel ceiling."""
    lines = corridors.join(header.select("package_id", *DISTANCES), "package_id")
    # Ids of hits are few beside the shapes, and used twice.
    hits = stored(oc.corridor_hits(lines, objects), "hits")
    return hits.join(hit_roles(hits, objects, zones), ["package_id", "tag", "id"]).select(
        "package_id", F.col("id").alias("object_id"), "corridor_id", "role", "ceiling_z"
    )


def conflict_rollup(items: DataFrame, *extra: Column) -> DataFrame:
    """Fixed-size summary per corridor; unresolved objects are mandatory as well."""
    must = F.col("role") != "demolition"
    return items.groupBy("package_id", "corridor_id").agg(
        F.count_if(must).alias("n_mandatory"),
        F.count_if(~must).alias("n_demolition"),
        F.count_if(F.col("role") == "unresolved").alias("n_unresolved"),
        F.count_if(must & F.col("ceiling_z").isNull()).alias("n_level_unknown"),
        F.min(F.when(must, F.col("ceiling_z"))).alias("lowest_ceiling"),
        F.min(F.when(must, F.col("object_id"))).alias("first_mandatory"),
        F.max(F.when(must, F.col("object_id"))).alias("last_mandatory"),
        *extra,
    )


def protected_met() -> Column:
    """Of items with a tag: the number of protected areas that a corridor meets."""
    return F.count_if(F.col("tag") == "protected").alias("n_protected")


def cascade(facts: DataFrame) -> DataFrame:
    """The ordered policy cases. `facts` has one row per corridor with all summaries."""
    counts = ["n_mandatory", "n_demolition", "n_unresolved", "n_level_unknown", "n_protected"]
    facts = facts.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
    must = F.col("n_mandatory") > 0
    tunnel_asset = F.array_contains("asset_modes", "tunnel")
    low = F.coalesce(F.col("lowest_ceiling") < F.col("minimum_z"), F.lit(False))
    incomplete = ~F.coalesce(F.col("existing_data_complete"), F.lit(False))
    reason = (
        F.when(F.col("entry_code").isNotNull(), F.col("entry_code"))
        .when(F.col("n_protected") > 0, "HARD_PROTECTION_CONFLICT")
        .when(must & ~tunnel_asset, "TUNNEL_ASSET_UNSUPPORTED")
        .when(incomplete | (F.col("n_unresolved") > 0), "EXISTING_COVERAGE_OR_ZONES_UNKNOWN")
        .when(
            ~must & ~F.array_contains("asset_modes", F.col("requested_mode")),
            "REQUESTED_MODE_UNSUPPORTED",
        )
        .when(~must, "NO_NON_DEMOLISHABLE_CONFLICT")
        .when(F.col("n_level_unknown") > 0, "UNDERGROUND_ENVELOPE_MISSING")
        .when(low, "UNDERGROUND_DEPTH_RANGE_EMPTY")
        .otherwise("LOWER_ONLY_NO_OVERPASS")
    )
    facts = facts.withColumn("reason", reason)
    why = F.col("reason")
    status = (
        F.when(why == "INPUT_REVISION_CHANGED", "stale_input")
        .when(why.isin("COORDINATE_SPACE_MISMATCH", "SOURCE_OBJECT_COLLISION"), "error")
        .when(
            why.isin("EXISTING_COVERAGE_OR_ZONES_UNKNOWN", "UNDERGROUND_ENVELOPE_MISSING"),
            "data_insufficient",
        )
        .when(why == "NO_NON_DEMOLISHABLE_CONFLICT", "policy_clear")
        .when(why == "LOWER_ONLY_NO_OVERPASS", "tunnel_required")
        .otherwise("no_feasible_solution")
    )
    evaluated = F.col("entry_code").isNull() & (F.col("n_protected") == 0)
    facts = facts.withColumns(
        {
            "status": status,
            "permitted_modes": F.when(
                status.isin("stale_input", "error", "no_feasible_solution"), no_modes()
            )
            .when(must, tunnel_only())
            .otherwise(F.array_sort("asset_modes")),
        }
    )
    # Lists and limits exist only once the corridor has been evaluated.
    return facts.withColumns(
        {
            "lower_only": evaluated & must,
            "lowest_ceiling": F.when(
                why.isin("UNDERGROUND_DEPTH_RANGE_EMPTY", "LOWER_ONLY_NO_OVERPASS"),
                F.col("lowest_ceiling"),
            ),
            "n_mandatory": F.when(evaluated, F.col("n_mandatory")).otherwise(0),
            "n_demolition": F.when(evaluated, F.col("n_demolition")).otherwise(0),
            "n_unresolved": F.when(evaluated, F.col("n_unresolved")).otherwise(0),
        }
    )


VERDICT_COLUMNS = (
    "status",
    "reason",
    "permitted_modes",
    "n_mandatory",
    "n_demolition",
    "n_unresolved",
    "lowest_ceiling",
    "lower_only",
)


def decide_conflicts(
    corridors: DataFrame,
    objects: DataFrame,
    zones: DataFrame,
    protected: DataFrame,
    header: DataFrame,
) -> DataFrame:
    """One verdict per corridor.

    Hits come first, as ids and in one pass over objects and protected areas; then only the
    objects met are compared with zones. Objects and zones are expected to say whether they are
    valid (is_valid), or are looked at; invalid ones clear nothing.
    """
    requests = admitted(corridors, headed(header))
    # Stale and foreign requests are answered without touching the spatial joins.
    live = requests.filter("entry_code IS NULL").select("package_id", "corridor_id", "geom", "radius", *DISTANCES)
    keys = ["package_id", "corridor_id"]
    hits = stored(oc.corridor_hits(live, objects, protected), "hits")
    items = hits.join(hit_roles(hits, objects, zones), ["package_id", "tag", "id"], "left")
    facts = requests.drop("geom").join(conflict_rollup(items.withColumnRenamed("id", "object_id"), protected_met()), keys, "left")
    return cascade(facts).select(*keys, F.col("revision").alias("input_revision"), *VERDICT_COLUMNS)


def decision_lists(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts with sorted id arrays. For result sets known to be small per corridor."""
    must = F.col("role") != "demolition"
    lists = items.groupBy("package_id", "corridor_id").agg(
        F.array_sort(F.collect_list(F.when(must, F.col("object_id")))).alias("mandatory_ids"),
        F.array_sort(F.collect_list(F.when(~must, F.col("object_id")))).alias("demolition_ids"),
        F.array_sort(
            F.collect_list(F.when(F.col("role") == "unresolved", F.col("object_id")))
        ).alias("unresolved_ids"),
        F.array_sort(
            F.collect_list(
                F.when(must & F.col("ceiling_z").isNotNull(), F.struct("object_id", "ceiling_z"))
            )
        ).alias("ceilings"),
    )
    open_list = ~F.col("reason").isin(
        "INPUT_REVISION_CHANGED",
        "COORDINATE_SPACE_MISMATCH",
        "SOURCE_OBJECT_COLLISION",
        "HARD_PROTECTION_CONFLICT",
    )
    joined = verdicts.join(lists, ["package_id", "corridor_id"], "left")
    empty = F.array().cast("array<string>")
    for name in ("mandatory_ids", "demolition_ids", "unresolved_ids"):
        joined = joined.withColumn(
            name, F.when(open_list, F.coalesce(F.col(name), empty)).otherwise(empty)
        )
    return joined.withColumn(
        "ceilings", F.when(F.col("lowest_ceiling").isNotNull(), F.col("ceilings"))
    )


def decide_with_boundary_quality(
    corridors: DataFrame,
    objects: DataFrame,
    zones: DataFrame,
    protected: DataFrame,
    header: DataFrame,
    guards: DataFrame,
    snapshots: DataFrame,
) -> DataFrame:
    """Verdicts per corridor and boundary layer, downgraded where boundaries are doubtful.

    `guards` are boundary records with quality, guard and object_id; `snapshots` has one
    row per (package, layer): boundary_revision, boundary_space, coverage geom,
    coverage_confirmed. Corridors carry expected_boundary_revision. A package without a
    snapshot has one verdict per corridor, under a null layer, of unknown coverage. A
    boundary record near a corridor that carries the id of a known object is an error of
    that corridor and layer.
    """
    keys = ["package_id", "layer", "corridor_id"]
    requests = admitted(corridors, headed(header)).join(
        snapshots.withColumnRenamed("geom", "coverage").withColumn("has_snapshot", F.lit(True)),
        "package_id",
        "left",
    )
    has_snapshot = F.coalesce(F.col("has_snapshot"), F.lit(False))
    stale = (F.col("entry_code") == "INPUT_REVISION_CHANGED") | (
        has_snapshot & ~F.col("expected_boundary_revision").eqNullSafe(F.col("boundary_revision"))
    )
    requests = requests.withColumn(
        "entry_code",
        F.when(F.coalesce(stale, F.lit(False)), "INPUT_REVISION_CHANGED").when(
            F.col("entry_code").isNotNull()
            | (has_snapshot & ~F.col("boundary_space").eqNullSafe(F.col("snapshot_space"))),
            "COORDINATE_SPACE_MISMATCH",
        ),
    )
    live = (
        requests.filter("entry_code IS NULL")
        .select("package_id", "corridor_id", "geom", "radius", *DISTANCES)
        .dropDuplicates(["package_id", "corridor_id"])
    )

    hits = stored(oc.corridor_hits(live, objects, protected, guards), "hits")
    # Ids of guards met that a known object carries too. Only ids are compared.
    ids = hits.filter("tag = 'boundary'").select("package_id", F.col("id").alias("object_id"))
    taken = objects.select("package_id", "object_id").join(ids, ["package_id", "object_id"], "left_semi")
    roles = (
        hit_roles(hits, objects, zones, guards)
        .withColumn("taken", F.lit(False))
        .unionByName(
            taken.selectExpr("package_id", "'boundary' AS tag", "object_id AS id", "string(NULL) AS role", "true AS taken")
        )
        # Records that share an id get the least favourable role of theirs.
        .groupBy("package_id", "tag", "id")
        .agg(F.max("role").alias("role"), F.bool_or("taken").alias("taken"))
    )
    items = hits.join(roles, ["package_id", "tag", "id"], "left").withColumn(
        "degraded", F.col("quality") != "VALID_PLANAR_SOURCE"
    )
    boundary_items = items.filter("tag = 'boundary'").withColumn(
        "taken", F.col("taken") & F.col("role").isNotNull()
    )
    role = F.col("role")
    boundary = boundary_items.groupBy(*keys).agg(
        F.count_if(role.isin("mandatory", "unresolved")).alias("b_mandatory"),
        F.count_if(role == "demolition").alias("b_demolition"),
        F.count_if(role == "unresolved").alias("b_unresolved"),
        F.count_if("degraded").alias("b_degraded"),
        F.count_if(F.col("degraded") & role.isin("mandatory", "unresolved")).alias("b_both"),
        F.count_if(F.col("degraded") & (role == "demolition")).alias("b_kept"),
        F.bool_or(F.coalesce("taken", F.lit(False))).alias("b_taken"),
    )
    core = conflict_rollup(
        items.filter("tag != 'boundary'").withColumnRenamed("id", "object_id"), protected_met()
    )
    facts = (
        requests.drop("geom", "coverage")
        .join(core, ["package_id", "corridor_id"], "left")
        .join(boundary, keys, "left")
        .join(oc.unlocatable_counts(guards), ["package_id", "layer"], "left")
        .join(oc.coverage_of_envelopes(live, snapshots), keys, "left")
    )

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    # Boundary guards enter the core cascade as objects of unknown level.
    facts = facts.withColumns(
        {
            "entry_code": F.coalesce(
                "entry_code", F.when(F.col("b_taken"), F.lit("SOURCE_OBJECT_COLLISION"))
            ),
            "n_mandatory": n("n_mandatory") + n("b_mandatory"),
            "n_demolition": n("n_demolition") + n("b_demolition"),
            "n_unresolved": n("n_unresolved") + n("b_unresolved"),
            "n_level_unknown": n("n_level_unknown") + n("b_mandatory"),
        }
    )
    base = cascade(facts)
    degraded = n("b_degraded") + n("unlocatable")
    answered = F.col("entry_code").isNotNull()
    protected_hit = n("n_protected") > 0
    unknown_cover = ~(
        F.coalesce(F.col("coverage_confirmed"), F.lit(False))
        & F.coalesce(F.col("covered"), F.lit(False))
    )
    infeasible = F.col("status") == "no_feasible_solution"
    tunnel_asset = F.array_contains("asset_modes", "tunnel")
    step = (
        F.when(answered, "entry")
        .when(infeasible, "infeasible")
        .when(unknown_cover, "coverage")
        .when(n("unlocatable") > 0, "unlocatable")
        .when(degraded > 0, "degraded")
        .otherwise("base")
    )
    base = base.withColumns({"step": step, "_degraded": degraded, "_tunnel": tunnel_asset})
    step = F.col("step")
    shut = step.isin("coverage", "unlocatable")
    review = step == "degraded"
    both = F.when(protected_hit, F.lit(0)).otherwise(n("b_both"))
    return base.select(
        *keys,
        F.col("revision").alias("input_revision"),
        F.when(shut, "data_insufficient")
        .when(review & F.col("_tunnel"), "data_insufficient")
        .when(review, "no_feasible_solution")
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(F.col("reason") == "INPUT_REVISION_CHANGED", "BOUNDARY_OR_INPUT_REVISION_CHANGED")
        .when(step == "coverage", "BOUNDARY_COVERAGE_UNKNOWN")
        .when(step == "unlocatable", "UNLOCATABLE_BOUNDARY_RETAINED")
        .when(review & F.col("_tunnel"), "DEGRADED_BOUNDARY_REVIEW_REQUIRED")
        .when(review, "TUNNEL_ASSET_UNSUPPORTED")
        .otherwise(F.col("reason"))
        .alias("reason"),
        F.when(shut | (review & ~F.col("_tunnel")), no_modes())
        .when(review, tunnel_only())
        .otherwise(F.col("permitted_modes"))
        .alias("permitted_modes"),
        F.when(step.isin("entry", "base"), F.col("n_mandatory"))
        .otherwise(F.col("n_mandatory") + F.col("_degraded") - both)
        .cast("long")
        .alias("n_mandatory"),
        F.when(step.isin("entry", "base") | protected_hit, F.col("n_demolition"))
        .otherwise(F.col("n_demolition") - n("b_kept"))
        .cast("long")
        .alias("n_demolition"),
        F.col("n_unresolved").cast("long").alias("n_unresolved"),
        F.when(review, F.lit(None)).otherwise(F.col("lowest_ceiling")).alias("lowest_ceiling"),
        (review | F.col("lower_only")).alias("lower_only"),
    )
