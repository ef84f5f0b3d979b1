import pytest
from pyspark.sql import functions as F

from platwork.model import GEOMETRY
from platwork.operators import conflicts as oc
from platwork.operators import quality as oq
from platwork.plans import decisions as pd
from tests import shapes as sh

LINE = sh.line((0, 50), (100, 50))
ZONE = sh.box(0, 0, 100, 100)
B1 = sh.box(40, 40, 60, 60)
ALL = ["surface", "elevated", "tunnel"]


def corridors(*rows, package="p"):
    """rows: id, modes, requested, minimum_z, expected_revision, space, geom."""
    full = [
        (package, c, space, geom, 2.0, requested, modes, minimum, rev, "b1")
        for c, modes, requested, minimum, rev, space, geom in rows
    ]
    return (
        full,
        f"package_id string, corridor_id string, space_id string, geom {GEOMETRY}, radius double, "
        "requested_mode string, asset_modes array<string>, minimum_z double, expected_revision string, "
        "expected_boundary_revision string",
    )


def one(c="c", modes=ALL, requested="surface", minimum=None, rev="r1", space="m", geom=LINE):
    return (c, modes, requested, minimum, rev, space, geom)


def objects(*rows, package="p"):
    return (
        [(package, *r) for r in rows],
        f"package_id string, object_id string, geom {GEOMETRY}, ground_z double, foundation_z double",
    )


def zones(*rows, package="p"):
    return (
        [(package, *r) for r in rows],
        f"package_id string, zone_id string, geom {GEOMETRY}, allow_demolition boolean",
    )


def protected(*shapes, package="p"):
    return (
        [(package, str(i), g) for i, g in enumerate(shapes)],
        f"package_id string, area_id string, geom {GEOMETRY}",
    )


def header(complete=True, control=0.0, package="p"):
    return (
        [(package, "r1", "m", complete, "v", control, 3.0, 2.0, 4.0)],
        "package_id string, revision string, space_id string, existing_data_complete boolean, "
        "rules_version string, control_buffer double, minimum_cover double, foundation_clearance double, "
        "outer_height double",
    )


def tables(name, corridor=None, objs=(("b1", B1, 100.0, 95.0),), zs=(("z", ZONE, False),), areas=(), **head):
    """Rows and schemas of one case's requests and snapshot tables, as package `name`."""
    return (
        corridors(corridor or one(), package=name),
        objects(*objs, package=name),
        zones(*zs, package=name),
        protected(*areas, package=name),
        header(package=name, **head),
    )


def stacked(spark, parts):
    """Many cases as packages of one lake: decided together, kept apart by package."""
    return [
        spark.createDataFrame([row for rows, _ in column for row in rows], column[0][1])
        for column in zip(*parts)
    ]


NEAR = (("b1", sh.box(40, 53, 60, 60), 100.0, 95.0),)

CASES = {
    "stale": (dict(corridor=one(rev="r0")), "stale_input", "INPUT_REVISION_CHANGED", []),
    "foreign": (dict(corridor=one(space="x")), "error", "COORDINATE_SPACE_MISMATCH", []),
    "protected": (
        dict(areas=(sh.box(10, 51, 12, 53),)), "no_feasible_solution", "HARD_PROTECTION_CONFLICT", [],
    ),
    "no_tunnel": (
        dict(corridor=one(modes=["surface"])), "no_feasible_solution", "TUNNEL_ASSET_UNSUPPORTED", [],
    ),
    "incomplete": (
        dict(complete=False), "data_insufficient", "EXISTING_COVERAGE_OR_ZONES_UNKNOWN", ["tunnel"],
    ),
    "incomplete_free": (
        dict(objs=(), complete=False), "data_insufficient", "EXISTING_COVERAGE_OR_ZONES_UNKNOWN",
        ["elevated", "surface", "tunnel"],
    ),
    "unzoned": (
        dict(zs=(("z", sh.box(0, 0, 50, 100), True),)), "data_insufficient",
        "EXISTING_COVERAGE_OR_ZONES_UNKNOWN", ["tunnel"],
    ),
    "wrong_mode": (
        dict(objs=(), corridor=one(modes=["tunnel"])), "no_feasible_solution",
        "REQUESTED_MODE_UNSUPPORTED", [],
    ),
    "clear": (
        dict(zs=(("z", ZONE, True),)), "policy_clear", "NO_NON_DEMOLISHABLE_CONFLICT",
        ["elevated", "surface", "tunnel"],
    ),
    "no_levels": (
        dict(objs=(("b1", B1, None, None),)), "data_insufficient", "UNDERGROUND_ENVELOPE_MISSING", ["tunnel"],
    ),
    "tunnel": (dict(), "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"]),
    "high_request": (
        dict(corridor=one(requested="elevated")), "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"],
    ),
    "too_deep": (
        dict(corridor=one(minimum=91.5)), "no_feasible_solution", "UNDERGROUND_DEPTH_RANGE_EMPTY", [],
    ),
    "just_deep_enough": (
        dict(corridor=one(minimum=91.0)), "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"],
    ),
    "outside_control": (
        dict(objs=NEAR), "policy_clear", "NO_NON_DEMOLISHABLE_CONFLICT", ["elevated", "surface", "tunnel"],
    ),
    "inside_control": (
        dict(objs=NEAR, control=2.0), "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"],
    ),
    # Contact at exactly radius plus control distance counts.
    "at_control": (
        dict(objs=NEAR, control=1.0), "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"],
    ),
    "starts_inside": (
        dict(corridor=one(geom=sh.line((50, 50), (51, 51))), objs=(("b", ZONE, 100.0, 95.0),)),
        "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"],
    ),
    # Nothing is cleared on account of an invalid shape.
    "twisted_object": (
        dict(objs=(("b1", sh.polygon([(40, 40), (60, 60), (60, 40), (40, 60), (40, 40)]), 100.0, 95.0),), zs=(("z", ZONE, True),)),
        "data_insufficient", "EXISTING_COVERAGE_OR_ZONES_UNKNOWN", ["tunnel"],
    ),
    "twisted_zone": (
        dict(zs=(("z", sh.polygon([(0, 0), (100, 100), (100, 0), (0, 100), (0, 0)]), True),)),
        "data_insufficient", "EXISTING_COVERAGE_OR_ZONES_UNKNOWN", ["tunnel"],
    ),
    "touching_neighbour_forbids": (
        dict(zs=(("a", sh.box(0, 0, 100, 60), True), ("b", sh.box(0, 60, 100, 99), False))),
        "tunnel_required", "LOWER_ONLY_NO_OVERPASS", ["tunnel"],
    ),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    parts = [tables(name, **given) for name, (given, *_) in CASES.items()]
    rows = pd.decide_conflicts(*stacked(spark, parts)).collect()
    assert len(rows) == len(CASES)
    return {r.package_id: r for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_policy_cases(verdicts, name):
    _, status, reason, modes = CASES[name]
    row = verdicts[name]
    assert (row.status, row.reason, row.permitted_modes) == (status, reason, modes)


def test_exact_ceiling_and_large_object(verdicts):
    assert verdicts["tunnel"].lowest_ceiling == 91.0 and verdicts["tunnel"].lower_only
    assert verdicts["starts_inside"].n_mandatory == 1


def test_lists(spark):
    requests, objs, zs, areas, head = stacked(spark, [tables("p")])
    items = pd.conflict_items(requests, objs, zs, head)
    lists = pd.decision_lists(pd.decide_conflicts(requests, objs, zs, areas, head), items).first()
    assert lists.mandatory_ids == ["b1"] and lists.demolition_ids == []
    assert [tuple(c) for c in lists.ceilings] == [("b1", 91.0)]


def test_more_protection_never_allows_more(spark):
    lines = [one(c=f"c{i}", geom=sh.line((0, i * 7), (100, i * 7))) for i in range(14)]
    parts = [
        (
            corridors(*lines, package=name),
            objects(("b1", B1, 100.0, 95.0), package=name),
            zones(("z", ZONE, False), package=name),
            protected(*areas, package=name),
            header(package=name),
        )
        for name, areas in (("before", ()), ("after", (sh.box(0, 0, 50, 30),)))
    ]
    modes = {"before": {}, "after": {}}
    for row in pd.decide_conflicts(*stacked(spark, parts)).collect():
        modes[row.package_id][row.corridor_id] = set(row.permitted_modes)
    assert all(modes["after"][c] <= modes["before"][c] for c in modes["before"])
    assert any(modes["after"][c] < modes["before"][c] for c in modes["before"])


def boundary_tables(
    name, shapes, corridor=None, confirmed=True, coverage=sh.box(-100, -100, 200, 200),
    objs=(), zs=(("z", ZONE, True),), areas=(),
):
    shapes = shapes or {"far": sh.box(0, 150, 5, 160)}
    records = (
        [(name, "roads", key, geom) for key, geom in shapes.items()],
        f"package_id string, layer string, source_record_id string, geom {GEOMETRY}",
    )
    snapshots = (
        [(name, "roads", "b1", "m", coverage, confirmed)],
        f"package_id string, layer string, boundary_revision string, boundary_space string, geom {GEOMETRY}, "
        "coverage_confirmed boolean",
    )
    return (*tables(name, corridor, objs, zs, areas), records, snapshots)


TWISTED = sh.polygon([(40, 40), (60, 60), (60, 40), (40, 60), (40, 40)])

QUALITY_CASES = {
    "degraded": (dict(shapes={"1": TWISTED}), "data_insufficient", "DEGRADED_BOUNDARY_REVIEW_REQUIRED", ["tunnel"]),
    "degraded_no_tunnel": (
        dict(shapes={"1": TWISTED}, corridor=one(modes=["surface"])),
        "no_feasible_solution", "TUNNEL_ASSET_UNSUPPORTED", [],
    ),
    "lost": (dict(shapes={"1": None}), "data_insufficient", "UNLOCATABLE_BOUNDARY_RETAINED", []),
    "unconfirmed": (dict(shapes={}, confirmed=False), "data_insufficient", "BOUNDARY_COVERAGE_UNKNOWN", []),
    "uncovered": (
        dict(shapes={}, coverage=sh.box(-1, -100, 200, 200)), "data_insufficient", "BOUNDARY_COVERAGE_UNKNOWN", [],
    ),
    "far_away": (
        dict(shapes={"1": sh.box(0, 150, 5, 160)}), "policy_clear", "NO_NON_DEMOLISHABLE_CONFLICT",
        ["elevated", "surface", "tunnel"],
    ),
    "valid_forbidden": (
        dict(shapes={"1": B1}, zs=(("z", ZONE, False),)), "data_insufficient", "UNDERGROUND_ENVELOPE_MISSING", ["tunnel"],
    ),
    "valid_demolishable": (
        dict(shapes={"1": B1}), "policy_clear", "NO_NON_DEMOLISHABLE_CONFLICT", ["elevated", "surface", "tunnel"],
    ),
    "infeasible_stays": (
        dict(shapes={"1": None}, areas=(sh.box(10, 49, 12, 53),)), "no_feasible_solution", "HARD_PROTECTION_CONFLICT", [],
    ),
    "stale": (
        dict(shapes={"1": TWISTED}, corridor=one(rev="r0")), "stale_input", "BOUNDARY_OR_INPUT_REVISION_CHANGED", [],
    ),
}


@pytest.fixture(scope="module")
def quality_verdicts(spark):
    parts = [boundary_tables(name, **given) for name, (given, *_) in QUALITY_CASES.items()]
    *core, records, snapshots = stacked(spark, parts)
    graded = oq.with_validity(records).withColumn("quality", F.expr(oq.source_quality()))
    guards = oc.boundary_guards(graded).withColumn(
        "object_id", F.expr(oq.object_identity("layer", "'b1'", "source_record_id"))
    )
    rows = pd.decide_with_boundary_quality(*core, guards, snapshots).collect()
    return {r.package_id: r for r in rows}


@pytest.mark.parametrize("name", QUALITY_CASES)
def test_boundary_quality_cases(quality_verdicts, name):
    _, status, reason, modes = QUALITY_CASES[name]
    row = quality_verdicts[name]
    assert (row.status, row.reason, row.permitted_modes) == (status, reason, modes)


def test_degraded_record_becomes_mandatory(quality_verdicts):
    row = quality_verdicts["degraded"]
    assert (row.n_mandatory, row.n_demolition, row.lower_only) == (1, 0, True)


def test_an_id_that_an_object_carries_is_an_error(spark):
    identity = spark.range(1).select(F.expr(oq.object_identity("'roads'", "'b1'", "'1'"))).first()[0]
    far = sh.box(0, 190, 5, 195)
    parts = [
        boundary_tables("clash", {"1": B1}, objs=((identity, far, 100.0, 95.0),)),
        boundary_tables("apart", {"1": B1}, objs=(("other", far, 100.0, 95.0),)),
        boundary_tables("away", {"1": far}, objs=((identity, far, 100.0, 95.0),)),
    ]
    *core, records, snapshots = stacked(spark, parts)
    graded = oq.with_validity(records).withColumn("quality", F.expr(oq.source_quality()))
    guards = oc.boundary_guards(graded).withColumn(
        "object_id", F.expr(oq.object_identity("layer", "'b1'", "source_record_id"))
    )
    rows = {r.package_id: r for r in pd.decide_with_boundary_quality(*core, guards, snapshots).collect()}
    clash = rows["clash"]
    assert (clash.status, clash.reason, clash.permitted_modes) == ("error", "SOURCE_OBJECT_COLLISION", [])
    assert rows["apart"].status == rows["away"].status == "policy_clear"


def test_a_package_without_boundary_snapshot_is_answered(spark):
    *core, records, snapshots = stacked(spark, [boundary_tables("a", {}), boundary_tables("b", {})])
    graded = oq.with_validity(records).withColumn("quality", F.expr(oq.source_quality()))
    guards = oc.boundary_guards(graded).withColumn(
        "object_id", F.expr(oq.object_identity("layer", "'b1'", "source_record_id"))
    )
    found = pd.decide_with_boundary_quality(*core, guards, snapshots.filter("package_id = 'a'"))
    rows = {r.package_id: r for r in found.collect()}
    assert rows["a"].status == "policy_clear"
    assert (rows["b"].status, rows["b"].reason) == ("data_insufficient", "BOUNDARY_COVERAGE_UNKNOWN")
    assert rows["b"].permitted_modes == []


def test_unsound_shapes_are_coded_and_permit_nothing(spark):
    shapes = {"good": B1, "lifted": sh.box(40, 40, 60, 60, has_z=True), "twisted": TWISTED}
    rows = [("p", k, g, k != "twisted") for k, g in shapes.items()]
    features = spark.createDataFrame(rows, f"package_id string, object_id string, geom {GEOMETRY}, is_valid boolean")
    zone = spark.createDataFrame(
        [("p", "z", ZONE, True)], f"package_id string, zone_id string, geom {GEOMETRY}, allow_demolition boolean"
    )
    pairs = oc.feature_zone_pairs(features, zone, "object_id")
    found = {r.object_id: r for r in oc.permission_rollup(features, pairs, "object_id").collect()}
    assert (found["good"].association, found["good"].allow_demolition, found["good"].code) == ("matched", True, None)
    for name in ("lifted", "twisted"):
        row = found[name]
        assert (row.association, row.allow_demolition, row.code) == ("pending", False, "INVALID_GEOMETRY")
