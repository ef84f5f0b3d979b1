import itertools
import random

import pytest
from pyspark.sql import functions as F

from platwork.functions import geometry as geo
from platwork.functions import rules as fr
from platwork.model import GEOMETRY
from platwork.operators import conflicts as oc
from platwork.operators import quality as oq
from platwork.operators.pairs import bbox_pairs
from tests import shapes as sh


def test_bin_pairs_equal_plain_range_join(spark):
    rng = random.Random(7)

    def boxes(n):
        rows = []
        for i in range(n):
            # A third of all boxes crowd one spot; sizes span four orders of magnitude.
            x, y = (1.0, 1.0) if i % 3 == 0 else (rng.uniform(-500, 500), rng.uniform(-500, 500))
            w, h = (10 ** rng.uniform(-2, 2.5) for _ in range(2))
            rows.append((1, i, (x, y, x + w, y + h)))
        return rows

    a, b = boxes(150), boxes(170)
    schema = "package_id int, {0} int, {0}_box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    left = spark.createDataFrame(a, schema.format("a"))
    right = spark.createDataFrame(b, schema.format("b"))
    got = [(r.a, r.b) for r in bbox_pairs(left, right, "a_box", "b_box").collect()]
    want = {
        (i, j)
        for (_, i, p), (_, j, q) in itertools.product(a, b)
        if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    }
    assert len(got) == len(set(got)) and set(got) == want


def zones(spark, **shapes):
    rows = [("p", k, g, "residential", 10.0, 10.0, allow) for k, (g, allow) in shapes.items()]
    return spark.createDataFrame(
        rows,
        f"package_id string, zone_id string, geom {GEOMETRY}, land_use string, block_w double, "
        "block_h double, allow_demolition boolean",
    )


def features(spark, **shapes):
    return spark.createDataFrame(
        [("p", k, g) for k, g in shapes.items()], f"package_id string, object_id string, geom {GEOMETRY}"
    )


def test_association_across_zones_takes_strictest_permission(spark):
    table = zones(spark, a=(sh.box(0, 0, 2, 2), True), b=(sh.box(2, 0, 4, 2), False))
    shapes = features(
        spark, over=sh.box(1, 0.5, 3, 1.5), edge=sh.point(2, 1), out=sh.point(9, 9), within=sh.box(0.5, 0.5, 1, 1)
    )
    pairs = oc.feature_zone_pairs(shapes, table, "object_id")
    rows = {r.object_id: r for r in oc.permission_rollup(shapes, pairs, "object_id").collect()}
    for name in ("over", "edge"):
        assert (rows[name].first_zone, rows[name].last_zone) == ("a", "b")
        assert not rows[name].allow_demolition
    assert rows["within"].allow_demolition and rows["within"].zone_count == 1
    assert rows["out"].association == "pending" and not rows["out"].allow_demolition


def multi(*shapes):
    return ("polygon", False, [g[2][0] for g in shapes])


@pytest.mark.parametrize(
    "a,b,area",
    [
        (sh.box(0, 0, 2, 2), sh.box(1, 1, 3, 3), 1.0),
        (sh.box(0, 0, 4, 4), sh.polygon([(0, 0), (4, 0), (0, 4), (0, 0)]), 8.0),
        (sh.box(0, 0, 2, 2), sh.box(2, 0, 4, 2), 0.0),
        (sh.polygon([(0, 0), (4, 4), (0, 4), (0, 0)]), sh.polygon([(0, 0), (4, 0), (0, 4), (0, 0)]), 4.0),
        (
            sh.polygon([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]),
            sh.box(0, 0, 2, 4),
            6.0,
        ),
        (multi(sh.box(0, 0, 1, 1), sh.box(5, 5, 7, 7)), sh.box(4, 4, 8, 8), 4.0),
    ],
)
def test_intersection_area(spark, a, b, area):
    row = oc.feature_zone_pairs(features(spark, f=a), zones(spark, z=(b, True)), "object_id").first()
    assert row.common_area == pytest.approx(area, abs=1e-12)


def test_shape_in_hole_does_not_meet(spark):
    ring = sh.polygon([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (7, 2), (7, 7), (2, 7), (2, 2)])
    table = zones(spark, z=(ring, True))
    shapes = features(spark, hole=sh.box(4, 4, 5, 5), body=sh.box(0.5, 0.5, 1, 1), touch=sh.box(6, 4, 7, 5))
    got = {r.object_id for r in oc.feature_zone_pairs(shapes, table, "object_id").collect()}
    assert got == {"body", "touch"}


def test_second_part_inside_is_found(spark):
    shape = multi(sh.box(50, 50, 51, 51), sh.box(2, 2, 3, 3))
    table = zones(spark, z=(sh.box(0, 0, 9, 9), True))
    assert oc.feature_zone_pairs(features(spark, f=shape), table, "object_id").count() == 1


def test_zones_may_touch_but_not_overlap(spark):
    good = zones(spark, a=(sh.box(0, 0, 2, 2), True), b=(sh.box(2, 0, 4, 2), True))
    bad = zones(spark, a=(sh.box(0, 0, 2, 2), True), b=(sh.box(1.5, 0, 4, 2), True))
    assert oc.zone_overlaps(good).count() == 0
    assert oc.zone_overlaps(bad).first().common_area == pytest.approx(1.0)


def test_measures(spark):
    row = (
        sh.records(spark, {"t": sh.polygon([(0, 0), (3, 0), (0, 4), (0, 0)])})
        .select(
            F.expr(geo.area("geom")).alias("area"), F.expr(geo.length(geo.edges_of("geom"))).alias("len")
        )
        .first()
    )
    assert (row.area, row.len) == (6.0, 12.0)


SHAPES = {
    "box": (sh.box(0, 0, 2, 2), True),
    "bowtie": (sh.BOWTIE, False),
    "collapsed": (sh.polygon([(0, 0), (1, 1), (1, 2), (1, 1), (0, 0)]), False),
    "spike": (sh.polygon([(0, 0), (2, 0), (2, 2), (1, 1), (2, 2), (0, 2), (0, 0)]), False),
    "hole": (
        sh.polygon([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (7, 2), (7, 7), (2, 7), (2, 2)]),
        True,
    ),
    "hole_outside": (
        sh.polygon([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)]),
        False,
    ),
    "hole_touching_once": (
        sh.polygon([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 4), (3, 3), (3, 5), (0, 4)]),
        True,
    ),
    "hole_touching_twice": (
        sh.polygon([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 4), (4, 3), (9, 4), (4, 5), (0, 4)]),
        False,
    ),
    "hole_across": (
        sh.polygon([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(3, 1), (6, 1), (6, 3), (3, 3), (3, 1)]),
        False,
    ),
    "parts_apart": (multi(sh.box(0, 0, 1, 1), sh.box(3, 3, 4, 4)), True),
    "parts_touch": (multi(sh.box(0, 0, 1, 1), sh.box(1, 1, 2, 2)), True),
    "parts_overlap": (multi(sh.box(0, 0, 2, 2), sh.box(1, 1, 3, 3)), False),
    "parts_nested": (multi(sh.box(0, 0, 9, 9), sh.box(1, 1, 3, 3)), False),
    "open": (("polygon", False, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]]), False),
    "ring_touching_itself": (
        sh.polygon([(0, 0), (2, 2), (0, 4), (4, 4), (2, 2), (4, 0), (0, 0)]),
        False,
    ),
    "line": (sh.line((0, 0), (1, 1)), True),
    "dot_line": (sh.line((1, 1), (1, 1)), False),
    "repeat_vertex": (sh.polygon([(0, 0), (2, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), True),
}


def test_validity(spark):
    rows = oq.with_validity(sh.records(spark, {k: g for k, (g, _) in SHAPES.items()})).collect()
    assert {r.source_record_id: r.is_valid for r in rows} == {k: v for k, (_, v) in SHAPES.items()}


def test_review_statuses(spark):
    names = ("bowtie", "collapsed", "spike", "dot_line", "box")
    table = oq.with_validity(sh.records(spark, {k: SHAPES[k][0] for k in names}))
    rows = {r.source_record_id: r for r in oq.repair_review(table).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "bowtie": "POLYGON_CANDIDATE",
        "collapsed": "COLLAPSED_REVIEW",
        "spike": "MIXED_DIMENSION_REVIEW",
        "dot_line": "UNSUPPORTED_REVIEW",
    }
    assert (rows["bowtie"].source_area, rows["bowtie"].candidate_area) == (0.0, 8.0)
    assert not any(r.physical_envelope_accepted for r in rows.values())


def test_two_quality_orders_differ(spark):
    odd = {
        "null": None,
        "empty": ("polygon", False, []),
        "z_bowtie": sh.BOWTIE[:1] + (True,) + sh.BOWTIE[2:],
        "z": sh.box(0, 0, 1, 1, has_z=True),
        "inf": sh.line((0, 0), (float("inf"), 1)),
        "line": sh.line((0, 0), (1, 1)),
        "ok": sh.box(0, 0, 1, 1),
    }
    table = oq.with_validity(sh.records(spark, odd))
    rows = table.select(
        "source_record_id", F.expr(oq.scan_quality()).alias("scan"), F.expr(oq.source_quality()).alias("source")
    ).collect()
    scan = {r.source_record_id: r.scan for r in rows}
    source = {r.source_record_id: r.source for r in rows}
    assert (scan["z_bowtie"], source["z_bowtie"]) == ("invalid_geometry", "Z_GEOMETRY_UNVERIFIED")
    assert source == {
        "null": "NULL_GEOMETRY",
        "empty": "EMPTY_GEOMETRY",
        "z_bowtie": "Z_GEOMETRY_UNVERIFIED",
        "z": "Z_GEOMETRY_UNVERIFIED",
        "inf": "NONFINITE_GEOMETRY",
        "line": "UNSUPPORTED_FOOTPRINT",
        "ok": "VALID_PLANAR_SOURCE",
    }


def test_guard_is_the_whole_box(spark):
    table = oq.with_validity(sh.records(spark, {"b": sh.BOWTIE, "n": None}))
    guards = oc.boundary_guards(table.withColumn("quality", F.expr(oq.source_quality())))
    rows = {
        r.source_record_id: r.b
        for r in guards.select("source_record_id", F.expr(geo.bbox_of("guard")).alias("b")).collect()
    }
    assert tuple(rows["b"]) == (0.0, 0.0, 4.0, 4.0) and rows["n"] is None


def test_corridor_rules(spark):
    rows = [
        ("p", "c", "s", sh.line((0, 0), (1, 1)), 1.0, "surface", ["surface"], None),
        ("p", " ", "s", sh.line((0, 0), (0, 0)), 0.0, "rope", [], float("nan")),
    ]
    df = spark.createDataFrame(
        rows,
        f"package_id string, corridor_id string, space_id string, geom {GEOMETRY}, radius double, "
        "requested_mode string, asset_modes array<string>, minimum_z double",
    )
    codes = [r[0] for r in df.orderBy(F.desc("corridor_id")).select(fr.corridor_rules()).collect()]
    assert codes[0] == []
    assert codes[1] == ["INVALID_ID", "INVALID_GEOMETRY", "INVALID_ENVELOPE", "INVALID_ASSET", "INVALID_NUMBER"]


def _outline(n, radius, shift=0.0):
    import math

    points = [
        (shift + (radius + (i % 2) * 0.5) * math.cos(2 * math.pi * i / n), (radius + (i % 2) * 0.5) * math.sin(2 * math.pi * i / n))
        for i in range(n)
    ]
    return sh.polygon([*points, points[0]])


def test_two_outlines_of_many_vertices(spark):
    shapes = features(spark, f=_outline(5000, 40.0), far=_outline(5000, 40.0, 500.0)).withColumn("is_valid", F.lit(True))
    table = zones(spark, z=(_outline(5000, 40.0, 30.0), True), around=(sh.box(-1000, -1000, 1000, 1000), True))
    table = table.withColumn("is_valid", F.lit(True))
    got = {(r.object_id, r.zone_id): r.common_area for r in oc.feature_zone_pairs(shapes, table, "object_id").collect()}
    own = spark.createDataFrame([(_outline(5000, 40.0),)], f"geom {GEOMETRY}").select(F.expr(geo.area("geom"))).first()[0]
    assert set(got) == {("f", "z"), ("f", "around"), ("far", "around")}
    assert got["f", "around"] == pytest.approx(own, rel=1e-9) and 0.4 * own < got["f", "z"] < 0.6 * own


def test_invalid_objects_and_zones_match_nothing(spark):
    """Without a column that says so, validity is found out."""
    twisted = sh.polygon([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)])
    table = zones(spark, good=(sh.box(-9, -9, 0.5, 9), True), bad=(twisted, True))
    shapes = features(spark, sound=sh.box(0, 1, 0.25, 2), bow=twisted, point=sh.point(0.1, 1.5))
    found = {(r.object_id, r.zone_id) for r in oc.feature_zone_pairs(shapes, table, "object_id").collect()}
    assert found == {("sound", "good"), ("point", "good")}
    rows = {r.object_id: r for r in oc.object_resolution(shapes, table).collect()}
    assert rows["sound"].resolved and not rows["bow"].resolved and not rows["point"].resolved


def validity(spark, *rings):
    rows = [("p", "l", "r", sh.polygon(*rings))]
    df = spark.createDataFrame(rows, f"package_id string, layer string, source_record_id string, geom {GEOMETRY}")
    return oq.with_validity(df).first().is_valid


def _ring(*points):
    return [*points, points[0]]


def test_rings_that_close_a_loop_cut_the_inside(spark):
    shell = _ring((0, 0), (20, 0), (20, 20), (0, 20))
    one, two = _ring((4, 4), (8, 4), (6, 8)), _ring((8, 4), (12, 4), (10, 8))
    three = _ring((6, 8), (10, 8), (8, 12))
    assert validity(spark, shell, one, two) and validity(spark, shell, one)
    assert not validity(spark, shell, one, two, three)
    # Through the shell: two holes that touch each other and the border.
    assert not validity(spark, shell, _ring((0, 5), (5, 5), (5, 8)), _ring((5, 5), (10, 0), (12, 5)))
    assert validity(spark, shell, _ring((0, 5), (5, 5), (5, 8)), _ring((5, 5), (10, 1), (12, 5)))


def test_many_rings(spark):
    holes = [_ring((x, y), (x + 1, y), (x + 0.5, y + 1)) for x in range(1, 41, 2) for y in range(1, 21, 2)]
    shell = _ring((0, 0), (50, 0), (50, 30), (0, 30))
    assert len(holes) == 200 and validity(spark, shell, *holes)
    assert not validity(spark, shell, *holes, _ring((1.4, 1.2), (1.6, 1.2), (1.5, 1.4)))


def review(spark, *rings):
    rows = [("p", "l", "r", sh.polygon(*rings), False)]
    df = spark.createDataFrame(
        rows, f"package_id string, layer string, source_record_id string, geom {GEOMETRY}, is_valid boolean"
    )
    return oq.repair_review(df).first()


def test_even_odd_area_of_doubtful_rings(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    twice = review(spark, [*square, *square, square[0]])
    assert (twice.status, twice.candidate_area) == ("POLYGON_CANDIDATE", 16.0)
    spike = review(spark, _ring((0, 0), (2, 0), (2, 2), (1, 1), (2, 2), (0, 2)))
    assert (spike.status, spike.candidate_area) == ("MIXED_DIMENSION_REVIEW", 4.0)
    flat = review(spark, _ring((0, 0), (1, 1), (1, 2), (1, 1)))
    assert (flat.status, flat.candidate_area) == ("COLLAPSED_REVIEW", 0.0)
    bow = review(spark, _ring((0, 0), (4, 4), (4, 0), (0, 4)))
    assert (bow.status, bow.candidate_area) == ("POLYGON_CANDIDATE", 8.0)
    # An inner square drawn twice is a hole, drawn once as well.
    inner = [(1, 1), (2, 1), (2, 2), (1, 2)]
    hole = review(spark, _ring(*square), [*inner, *inner, inner[0]])
    assert (hole.status, hole.candidate_area) == ("POLYGON_CANDIDATE", 15.0)


def test_even_odd_area_of_a_record_of_very_many_edges(spark):
    n = 20_000
    star = _outline(n, 500.0)[2][0][0]
    edges = spark.createDataFrame(
        [("p", "l", "r", *sorted((a, b))) for a, b in zip(star, star[1:])],
        "package_id string, layer string, source_record_id string, start struct<x:double,y:double>, end struct<x:double,y:double>",
    )
    own = spark.createDataFrame([(_outline(n, 500.0),)], f"geom {GEOMETRY}").select(F.expr(geo.area("geom"))).first()[0]
    assert oq.even_odd_area(edges).first().even_odd_area == pytest.approx(own, rel=1e-9)
