import math

import pytest
from pyspark.sql import functions as F

from platwork.functions import cells as cf
from platwork.operators import faces as of
from platwork.operators import grids as og
from platwork.plans.reports import water_face_report
from tests import shapes as sh

ND = -9999.0


def semantics(spark, land=False):
    return spark.createDataFrame(
        [(1, land, land, 0.0)],
        "package_id long, nodata_is_land boolean, complete_coverage_confirmed boolean, near_zero_m double",
    )


def account(spark, terrain, depth, grid_rows, land=False):
    grids = sh.grids(spark, *grid_rows)
    return og.align_depth(
        sh.cells(spark, "terrain", terrain), sh.cells(spark, "depth", depth), grids, semantics(spark, land)
    ).first()


ONES = [[1.0] * 4] * 4


def test_coarse_depth_on_fine_terrain(spark):
    row = account(spark, ONES, [[2, ND], [ND, 2]], [("terrain", 4, 4, 1, 0, 4), ("depth", 2, 2, 2, 0, 4)])
    assert (row.water, row.land, row.unknown) == (8, 0, 8)
    assert row.roi_m2 == 16 and row.conservation_code is None and not row.complete


def test_small_depth_grid_with_declared_land(spark):
    rows = [("terrain", 4, 4, 1, 0, 4), ("depth", 2, 2, 1, 0, 4)]
    row = account(spark, ONES, [[ND, ND], [ND, ND]], rows, land=True)
    assert (row.depth_outside, row.land, row.unknown) == (12, 4, 12)


def test_shifted_depth_grid(spark):
    rows = [("terrain", 4, 4, 1, 0, 4), ("depth", 2, 2, 1, 1, 3)]
    row = account(spark, ONES, [[2, 2], [2, 2]], rows)
    assert (row.water, row.depth_outside) == (4, 12)


def test_missing_terrain_is_not_complete(spark):
    rows = [("terrain", 2, 2, 1, 0, 2), ("depth", 2, 2, 1, 0, 2)]
    row = account(spark, [[1, ND], [1, 1]], [[2, 2], [2, 2]], rows)
    assert (row.terrain_missing, row.water, row.complete) == (1, 4, False)


def classes(spark, values, covered, land, band):
    rows = [(i, float(v), c) for i, (v, c) in enumerate(zip(values, covered))]
    df = spark.createDataFrame(rows, "i int, v float, c boolean")
    code = cf.classify_depth(
        F.col("v"), F.lit(255), F.col("c"), F.lit(ND), F.lit("float32"), F.lit(land), F.lit(band)
    )
    return [r[0] for r in df.orderBy("i").select(cf.class_label(code)).collect()]


@pytest.mark.parametrize(
    "values,covered,land,band,expected",
    [
        ([ND, 2, 0, -1], [True] * 4, False, 0.0, ["unknown", "water", "uncertain", "unknown"]),
        ([ND, ND, math.nan], [True, False, True], True, 0.0, ["land", "unknown", "unknown"]),
        ([0.001, 1, -0.001], [True] * 3, False, 0.01, ["uncertain", "water", "uncertain"]),
    ],
)
def test_classify_depth(spark, values, covered, land, band, expected):
    assert classes(spark, values, covered, land, band) == expected


def test_valid_pixels_compare_nodata_in_cell_type(spark):
    big = 1.70141e38
    values = [big, 0.0, -5.0, math.nan, math.inf, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v float")
    valid = cf.valid_pixels(F.col("v"), F.lit(255), F.lit(big), F.lit("float32"))
    assert [r[0] for r in df.orderBy("i").select(valid).collect()] == [
        False, True, True, False, False, True,
    ]


def test_integer_nodata_out_of_range_never_matches(spark):
    df = spark.createDataFrame([(0.0,), (255.0,)], "v double")
    for nodata, expected in ((-1.0, [False, False]), (0.5, [False, False]), (255.0, [False, True])):
        hit = cf.nodata_pixels(F.col("v"), F.lit(nodata), F.lit("uint8"))
        assert [r[0] for r in df.orderBy("v").select(hit).collect()] == expected


def test_pixel_area(spark):
    area = lambda a, b, d, e: spark.range(1).select(
        cf.pixel_area(F.lit(a), F.lit(b), F.lit(d), F.lit(e))
    ).first()[0]
    assert area(2.0, 1.0, 1.0, -3.0) == 7.0
    assert area(1.0, 1.0, 1.0, 1.0) is None


def test_raster_profile(spark):
    grids = sh.grids(spark, ("terrain", 2, 2, 1, 0, 2))
    row = og.raster_profile(sh.cells(spark, "terrain", [[1, ND], [0, -2]]), grids).first()
    assert (row.valid_pixels, row.valid_zero_pixels, row.valid_negative_pixels) == (3, 1, 1)
    assert (row.valid_min, row.valid_max) == (-2.0, 1.0)


def water(spark, faces, complete=True, coverage=sh.box(0, 0, 4, 4)):
    grids = sh.grids(spark, ("terrain", 4, 4, 1, 0, 4))
    rows = [(1, "water", str(i), g) for i, g in enumerate(faces)] + [(1, "coverage", "c", coverage)]
    from platwork.model import GEOMETRY

    table = spark.createDataFrame(rows, f"package_id long, role string, face_id string, geom {GEOMETRY}")
    facts = spark.createDataFrame(
        [(1, complete, "ft", "ref")],
        "package_id long, complete_coverage_confirmed boolean, vertical_unit string, vertical_reference string",
    )
    values = sh.cells(spark, "terrain", [[100.0] * 4] * 4)
    return water_face_report(values, grids, table, facts).first(), table


@pytest.mark.parametrize(
    "faces,complete,coverage,expected",
    [
        ([sh.box(0, 0, 2, 4)], True, sh.box(0, 0, 4, 4), (8, 8, 0)),
        ([sh.box(0, 0, 1, 4)], True, sh.box(0, 0, 2, 4), (4, 4, 8)),
        ([sh.box(0, 0, 2, 4)], False, sh.box(0, 0, 4, 4), (8, 0, 8)),
        ([], True, sh.box(0, 0, 4, 4), (0, 16, 0)),
        ([sh.box(0, 0, 2, 4), sh.box(1, 0, 3, 4)], True, sh.box(0, 0, 4, 4), (12, 4, 0)),
    ],
)
def test_water_faces(spark, faces, complete, coverage, expected):
    row, _ = water(spark, faces, complete, coverage)
    assert (row.water, row.land, row.unknown) == expected
    assert row.terrain_max_m == pytest.approx(30.48)


def test_face_wider_than_coverage(spark):
    row, table = water(spark, [sh.box(0, 0, 4, 4)], True, sh.box(0, 0, 2, 4))
    assert (row.water, row.unknown) == (8, 8)
    areas = of.union_coverage_clip(table).first()
    assert areas.outside_area == pytest.approx(8.0)


@pytest.mark.parametrize(
    "faces,coverage,expected",
    [
        # equal copies, shared borders, holes, a face inside another, contact from outside
        ([sh.box(0, 0, 4, 4), sh.box(0, 0, 4, 4)], sh.box(0, 0, 4, 4), (16, 16)),
        ([sh.box(0, 0, 2, 4), sh.box(2, 0, 4, 4)], sh.box(1, 1, 3, 3), (16, 4)),
        ([sh.box(0, 0, 4, 4), sh.box(1, 1, 2, 2)], sh.box(0, 0, 8, 8), (16, 16)),
        ([sh.box(4, 0, 6, 4)], sh.box(0, 0, 4, 4), (8, 0)),
        (
            [sh.polygon([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)])],
            sh.box(0, 0, 2, 4),
            (12, 6),
        ),
        ([sh.polygon([(0, 0), (4, 0), (0, 4), (0, 0)]), sh.box(1, 1, 5, 2)], sh.box(0, 0, 9, 9), (10.5, 10.5)),
    ],
)
def test_union_and_clip_area(spark, faces, coverage, expected):
    from platwork.model import GEOMETRY

    rows = [(1, "water", str(i), g) for i, g in enumerate(faces)] + [(1, "coverage", "c", coverage)]
    table = spark.createDataFrame(rows, f"package_id long, role string, face_id string, geom {GEOMETRY}")
    row = of.union_coverage_clip(table).first()
    assert (row.union_area, row.clipped_area) == pytest.approx(expected)


def test_fill_matches_brute_force_with_hole(spark):
    shape = sh.polygon(
        [(1.2, 0.3), (9.7, 2.1), (8.4, 9.6), (0.8, 7.7), (1.2, 0.3)],
        [(3.1, 3.2), (6.3, 3.9), (4.4, 6.8), (3.1, 3.2)],
    )
    from platwork.model import GEOMETRY

    faces = spark.createDataFrame(
        [(1, "water", "f", shape)], f"package_id long, role string, face_id string, geom {GEOMETRY}"
    )
    grids = sh.grids(spark, ("terrain", 80, 10, 1, 0, 10))

    def inside(x, y):
        odd = False
        for ring in shape[2][0]:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
        return odd

    want = {(r, c) for r in range(10) for c in range(80) if inside(c + 0.5, 10 - r - 0.5)}
    got = {(r.row, r.col) for r in of.polygon_to_cells(faces, grids).collect()}
    assert got == want and len(got) > 20


def test_gradient_of_a_plane(spark):
    grids = sh.grids(spark, ("terrain", 4, 4, 1, 0, 4))
    dem = [[4.0 * r + c for c in range(4)] for r in range(4)]
    rows = og.terrain_gradient(sh.cells(spark, "terrain", dem), grids).collect()
    assert {(r.dz_dx, r.dz_dy) for r in rows} == {(1.0, 4.0)} and len(rows) == 16


def test_clip_keeps_four_cells(spark):
    from platwork.model import GEOMETRY

    faces = spark.createDataFrame(
        [(1, "water", "f", sh.box(1, 1, 3, 3))],
        f"package_id long, role string, face_id string, geom {GEOMETRY}",
    )
    grids = sh.grids(spark, ("terrain", 4, 4, 1, 0, 4))
    values = sh.cells(spark, "terrain", [[4.0 * r + c for c in range(4)] for r in range(4)])
    assert sorted(r.value for r in of.clip_by_polygon(values, faces, grids).collect()) == [5, 6, 9, 10]


def test_bilinear_skips_nodata_and_widens_for_coarser_targets(spark):
    source = sh.grids(spark, ("terrain", 2, 1, 1, 0, 1))
    target = sh.grids(spark, ("terrain", 4, 2, 0.5, 0, 1))
    values = sh.cells(spark, "terrain", [[1.0, ND]])
    rows = og.resample_bilinear(values, source, target).collect()
    assert {r.value for r in rows} == {1.0}
    coarse = sh.grids(spark, ("terrain", 1, 1, 2, 0, 2))
    fine = sh.grids(spark, ("terrain", 2, 2, 1, 0, 2))
    row = og.resample_bilinear(sh.cells(spark, "terrain", [[1, 2], [3, 6]]), fine, coarse).first()
    assert row.value == pytest.approx(3.0)


def test_grids_without_cells_stay(spark):
    both = sh.grids(spark, ("terrain", 2, 2, 1, 0, 2), ("depth", 2, 2, 1, 0, 2))
    rows = {r.grid_id: r for r in og.raster_profile(sh.cells(spark, "terrain", [[1, 2], [3, 4]]), both).collect()}
    assert rows["terrain"].valid_pixels == 4
    assert (rows["depth"].valid_pixels, rows["depth"].valid_min) == (0, None)
    classes = spark.createDataFrame(
        [], "package_id long, grid_id string, class int, terrain_valid boolean, covered boolean"
    )
    lost = og.class_accounting(classes, both).collect()
    assert [(r.expected_cells, r.conservation_code) for r in lost] == [(4, "AREA_CONSERVATION")]


def test_a_line_keeps_its_end_when_densified(spark):
    from pyspark.sql import functions as F

    from platwork.operators.coordinates import densify
    from platwork.model import GEOMETRY

    rows = spark.createDataFrame([("l", sh.line((0, 0), (10, 0)))], f"id string, geom {GEOMETRY}")
    found = densify(rows, ["id"], F.lit(4.0)).orderBy("seq", "k").collect()
    assert [round(r.x, 6) for r in found] == [0.0, 3.333333, 6.666667, 10.0]


def test_paths_refuse_negative_weights(spark):
    import pytest

    from platwork.operators.network import shortest_paths

    edges = spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double")
    with pytest.raises(ValueError, match="INVALID_EDGE_WEIGHT"):
        shortest_paths(edges, spark.createDataFrame([(1,)], "node long"))


def test_turned_grids_are_refused_with_a_code(spark):
    from pyspark.sql import functions as F

    upright = sh.grids(spark, ("terrain", 2, 2, 1, 0, 2))
    turned = upright.withColumn("b", F.lit(0.5))
    cells = sh.cells(spark, "terrain", [[1, 2], [3, 4]])
    assert og.resample_bilinear(cells, upright, upright).count() == 4
    assert og.resample_bilinear(cells, turned, upright).count() == 0
    codes = [r.code for r in og.orientation_codes(upright.unionByName(turned)).collect()]
    assert sorted(codes, key=str) == [None, "UNSUPPORTED_GRID_ORIENTATION"]
