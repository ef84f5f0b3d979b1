"""Polygons on grids: fill, classify and clip cells; union and clip areas of faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.functions.geometry import crosses_ray, edges_of, side, turned_edges_of
from platwork.model import LAND, UNKNOWN, WATER
from platwork.operators.pairs import bbox_pairs, outlined, shape_pairs, shaped

BLOCK = 64


def polygon_runs(faces: DataFrame, grids: DataFrame) -> DataFrame:
    """Column runs of the cells whose centre lies in each face, holes respected.

    Each edge is expanded only to the grid rows it crosses, so the work follows the
    outline, not the bounding box. Works in pixel space, hence for any affine grid.
    `grids` holds one grid per package.
    """
    grid = grids.select(
        "package_id", "grid_id", "a", "b", "c", "d", "e", "f", "width", "height"
    )
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")

    def pixel(x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - F.col("c"), y - F.col("f")
        return (
            F.try_divide(F.col("e") * dx - F.col("b") * dy, det),
            F.try_divide(F.col("a") * dy - F.col("d") * dx, det),
        )

    u1, v1 = pixel(F.col("edge.x1"), F.col("edge.y1"))
    u2, v2 = pixel(F.col("edge.x2"), F.col("edge.y2"))
    first = F.greatest(F.ceil(F.least("v1", "v2") - 0.5), F.lit(0))
    last = F.least(F.ceil(F.greatest("v1", "v2") - 0.5), F.col("height").cast("long")) - 1
    crossings = (
        faces.select("package_id", "role", "face_id", F.expr(f"explode({edges_of('geom')})").alias("edge"))
        .join(grid, "package_id")
        .select(
            "package_id", "role", "face_id", "grid_id", "width", "height",
            u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"),
        )
        .withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last))))
        .withColumn("y", F.col("row") + 0.5)
        .withColumn(
            "u",
            F.col("u1")
            + F.try_divide(
                (F.col("y") - F.col("v1")) * (F.col("u2") - F.col("u1")), F.col("v2") - F.col("v1")
            ),
        )
    )
    cuts = crossings.groupBy("package_id", "grid_id", "role", "face_id", "row", "width").agg(
        F.array_sort(F.collect_list("u")).alias("us")
    )
    spans = F.expr(
        "transform(sequence(1, int(size(us) div 2)), k -> named_struct("
        "'lo', greatest(ceil(us[2 * k - 2] - 0.5D), 0L), "
        "'hi', least(ceil(us[2 * k - 1] - 0.5D), bigint(width)) - 1L))"
    )
    return (
        cuts.filter("size(us) > 1")
        .withColumn("s", F.explode(spans))
        .filter("s.lo <= s.hi")
        .select("package_id", "grid_id", "role", "face_id", "row", "s.lo", "s.hi")
    )


def cell_masks(runs: DataFrame) -> DataFrame:
    """Filled cells per row and block of 64 columns, as one bit mask per role.

    OR-ing bits keeps one number per block however many faces lie over each other.
    """
    bits = F.expr(
        f"shiftleft(-1L, cast(greatest(lo - block * {BLOCK}, 0) as int)) & "
        f"shiftrightunsigned(-1L, cast({BLOCK - 1} - least(hi - block * {BLOCK}, {BLOCK - 1}) as int))"
    )
    return (
        runs.withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)))
        )
        .withColumn("bits", bits)
        .groupBy("package_id", "grid_id", "row", "block")
        .agg(
            F.bit_or(F.when(F.col("role") == "water", F.col("bits"))).alias("water_bits"),
            F.bit_or(F.when(F.col("role") == "coverage", F.col("bits"))).alias("cover_bits"),
        )
    )


def _bit(mask: str) -> Column:
    picked = F.expr(f"shiftrightunsigned({mask}, cast(col % {BLOCK} as int)) & 1L")
    return F.coalesce(picked, F.lit(0)) == 1


def polygon_to_cells(faces: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells filled by any face, each once, with the roles that fill it."""
    masks = cell_masks(polygon_runs(faces, grids))
    any_bits = F.coalesce("water_bits", F.lit(0)).bitwiseOR(F.coalesce("cover_bits", F.lit(0)))
    return (
        masks.withColumn("any_bits", any_bits)
        .withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))))
        .withColumn("col", F.col("block") * BLOCK + F.col("offset"))
        .filter(_bit("any_bits"))
        .select(
            "package_id",
            "grid_id",
            "row",
            "col",
            _bit("water_bits").alias("water"),
            _bit("cover_bits").alias("covered"),
        )
    )


def on_cells(cells: DataFrame, faces: DataFrame, grids: DataFrame) -> DataFrame:
    """Every cell with flags `water` and `covered` (centre in a face of that role)."""
    masks = cell_masks(polygon_runs(faces, grids))
    return (
        cells.withColumn("block", F.floor(F.col("col") / BLOCK))
        .join(
            masks.withColumn("row", F.col("row").cast("int")),
            ["package_id", "grid_id", "row", "block"],
            "left",
        )
        .withColumns({"water": _bit("water_bits"), "covered": _bit("cover_bits")})
        .drop("block", "water_bits", "cover_bits")
    )


def classify_water_faces(flagged: DataFrame, assertions: DataFrame) -> DataFrame:
    """Water inside coverage; land only where completeness is confirmed; else unknown.

    assertions: package_id, complete_coverage_confirmed.
    """
    complete = F.coalesce(F.col("complete_coverage_confirmed"), F.lit(False))
    return (
        flagged.join(
            assertions.select("package_id", "complete_coverage_confirmed"), "package_id", "left"
        )
        .withColumn(
            "class",
            F.when(F.col("covered") & F.col("water"), WATER)
            .when(F.col("covered") & complete, LAND)
            .otherwise(UNKNOWN)
            .cast("int"),
        )
        .drop("complete_coverage_confirmed")
    )


def clip_by_polygon(cells: DataFrame, faces: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells whose centre lies in any of the faces."""
    return on_cells(cells, faces, grids).filter(F.col("water") | F.col("covered")).drop(
        "water", "covered"
    )


# --- union and clip area ------------------------------------------------------------


def _directed_edges(faces: DataFrame) -> DataFrame:
    """Edges with the inside on their left, whatever way the ring was drawn."""
    flat = faces.selectExpr(
        "package_id", "role", "face_id", f"inline({turned_edges_of('geom')})"
    ).filter("x1 != x2 OR y1 != y2")
    return flat.selectExpr(
        "package_id",
        "role",
        "face_id",
        "if(turn >= 0, x1, x2) AS x1",
        "if(turn >= 0, y1, y2) AS y1",
        "if(turn >= 0, x2, x1) AS x2",
        "if(turn >= 0, y2, y1) AS y2",
    )


def _noded_edges(edges: DataFrame) -> DataFrame:
    """Directed edges cut wherever they meet an edge of any face of the package."""
    box = (
        "named_struct('xmin', least(x1, x2), 'ymin', least(y1, y2), "
        "'xmax', greatest(x1, x2), 'ymax', greatest(y1, y2))"
    )
    ends = ("x1", "y1", "x2", "y2")
    left = edges.selectExpr(
        "package_id", "role", "face_id", *[f"{c} AS e_{c}" for c in ends], f"{box} AS a_box"
    )
    right = edges.selectExpr(
        "package_id", *[f"{c} AS o_{c}" for c in ends], f"{box} AS o_box"
    )

    def struct(tag: str) -> str:
        return "named_struct(" + ", ".join(f"'{c}', {tag}_{c}" for c in ends) + ")"

    sides = [
        f"signum({side(of, f'{end}.x{n}', f'{end}.y{n}')}) AS s{end}{n}"
        for of, end in (("o", "e"), ("e", "o"))
        for n in (1, 2)
    ]
    met = (
        bbox_pairs(left, right, "a_box", "o_box", base=1.0, ratio=16.0, levels=4)
        .selectExpr("package_id", "role", "face_id", f"{struct('e')} AS e", f"{struct('o')} AS o")
        .selectExpr("*", *sides)
        .filter("se1 * se2 <= 0 AND so1 * so2 <= 0")
        # The lesser edge defines the crossing point, so both get the same doubles.
        .selectExpr("*", "if(e <= o, e, o) AS f", "if(e <= o, o, e) AS g")
        .selectExpr(
            "*",
            "try_divide((g.x1 - f.x1) * (g.y2 - g.y1) - (g.y1 - f.y1) * (g.x2 - g.x1), "
            "(f.x2 - f.x1) * (g.y2 - g.y1) - (f.y2 - f.y1) * (g.x2 - g.x1)) AS share",
        )
    )

    def end_on(n: int) -> str:
        x, y = f"o.x{n}", f"o.y{n}"
        return (
            f"CASE WHEN so{n} = 0 AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) "
            f"AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) "
            f"THEN named_struct('x', {x}, 'y', {y}) END"
        )

    points = (
        "array(CASE WHEN se1 * se2 < 0 AND so1 * so2 < 0 THEN "
        "named_struct('x', f.x1 + share * (f.x2 - f.x1), 'y', f.y1 + share * (f.y2 - f.y1)) END, "
        f"{end_on(1)}, {end_on(2)})"
    )
    own = "array(named_struct('x', e.x1, 'y', e.y1), named_struct('x', e.x2, 'y', e.y2))"
    line = Window.partitionBy("package_id", "role", "face_id", "e").orderBy("along")
    # Every edge meets itself, so its two ends are always among the points.
    return (
        met.selectExpr(
            "package_id", "role", "face_id", "e", f"explode(concat({own}, {points})) AS p"
        )
        .filter("p IS NOT NULL")
        .distinct()
        .selectExpr("*", "(p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1) AS along")
        .withColumn("q", F.lead("p").over(line))
        .filter("q IS NOT NULL")
        .select("package_id", "role", "face_id", "p", "q")
    )


def union_coverage_clip(faces: DataFrame) -> DataFrame:
    """Union area of the water faces, the part inside coverage, and the rest, per package.

    The outline of a union is made of the pieces of edges that lie inside no other
    face; its area is the signed sum over those pieces. Cutting, testing and summing
    are bin joins and aggregates; no geometry is ever assembled.
    """
    counts = [
        F.count_if(F.expr(f"role = '{role}' AND {test}")).alias(f"{role}_{tag}")
        for role in ("water", "coverage")
        for test, tag in (("p < q", "ahead"), ("p > q", "back"))
    ]
    pieces = (
        _noded_edges(_directed_edges(faces))
        .groupBy("package_id", F.expr("least(p, q)").alias("lo"), F.expr("greatest(p, q)").alias("hi"))
        .agg(*counts)
        .selectExpr(
            "package_id",
            "lo.x AS x1", "lo.y AS y1", "hi.x AS x2", "hi.y AS y2",
            "water_ahead", "water_back", "coverage_ahead", "coverage_back",
            "(lo.x + hi.x) / 2D AS mx", "(lo.y + hi.y) / 2D AS my",
        )
    )
    key = ["package_id", "x1", "y1", "x2", "y2"]
    middle = "named_struct('xmin', mx, 'ymin', my, 'xmax', mx, 'ymax', my)"
    shapes = shaped(faces, ["package_id", "role", "face_id"], "f")
    # A piece lies inside a face if its middle does and it is not part of the border.
    on_line = (
        f"{side('b', 'x1', 'y1')} = 0 AND {side('b', 'x2', 'y2')} = 0 "
        "AND mx BETWEEN least(b.x1, b.x2) AND greatest(b.x1, b.x2) "
        "AND my BETWEEN least(b.y1, b.y2) AND greatest(b.y1, b.y2)"
    )
    near_line = (
        "greatest(least(b.x1, b.x2), least(x1, x2)) <= least(greatest(b.x1, b.x2), greatest(x1, x2)) "
        "AND greatest(least(b.y1, b.y2), least(y1, y2)) <= least(greatest(b.y1, b.y2), greatest(y1, y2)) "
        f"AND abs({side('b', 'mx', 'my')}) <= 1e-9D * (abs(b.x2 - b.x1) + abs(b.y2 - b.y1))"
    )
    inside = (
        bbox_pairs(
            pieces.selectExpr(*key, "mx", "my", f"{middle} AS m_box"), shapes, "m_box", "f_box"
        )
        .selectExpr(*key, "mx", "my", "role", "face_id", "explode(f_edges) AS b")
        .groupBy(*key, "role", "face_id")
        .agg(
            F.count_if(F.expr(crosses_ray("b", "mx", "my"))).alias("rays"),
            F.bool_or(F.expr(f"({on_line}) OR ({near_line})")).alias("border"),
        )
        .filter("rays % 2 = 1 AND NOT border")
        .groupBy(*key)
        .agg(
            F.bool_or(F.expr("role = 'water'")).alias("in_water"),
            F.bool_or(F.expr("role = 'coverage'")).alias("in_cover"),
        )
    )
    return (
        pieces.join(inside, key, "left")
        .selectExpr(
            "package_id",
            "(x1 * y2 - x2 * y1) / 2D AS turn",
            "coalesce(in_water, false) OR (water_ahead > 0 AND water_back > 0) AS in_water",
            "coalesce(in_cover, false) OR (coverage_ahead > 0 AND coverage_back > 0) AS in_cover",
            "int(water_ahead > 0) - int(water_back > 0) AS water",
            "int(coverage_ahead > 0) - int(coverage_back > 0) AS cover",
        )
        .selectExpr(
            "package_id",
            "CASE WHEN NOT in_water THEN water * turn ELSE 0D END AS outline",
            "CASE WHEN NOT in_water AND water != 0 AND (in_cover OR cover = water) THEN water * turn "
            "WHEN in_water AND NOT in_cover THEN cover * turn ELSE 0D END AS clipped",
        )
        .groupBy("package_id")
        .agg(F.sum("outline").alias("union_area"), F.sum("clipped").alias("clipped_area"))
        .withColumn("outside_area", F.expr("greatest(union_area - clipped_area, 0D)"))
    )


def touching_leftovers(water: DataFrame, coverage: DataFrame) -> DataFrame:
    """Water faces that meet the coverage polygon without any area in common, and in what form they do.

    form is LineString where borders share a stretch, else Point.
    """
    left = outlined(water, ["package_id", "face_id"], "w")
    right = outlined(coverage.withColumnRenamed("face_id", "cover_id"), ["package_id", "cover_id"], "v")
    pairs = shape_pairs(left, right, "w", "v", ["package_id", "face_id", "cover_id"], with_form=True)
    return pairs.filter("abs(common_area) <= 1e-9D").selectExpr(
        "package_id", "face_id", "if(along, 'LineString', 'Point') AS form"
    )
