"""Geometry quality: order of defects, planar validity, noding, repair review.

Nothing here repairs a record. Work on one geometry's edges is a self-join keyed by
the record and spatial bins, so a boundary with very many vertices is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.functions.geometry import (
    all_finite,
    area,
    bbox_of,
    crosses_ray_up,
    is_empty,
    on_border,
    per_ring,
    point_in_polygon,
    ring_edges,
    side,
    vertices_of,
)
from platwork.operators.batches import NODED, faulty, noded
from platwork.operators.graphs import close_a_loop, closed_edges
from platwork.operators.pairs import bbox_pairs, edge_pairs
from platwork.session import stored

KEY = ("package_id", "layer", "source_record_id")
EDGE_BINS = {"base": 1.0, "ratio": 16.0, "levels": 6}
#: Records of up to this many vertices have their edges compared in their own row.
FEW_VERTICES = 64
FEW = f"coalesce(size({vertices_of('geom')}) <= {FEW_VERTICES}, true)"


def _ring_edges() -> str:
    """All edges of nonzero length, numbered within their ring, in order of part, ring and number."""
    real = f"filter({ring_edges('rg', 'pi', 'ri')}, re -> re.x1 != re.x2 OR re.y1 != re.y2)"
    numbered = (
        f"flatten(transform(array({real}), rr -> transform(rr, (re, rj) -> named_struct("
        "'part', re.part, 'ring', re.ring, 'seq', rj, 'n', size(rr), "
        "'x1', re.x1, 'y1', re.y1, 'x2', re.x2, 'y2', re.y2))))"
    )
    return per_ring("geom", numbered)


def ring_edge_rows(features: DataFrame) -> DataFrame:
    """One row per edge of nonzero length, numbered within its ring."""
    return features.selectExpr(*KEY, f"inline({_ring_edges()})")


EDGE_FIELDS = ("part", "ring", "seq", "n", "x1", "y1", "x2", "y2")


def _edge(prefix: str = "") -> str:
    return "named_struct(" + ", ".join(f"'{f}', {prefix}{f}" for f in EDGE_FIELDS) + ")"


def _pairs_in_bins(features: DataFrame) -> DataFrame:
    """Pairs of edges of the same record whose boxes overlap, by a join of edges in bins."""
    edges = ring_edge_rows(features)

    def half(tag: str) -> DataFrame:
        return edges.selectExpr(
            *KEY,
            *[f"{f} AS {tag}_{f}" for f in EDGE_FIELDS],
            "named_struct('xmin', least(x1, x2), 'ymin', least(y1, y2), "
            f"'xmax', greatest(x1, x2), 'ymax', greatest(y1, y2)) AS {tag}_box",
        )

    return (
        bbox_pairs(half("a"), half("b"), "a_box", "b_box", on=KEY, **EDGE_BINS)
        .filter("struct(a_part, a_ring, a_seq) < struct(b_part, b_ring, b_seq)")
        .selectExpr(*KEY, f"{_edge('a_')} AS a", f"{_edge('b_')} AS b")
    )


def edge_contacts(features: DataFrame) -> DataFrame:
    """Pairs of edges of the same record that touch, cross or overlap, for records of any number of edges."""
    sides = [
        f"signum({side(of, f'{end}.x{n}', f'{end}.y{n}')}) AS s{end}{n}"
        for of, end in (("b", "a"), ("a", "b"))
        for n in (1, 2)
    ]
    return (
        _pairs_in_bins(features)
        .selectExpr(*KEY, "a", "b", *sides)
        .filter("sa1 * sa2 <= 0 AND sb1 * sb2 <= 0")
        .selectExpr(
            "*",
            "sa1 = 0 AND sa2 = 0 AND sb1 = 0 AND sb2 = 0 AS parallel",
            "sa1 * sa2 < 0 AND sb1 * sb2 < 0 AS crossing",
        )
    )


def _shared_extent(axis: str) -> str:
    return (
        f"least(greatest(a.{axis}1, a.{axis}2), greatest(b.{axis}1, b.{axis}2))"
        f" - greatest(least(a.{axis}1, a.{axis}2), least(b.{axis}1, b.{axis}2))"
    )


# Parallel edges on one line: more than one point in common?
OVERLAP = f"(parallel AND ({_shared_extent('x')} > 0 OR {_shared_extent('y')} > 0))"
SAME_RING = "(a.part = b.part AND a.ring = b.ring)"
NEIGHBOUR = f"({SAME_RING} AND abs(a.seq - b.seq) IN (1, a.n - 1))"


SEVERAL = "(size(geom.parts) > 1 OR exists(geom.parts, p -> size(p) > 1))"


def _rings() -> str:
    """Every ring of a shape of several, with two of its vertices, its box and edges.

    Rings that neither cross nor overlap, and touch in one point at most, can't have both of two
    different vertices on each other's border.
    """
    ends = (
        "aggregate(rg, named_struct('xmin', rg[0].x, 'xmax', rg[0].x, 'ymin', rg[0].y, 'ymax', rg[0].y), (bx, bv) -> "
        "named_struct('xmin', least(bx.xmin, bv.x), 'xmax', greatest(bx.xmax, bv.x), "
        "'ymin', least(bx.ymin, bv.y), 'ymax', greatest(bx.ymax, bv.y)))"
    )
    ring = (
        "named_struct('part', pi, 'ring', ri, 'v', array(rg[0], rg[size(rg) div 2]), "
        f"'box', {ends}, 'edges', {ring_edges('rg', 'pi', 'ri')})"
    )
    return f"CASE WHEN {SEVERAL} THEN flatten(transform(geom.parts, (pt, pi) -> transform(pt, (rg, ri) -> {ring}))) END"


def _misplaced_rings() -> str:
    """A hole leaving its shell, a hole inside a hole, or a part inside a part; looks at boxes first."""

    def some_vertex(test: str) -> str:
        return f"exists(r.v, v -> {test})"

    inside = point_in_polygon("s.edges", "v.x", "v.y")
    border = on_border("s.edges", "v.x", "v.y")
    near = "r.box.xmin <= s.box.xmax AND s.box.xmin <= r.box.xmax AND r.box.ymin <= s.box.ymax AND s.box.ymin <= r.box.ymax"
    leaving = (
        "exists(_rings, r -> r.ring > 0 AND exists(_rings, s -> s.ring = 0 AND s.part = r.part "
        f"AND {some_vertex(f'NOT {inside} AND NOT {border}')}))"
    )
    nested = (
        "exists(_rings, r -> r.ring > 0 AND exists(_rings, s -> s.ring > 0 AND s.part = r.part "
        f"AND s.ring != r.ring AND {near} AND {some_vertex(f'{inside} AND NOT {border}')}))"
    )
    # Inside another part's shell, and in none of that part's holes.
    hole = "exists(_rings, h -> h.part = s.part AND h.ring > 0 AND {})"
    in_hole = hole.format(f"({point_in_polygon('h.edges', 'v.x', 'v.y')} OR {on_border('h.edges', 'v.x', 'v.y')})")
    stacked = (
        "exists(_rings, r -> r.ring = 0 AND exists(_rings, s -> s.ring = 0 AND s.part != r.part "
        f"AND {near} AND {some_vertex(f'{inside} AND NOT {border} AND NOT {in_hole}')}))"
    )
    return f"CASE WHEN {SEVERAL} THEN {leaving} OR {nested} OR {stacked} ELSE false END"


def _well_formed() -> str:
    closed = (
        "forall(geom.parts, p -> forall(p, r -> size(r) >= 4 AND r[0] = r[size(r) - 1] "
        "AND size(array_distinct(r)) >= 3))"
    )
    long = "forall(geom.parts, p -> forall(p, r -> size(array_distinct(r)) >= 2))"
    return f"CASE geom.kind WHEN 'polygon' THEN {closed} WHEN 'line' THEN {long} ELSE true END"


def with_validity(features: DataFrame) -> DataFrame:
    """Add `is_valid`: planar polygon validity; NULL for a null geometry.

    Lines need two distinct points; points are valid. Rings of a part may touch in single points,
    as long as these close no loop of rings: that would cut the part's inside in two. Most records
    have few edges, which are compared in their own row and no reason for a shuffle, whatever their
    length; only the polygons among the others meet the edge join.
    """
    flat = F.expr("CASE WHEN geom.kind = 'polygon' THEN geom.parts END")
    short = features.filter(FEW).withColumn("_faulty", F.arrow_udf(faulty, "boolean")(flat))
    long = features.filter(f"NOT ({FEW})")
    known = short.unionByName(long.join(_faulty_records(long), list(KEY), "left").select(*short.columns))
    return (
        known.withColumn("_rings", F.expr(f"CASE WHEN geom.kind = 'polygon' THEN {_rings()} END"))
        .withColumn(
            "is_valid",
            F.expr(
                "CASE WHEN geom IS NULL THEN NULL "
                f"WHEN {is_empty('geom')} THEN true WHEN NOT {all_finite('geom')} THEN false "
                f"WHEN NOT ({_well_formed()}) THEN false WHEN geom.kind != 'polygon' THEN true "
                f"WHEN _faulty THEN false ELSE NOT ({_misplaced_rings()}) END"
            ),
        )
        .drop("_faulty", "_rings")
    )


def _faulty_records(features: DataFrame) -> DataFrame:
    """Polygons with edges that cross, overlap or touch where they must not: KEY and _faulty; by a join of edges."""
    polygons = features.filter(f"geom.kind = 'polygon' AND {all_finite('geom')}")
    contacts = edge_contacts(polygons).selectExpr(
        "*",
        f"CASE WHEN {NEIGHBOUR} THEN {OVERLAP} WHEN {SAME_RING} THEN true "
        f"ELSE {OVERLAP} OR crossing END AS bad",
    )
    def end_on(e: str, n: int, other: str) -> str:
        x, y = f"{e}.x{n}", f"{e}.y{n}"
        within = " AND ".join(
            f"{v} BETWEEN least({other}.{c}1, {other}.{c}2) AND greatest({other}.{c}1, {other}.{c}2)"
            for v, c in ((x, "x"), (y, "y"))
        )
        return f"WHEN s{e}{n} = 0 AND {within} THEN named_struct('x', {x}, 'y', {y})"

    spot = " ".join(end_on(e, n, o) for e, o in (("a", "b"), ("b", "a")) for n in (1, 2))
    touches = "array(named_struct('ring', a.ring, 'spot', spot), named_struct('ring', b.ring, 'spot', spot))"
    # A part's touches are fewer than its vertices, which its record holds in one row anyway.
    return (
        contacts.selectExpr(
            *KEY,
            "a",
            "b",
            "bad",
            f"CASE WHEN bad OR {SAME_RING} OR a.part != b.part THEN NULL {spot} END AS spot",
        )
        .filter("bad OR spot IS NOT NULL")
        .selectExpr(*KEY, "a.part AS part", "bad", f"explode(if(spot IS NULL, array(NULL), {touches})) AS touch")
        .groupBy(*KEY, "part")
        .agg(F.bool_or("bad").alias("bad"), F.collect_set("touch").alias("touches"))
        # A loop needs two rings and two spots.
        .withColumn("loop", close_a_loop(F.expr("CASE WHEN NOT bad AND size(touches) > 3 THEN touches END")))
        .filter("bad OR loop")
        .select(*KEY)
        .distinct()
        .withColumn("_faulty", F.lit(True))
    )


def scan_quality() -> str:
    """Defect order of a layer scan: null, empty, invalid, has Z."""
    return (
        f"CASE WHEN geom IS NULL THEN 'null_geometry' WHEN {is_empty('geom')} THEN 'empty_geometry' "
        "WHEN NOT is_valid THEN 'invalid_geometry' "
        "WHEN geom.has_z THEN 'z_geometry_requires_adapter' ELSE 'valid_planar_geometry' END"
    )


def source_quality(readable: str = "true", finite_z: str = "true") -> str:
    """Defect order of a boundary record: null, unreadable, empty, not finite (any
    ordinate), has Z, not a polygon, invalid."""
    return (
        f"CASE WHEN NOT {readable} THEN 'INVALID_SOURCE_WKB' WHEN geom IS NULL THEN 'NULL_GEOMETRY' "
        f"WHEN {is_empty('geom')} THEN 'EMPTY_GEOMETRY' "
        f"WHEN NOT ({all_finite('geom')} AND {finite_z}) THEN 'NONFINITE_GEOMETRY' "
        "WHEN geom.has_z THEN 'Z_GEOMETRY_UNVERIFIED' "
        "WHEN geom.kind != 'polygon' THEN 'UNSUPPORTED_FOOTPRINT' "
        "WHEN NOT is_valid THEN 'INVALID_GEOMETRY' ELSE 'VALID_PLANAR_SOURCE' END"
    )


def object_identity(layer: str, revision: str, record: str) -> str:
    zero = "decode(unhex('00'), 'UTF-8')"
    digest = f"sha2(concat({layer}, {zero}, {revision}), 256)"
    return f"concat('boundary:', substring({digest}, 1, 16), ':', {record})"


def segment_nodes(features: DataFrame) -> DataFrame:
    """Every edge cut at its contacts: sub-edges with the number of times each is drawn.

    Records of few vertices are cut in their own row, copies of a record once.
    """
    few = f"({FEW}) AND {all_finite('geom')}"
    short = features.filter(few).select(*KEY, F.arrow_udf(noded, NODED)("geom.parts").alias("_nodes"))
    copies = short.selectExpr(*KEY, "inline(_nodes)").groupBy(*KEY, "start", "end").agg(F.max("drawn").alias("drawn"))
    return copies.unionByName(_nodes_in_bins(features.filter(f"geom IS NOT NULL AND NOT ({few})")))


def _nodes_in_bins(features: DataFrame) -> DataFrame:
    """The same for records of any number of edges, by a join of edges."""
    contacts = edge_contacts(features)
    # One formula for the crossing point, so both edges are cut at the same doubles.
    share = (
        "try_divide((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1), "
        "(a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"
    )
    cross = (
        "CASE WHEN crossing THEN named_struct('x', a.x1 + share * (a.x2 - a.x1), "
        "'y', a.y1 + share * (a.y2 - a.y1)) END"
    )

    def end_on(edge: str, other: str, n: int) -> str:
        x, y = f"{other}.x{n}", f"{other}.y{n}"
        return (
            f"CASE WHEN s{other}{n} = 0 "
            f"AND {x} BETWEEN least({edge}.x1, {edge}.x2) AND greatest({edge}.x1, {edge}.x2) "
            f"AND {y} BETWEEN least({edge}.y1, {edge}.y2) AND greatest({edge}.y1, {edge}.y2) "
            f"THEN named_struct('x', {x}, 'y', {y}) END"
        )

    marks = "array(" + ", ".join(
        f"named_struct('e', {e}, 'p', {p})"
        for e, p in (
            ("a", cross),
            ("b", cross),
            ("a", end_on("a", "b", 1)),
            ("a", end_on("a", "b", 2)),
            ("b", end_on("b", "a", 1)),
            ("b", end_on("b", "a", 2)),
        )
    ) + ")"
    cuts = (
        contacts.selectExpr("*", f"{share} AS share")
        .selectExpr(*KEY, f"explode({marks}) AS m")
        .selectExpr(*KEY, "m.e AS e", "m.p AS p")
        .filter("p IS NOT NULL")
    )
    own = ring_edge_rows(features).selectExpr(
        *KEY,
        f"{_edge()} AS e",
        "explode(array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2))) AS p",
    )
    line = Window.partitionBy(*KEY, "e.part", "e.ring", "e.seq").orderBy("along")
    pieces = (
        own.unionByName(cuts)
        .distinct()
        .selectExpr(
            "*", "(p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1) AS along"
        )
        .withColumn("q", F.lead("p").over(line))
        .filter("q IS NOT NULL")
    )
    return (
        pieces.selectExpr(*KEY, "least(p, q) AS start", "greatest(p, q) AS end")
        .groupBy(*KEY, "start", "end")
        .agg(F.count("*").alias("drawn"))
    )


def even_odd_area(edges: DataFrame) -> DataFrame:
    """Area of the points with an odd number of edges above them, per record.

    `edges` are noded sub-edges (start, end), each once. One with an even number of others above
    its middle is an upper border and counts the strip below it, one with an odd number is a
    lower border and takes it off. Edges meet in bins of their own width, so a record with very
    many of them is spread over tasks.
    """
    fields = ", ".join(f"'{{p}}_{c}', {e}" for c, e in (("x1", "start.x"), ("y1", "start.y"), ("x2", "end.x"), ("y2", "end.y")))
    # Where an edge looks for others above it, height is no help in finding them.
    slab = "named_struct('xmin', {}, 'ymin', 0D, 'xmax', {}, 'ymax', 0D)"
    real = edges.filter("start.x != end.x")
    lower = real.selectExpr(*KEY, f"inline(array(named_struct({fields.format(p='a')})))").selectExpr(
        "*", "(a_x1 + a_x2) / 2D AS mx", "(a_y1 + a_y2) / 2D AS my"
    )
    lower = lower.withColumn("a_box", F.expr(slab.format("mx", "mx")))
    upper = real.selectExpr(*KEY, f"inline(array(named_struct({fields.format(p='b')})))").withColumn(
        "b_box", F.expr(slab.format("b_x1", "b_x2"))
    )
    own = ["a_x1", "a_y1", "a_x2", "a_y2"]
    above = crosses_ray_up("b", "mx", "my").replace("b.", "b_")
    other = "(a_x1 != b_x1 OR a_y1 != b_y1 OR a_x2 != b_x2 OR a_y2 != b_y2)"
    return (
        edge_pairs(lower, upper, "a", "b", on=KEY)
        .groupBy(*KEY, *own)
        .agg(F.count_if(F.expr(f"{other} AND {above}")).alias("above"))
        .groupBy(*KEY)
        .agg(F.sum(F.expr("(a_x2 - a_x1) * (a_y1 + a_y2) / 2D * if(above % 2 = 0, 1D, -1D)")).alias("even_odd_area"))
    )


def repair_review(features: DataFrame) -> DataFrame:
    """Status of each invalid or empty record: what a repair would leave. Never accepted.

    Sub-edges drawn an odd number of times bound area, and so do those drawn an even number of
    times that make closed rings among themselves (a ring drawn twice); the others are leftovers
    without area. `features` carries is_valid.
    """
    doubtful = features.filter(f"geom IS NOT NULL AND (NOT is_valid OR {is_empty('geom')})").selectExpr(
        *KEY,
        "geom",
        f"geom.kind = 'polygon' AND NOT geom.has_z AND NOT {is_empty('geom')} "
        f"AND {all_finite('geom')} AS reviewable",
    )
    # Judged and noded once, looked at in several ways.
    doubtful = stored(doubtful, "doubtful")
    nodes = stored(segment_nodes(doubtful.filter("reviewable")), "nodes")
    rings = (
        nodes.filter("drawn % 2 = 0")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("start", "end")).alias("twice"))
        .select(*KEY, F.explode(closed_edges(F.col("twice"))).alias("e"))
        .select(*KEY, "e.start", "e.end")
    )
    bounding = nodes.filter("drawn % 2 = 1").select(*KEY, "start", "end").unionByName(rings)
    parity = (
        nodes.groupBy(*KEY)
        .agg(
            F.count_if(F.expr("drawn % 2 = 1")).alias("odd"),
            F.count_if(F.expr("drawn % 2 = 0")).alias("even"),
        )
        .join(rings.groupBy(*KEY).agg(F.count("*").alias("closed")), list(KEY), "left")
        .join(even_odd_area(bounding), list(KEY), "left")
    )
    return (
        doubtful.join(parity, list(KEY), "left")
        .selectExpr(
            *KEY,
            "reviewable",
            "coalesce(odd, 0L) AS odd_edges",
            "coalesce(even, 0L) AS even_edges",
            "coalesce(closed, 0L) AS closed",
            f"CASE WHEN reviewable THEN {area('geom')} END AS source_area",
            "CASE WHEN reviewable THEN coalesce(even_odd_area, 0D) END AS candidate_area",
        )
        .selectExpr(
            *KEY,
            "CASE WHEN NOT reviewable THEN 'UNSUPPORTED_REVIEW' "
            "WHEN odd_edges = 0 AND even_edges = 0 THEN 'EMPTY_REVIEW' "
            "WHEN odd_edges + closed = 0 THEN 'COLLAPSED_REVIEW' "
            "WHEN even_edges > closed THEN 'MIXED_DIMENSION_REVIEW' ELSE 'POLYGON_CANDIDATE' END AS status",
            "odd_edges",
            "even_edges",
            "source_area",
            "candidate_area",
            "candidate_area - source_area AS area_difference",
            "false AS physical_envelope_accepted",
            "true AS review_required",
        )
    )


def with_candidates(records: DataFrame) -> DataFrame:
    """Adds candidate_status: what a repair of an invalid or empty record would leave; NULL for the others."""
    status = repair_review(records).select(*KEY, F.col("status").alias("candidate_status"))
    return records.join(status, list(KEY), "left")


def boundary_report(records: DataFrame, with_sources: bool = False) -> DataFrame:
    """Every degraded record with identity, hash, bounds, candidate status and review flags.

    `records` carries quality, guard, object_id, wkb and, where it was looked for (see
    `with_candidates`), candidate_status. The sources' bytes come along on demand, as hex.
    """
    box = F.expr(bbox_of("guard"))
    known = "candidate_status" in records.columns
    return records.filter(F.col("quality") != "VALID_PLANAR_SOURCE").select(
        *KEY,
        "object_id",
        "quality",
        "source_form",
        F.sha2("wkb", 256).alias("source_wkb_sha256"),
        box["xmin"].alias("xmin"),
        box["ymin"].alias("ymin"),
        box["xmax"].alias("xmax"),
        box["ymax"].alias("ymax"),
        F.col("guard").isNotNull().alias("location_known"),
        F.col("candidate_status") if known else F.lit(None).cast("string").alias("candidate_status"),
        *([F.lower(F.hex("wkb")).alias("source_wkb_hex")] if with_sources else []),
        F.lit(False).alias("candidate_accepted"),
        F.lit(False).alias("physical_envelope_accepted"),
        F.lit(False).alias("automatic_demolition_allowed"),
        F.lit(True).alias("review_required"),
    )


def quality_counts(records: DataFrame) -> DataFrame:
    """Histogram of boundary quality with degraded, unlocatable and dropped counts."""
    return records.groupBy("package_id", "layer", "quality").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("quality") != "VALID_PLANAR_SOURCE").alias("degraded"),
        F.count_if(F.col("guard").isNull()).alias("unlocatable"),
    )


def candidate_counts(records: DataFrame, header: DataFrame) -> DataFrame:
    """Per layer the declared, retained and dropped records, and a histogram of candidate statuses.

    One row per layer and status (NULL: no candidate); `header` has package_id, layer and
    declared_count. Nothing is ever dropped on purpose: a difference is a fault of the import.
    """
    key = ["package_id", "layer"]
    counts = records.groupBy(*key, "candidate_status").agg(F.count("*").alias("records"))
    kept = records.groupBy(*key).agg(F.count("*").alias("retained"))
    return (
        header.select(*key, "declared_count").join(kept, key, "left").na.fill(0, ["retained"])
        .withColumn("dropped", F.col("declared_count") - F.col("retained")).join(counts, key, "left")
    )


def snapshot_integrity(header: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """Codes of a boundary snapshot that must not be used.

    header: package_id, layer, declared_count, space_id, coverage_valid,
    coverage_confirmed; files: package_id, layer, name, sha256.
    """
    key = ["package_id", "layer"]
    per_id = records.groupBy(*KEY).agg(F.count("*").alias("n"))
    counted = per_id.groupBy(*key).agg(
        F.sum("n").alias("actual"), F.count_if(F.col("n") > 1).alias("repeated")
    )
    per_file = files.groupBy(*key, "name").agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))).alias(
            "bad_hash"
        ),
    )
    hashed = per_file.groupBy(*key).agg(
        F.count_if(F.col("n") > 1).alias("repeated_files"), F.sum("bad_hash").alias("bad_hashes")
    )

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    blank = F.trim(F.coalesce("layer", F.lit(""))) == ""
    no_space = F.trim(F.coalesce("space_id", F.lit(""))) == ""
    codes = [
        (blank | no_space, "INVALID_BOUNDARY_SNAPSHOT"),
        (~F.col("declared_count").eqNullSafe(n("actual").cast("long")), "SOURCE_RECORDS_DROPPED"),
        (n("repeated") > 0, "DUPLICATE_SOURCE_RECORD"),
        (F.col("repeated_files").isNull() | (n("repeated_files") > 0), "INVALID_BOUNDARY_SNAPSHOT"),
        (n("bad_hashes") > 0, "INVALID_SOURCE_HASH"),
        (~F.coalesce("coverage_valid", F.lit(False)), "INVALID_COVERAGE"),
        (F.col("coverage_confirmed").isNull(), "INVALID_COVERAGE_ASSERTION"),
    ]
    return (
        header.join(counted, key, "left")
        .join(hashed, key, "left")
        .select(
            *key,
            n("actual").cast("long").alias("actual_count"),
            F.array_distinct(
                F.filter(
                    F.array(*[F.when(bad, code) for bad, code in codes]), lambda c: c.isNotNull()
                )
            ).alias("codes"),
        )
    )
