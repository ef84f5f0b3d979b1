"""Planar geometry as column expressions over nested vertex arrays.

A geometry is struct<kind, has_z, parts: part -> ring -> vertex>. Predicates work
on its edge array. Buffers are never built: "buffer(A, r) meets B" is the exact
distance test dist(A, B) <= r.

Functions take column names (or SQL expressions) and return SQL text, so that large
expressions are composed as text and parsed once; wrap them in `F.expr`.
"""

from __future__ import annotations

FINITE = "({v} IS NOT NULL AND NOT isnan({v}) AND abs({v}) < double('Infinity'))"


def finite(value: str) -> str:
    return FINITE.format(v=value)


# --- constructors -------------------------------------------------------------


def _vertex(x: str, y: str) -> str:
    return f"named_struct('x', double({x}), 'y', double({y}))"


def _geom(kind: str, ring: str) -> str:
    return f"named_struct('kind', '{kind}', 'has_z', false, 'parts', array(array({ring})))"


def ring_geom(points: list[tuple[str, str]]) -> str:
    """Polygon with one ring; repeat the first vertex at the end."""
    return _geom("polygon", f"array({', '.join(_vertex(x, y) for x, y in points)})")


def box_geom(xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    return ring_geom([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)])


def line_geom(points: list[tuple[str, str]]) -> str:
    return _geom("line", f"array({', '.join(_vertex(x, y) for x, y in points)})")


def point_geom(x: str, y: str) -> str:
    return _geom("point", f"array({_vertex(x, y)})")


def raised(geom: str) -> str:
    """The same geometry marked as carrying heights."""
    return f"named_struct('kind', {geom}.kind, 'has_z', true, 'parts', {geom}.parts)"


def bbox_geom(box: str) -> str:
    shape = box_geom(f"{box}.xmin", f"{box}.ymin", f"{box}.xmax", f"{box}.ymax")
    return f"CASE WHEN {box} IS NOT NULL THEN {shape} END"


# --- decomposition --------------------------------------------------------------


def vertices_of(geom: str) -> str:
    return f"flatten(flatten({geom}.parts))"


def ring_edges(ring: str, part: str, index: str) -> str:
    """Edges of one vertex array; a lone vertex becomes one zero-length edge."""
    tag = f"'part', {part}, 'ring', {index}, 'seq', ei"
    return (
        f"CASE WHEN size({ring}) = 1 THEN transform({ring}, (ev, ei) -> named_struct({tag}, "
        f"'x1', ev.x, 'y1', ev.y, 'x2', ev.x, 'y2', ev.y)) "
        f"ELSE transform(slice({ring}, 1, greatest(size({ring}) - 1, 0)), (ev, ei) -> named_struct({tag}, "
        f"'x1', ev.x, 'y1', ev.y, 'x2', {ring}[ei + 1].x, 'y2', {ring}[ei + 1].y)) END"
    )


def per_ring(geom: str, rows: str) -> str:
    """Concatenate an array expression over all rings (names: rg, pi, ri)."""
    return (
        f"flatten(transform({geom}.parts, (pt, pi) -> "
        f"flatten(transform(pt, (rg, ri) -> {rows}))))"
    )


def edges_of(geom: str) -> str:
    return per_ring(geom, ring_edges("rg", "pi", "ri"))


def turned_edges_of(geom: str) -> str:
    """Edges that also carry their ring's sense: +1 where the inside lies to the left.

    Shells count positive and holes negative whatever way they were drawn.
    """
    sense = f"signum({ring_area('rg')}) * if(ri = 0, 1D, -1D)"
    rows = (
        f"transform({ring_edges('rg', 'pi', 'ri')}, te -> named_struct('part', te.part, "
        f"'ring', te.ring, 'seq', te.seq, 'x1', te.x1, 'y1', te.y1, 'x2', te.x2, 'y2', te.y2, "
        "'turn', tn))"
    )
    with_sense = f"flatten(transform(array({sense}), tn -> {rows}))"
    return per_ring(geom, with_sense)


def bbox_of(geom: str) -> str:
    """Bounding box, or NULL when empty or not finite; one pass over the vertices."""
    start = (
        "named_struct('xmin', double('Infinity'), 'ymin', double('Infinity'), "
        "'xmax', double('-Infinity'), 'ymax', double('-Infinity'))"
    )
    step = (
        "named_struct('xmin', least(bx.xmin, bv.x), 'ymin', least(bx.ymin, bv.y), "
        "'xmax', greatest(bx.xmax, bv.x), 'ymax', greatest(bx.ymax, bv.y))"
    )
    # NaN sorts above infinity, so one look at the result finds every odd ordinate.
    sound = (
        "bx.xmin > double('-Infinity') AND bx.ymin > double('-Infinity') "
        "AND bx.xmax < double('Infinity') AND bx.ymax < double('Infinity') "
        "AND bx.xmin < double('Infinity')"
    )
    return (
        f"aggregate({vertices_of(geom)}, {start}, (bx, bv) -> {step}, "
        f"bx -> CASE WHEN {sound} THEN bx END)"
    )


def is_empty(geom: str) -> str:
    return f"(coalesce(size({vertices_of(geom)}), 0) <= 0)"


def all_finite(geom: str) -> str:
    return f"forall({vertices_of(geom)}, fv -> {finite('fv.x')} AND {finite('fv.y')})"


# --- measures -------------------------------------------------------------------


def ring_area(ring: str) -> str:
    """Signed shoelace area of a closed vertex array."""
    return (
        f"aggregate(transform(slice({ring}, 1, greatest(size({ring}) - 1, 0)), (sv, si) -> "
        f"(sv.x * {ring}[si + 1].y - {ring}[si + 1].x * sv.y) / 2D), 0D, (st, sw) -> st + sw)"
    )


def area(geom: str) -> str:
    """Shells minus holes, without regard to ring direction; 0 for lines and points."""
    rings = (
        f"transform({geom}.parts, pt -> aggregate(transform(pt, (rg, ri) -> "
        f"abs({ring_area('rg')}) * if(ri = 0, 1D, -1D)), 0D, (t1, w1) -> t1 + w1))"
    )
    return (
        f"CASE WHEN {geom}.kind = 'polygon' THEN aggregate({rings}, 0D, (t2, w2) -> t2 + w2) "
        f"WHEN {geom} IS NOT NULL THEN 0D END"
    )


def length(edges: str) -> str:
    return (
        f"aggregate({edges}, 0D, (lt, le) -> lt + sqrt((le.x2 - le.x1) * (le.x2 - le.x1) "
        "+ (le.y2 - le.y1) * (le.y2 - le.y1)))"
    )


# --- predicates on edges --------------------------------------------------------


def turn(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    """Positive when p lies to the left of the line from a to b."""
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def side(e: str, px: str, py: str) -> str:
    return turn(f"{e}.x1", f"{e}.y1", f"{e}.x2", f"{e}.y2", px, py)


def sides_of(a: str, b: str) -> dict[str, str]:
    """On which sides the ends of two segments lie: a's ends of b (a1, a2), b's ends of a (b1, b2)."""
    return {
        f"{end}{n}": side(of, f"{p}.x{n}", f"{p}.y{n}")
        for end, of, p in (("a", b, a), ("b", a, b))
        for n in (1, 2)
    }


def segments_meet(a: str, b: str, sides: dict[str, str] | None = None) -> str:
    """Closed contact of two segments: boxes overlap and each straddles the other.

    `sides` are columns with the values of `sides_of`, where these are at hand.
    """
    at = sides or sides_of(a, b)

    def apart(axis: str) -> str:
        return (
            f"least({a}.{axis}1, {a}.{axis}2) <= greatest({b}.{axis}1, {b}.{axis}2) "
            f"AND least({b}.{axis}1, {b}.{axis}2) <= greatest({a}.{axis}1, {a}.{axis}2)"
        )

    straddle = " AND ".join(f"signum({at[f'{e}1']}) * signum({at[f'{e}2']}) <= 0" for e in "ba")
    return f"({apart('x')} AND {apart('y')} AND {straddle})"


def _near(px: str, py: str, e: str, limit: str, strict: bool, off: str) -> str:
    """Is a point within a distance of a segment? Free of division, so exact on grid data."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    along = f"(({px} - {e}.x1) * {dx} + ({py} - {e}.y1) * {dy})"
    span = f"({dx} * {dx} + {dy} * {dy})"
    cmp = "<" if strict else "<="

    def square(end: str) -> str:
        return f"(({px} - {e}.x{end}) * ({px} - {e}.x{end}) + ({py} - {e}.y{end}) * ({py} - {e}.y{end}))"

    return (
        f"(CASE WHEN {along} <= 0 THEN {square('1')} {cmp} {limit} "
        f"WHEN {along} >= {span} THEN {square('2')} {cmp} {limit} "
        f"ELSE {off} * {off} {cmp} {limit} * {span} END)"
    )


def segments_near(
    a: str, b: str, reach: str, strict: bool = False, sides: dict[str, str] | None = None
) -> str:
    """Do two segments come within a distance of each other?

    The distances of the four ends are one formula over an array: written out four times it
    outgrows what the JVM compiles.
    """
    limit, at = f"({reach} * {reach})", sides or sides_of(a, b)
    ends = ", ".join(
        f"named_struct('px', {p}.x{n}, 'py', {p}.y{n}, 'off', {at[f'{end}{n}']}, "
        f"'x1', {of}.x1, 'y1', {of}.y1, 'x2', {of}.x2, 'y2', {of}.y2, 'limit', {limit})"
        for end, of, p in (("a", b, a), ("b", a, b))
        for n in (1, 2)
    )
    near = _near("nr.px", "nr.py", "nr", "nr.limit", strict, "nr.off")
    return f"({segments_meet(a, b, sides)} OR exists(array({ends}), nr -> {near}))"


def crosses_ray(e: str, px: str, py: str) -> str:
    """Does an edge cross the ray from a point to the right? Lower end included."""
    return (
        f"((({e}.y1 <= {py}) != ({e}.y2 <= {py})) "
        f"AND signum({e}.y2 - {e}.y1) * {side(e, px, py)} > 0)"
    )


def crosses_ray_up(e: str, px: str, py: str, at: str | None = None) -> str:
    """Does an edge cross the ray from a point upwards? Left end included. `at`: the point's side, if at hand."""
    return (
        f"((({e}.x1 <= {px}) != ({e}.x2 <= {px})) "
        f"AND signum({e}.x2 - {e}.x1) * {at or side(e, px, py)} < 0)"
    )


def point_in_polygon(edges: str, px: str, py: str) -> str:
    """Even-odd rule with holes, left and lower borders inside."""
    return f"(size(filter({edges}, ce -> {crosses_ray('ce', px, py)})) % 2 = 1)"


def on_border(edges: str, px: str, py: str) -> str:
    return (
        f"exists({edges}, oe -> {side('oe', px, py)} = 0 "
        f"AND {px} BETWEEN least(oe.x1, oe.x2) AND greatest(oe.x1, oe.x2) "
        f"AND {py} BETWEEN least(oe.y1, oe.y2) AND greatest(oe.y1, oe.y2))"
    )


# --- overlay area -----------------------------------------------------------------


def shared_strip(a: str, b: str, base: str) -> str:
    """Contribution of two turned edges to the common area of their polygons.

    A polygon is the signed sum of the strips below its edges, hence the common area of
    two polygons is the signed sum of common strips over all pairs of edges. A common
    strip is the area below both edges over their shared x range; where they cross
    inside it, the lower envelope has a corner there.
    """

    def span(fn: str, inner: str) -> str:
        return f"{fn}({inner}({a}.x1, {a}.x2), {inner}({b}.x1, {b}.x2))"

    lo, hi = span("greatest", "least"), span("least", "greatest")

    def height(e: str, x: str) -> str:
        slope = f"try_divide({e}.y2 - {e}.y1, {e}.x2 - {e}.x1)"
        return f"({e}.y1 + ({x} - {e}.x1) * {slope} - {base})"

    al, ah, bl, bh = (height(e, x) for e in (a, b) for x in (lo, hi))
    sign = f"signum({a}.x1 - {a}.x2) * {a}.turn * signum({b}.x1 - {b}.x2) * {b}.turn"
    share = f"(({al} - {bl}) / (({al} - {bl}) - ({ah} - {bh})))"
    knee = f"({al} + {share} * ({ah} - {al}))"
    bent = (
        f"((least({al}, {bl}) + {knee}) / 2D * {share}"
        f" + ({knee} + least({ah}, {bh})) / 2D * (1D - {share}))"
    )
    plain = f"(least({al}, {bl}) + least({ah}, {bh})) / 2D"
    crossing = f"signum({al} - {bl}) * signum({ah} - {bh}) < 0"
    return (
        f"CASE WHEN {hi} <= {lo} THEN 0D WHEN {crossing} THEN {sign} * ({hi} - {lo}) * {bent} "
        f"ELSE {sign} * ({hi} - {lo}) * {plain} END"
    )
