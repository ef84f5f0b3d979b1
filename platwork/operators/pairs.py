"""Spatial candidate pairs: a range join expressed as an equi-join on bins."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platwork.functions.geometry import (
    bbox_of,
    crosses_ray_up,
    finite,
    segments_meet,
    shared_strip,
    sides_of,
    turned_edges_of,
    vertices_of,
)
from platwork.operators.batches import met_in_batches


def bin_sizes(base: float, ratio: float, levels: int) -> list[float]:
    return [base * ratio**level for level in range(levels)]


def _own_level(box: str, sizes: Sequence[float]) -> str:
    """Finest level whose bins are at least half as wide as the box."""
    extent = f"greatest({box}.xmax - {box}.xmin, {box}.ymax - {box}.ymin)"
    steps = " ".join(
        f"WHEN {extent} <= {2.0 * size}D THEN {level}" for level, size in enumerate(sizes[:-1])
    )
    return f"CASE {steps} ELSE {len(sizes) - 1} END" if steps else "0"


def _visits(own: int, top: int, left: bool) -> str:
    """The (turn, level) pairs of a box of a level, packed as 100 * turn + level."""
    if left:
        packed = [*range(own, top + 1), *([100 + own] if own else [])]
    else:
        packed = [own, *[100 + level for level in range(own + 1, top + 1)]]
    return "array(" + ", ".join(str(v) for v in packed) + ")"


def _into_bins(df: DataFrame, box: str, sizes: Sequence[float], left: bool) -> DataFrame:
    """One row per (turn, level, bin) in which the box has to be compared.

    Turn 0 pairs the right side's own level with left boxes of that level or finer;
    turn 1 pairs the left side's own level with strictly finer right boxes. A pair
    meets in exactly one of them, at the coarser of its two levels. Rows without a box
    fall out with the empty bin range.
    """
    top = len(sizes) - 1
    visits = " ".join(f"WHEN {own} THEN {_visits(own, top, left)}" for own in range(top + 1))
    size_of = " ".join(f"WHEN {level} THEN {size}D" for level, size in enumerate(sizes))
    rows = (
        df.selectExpr("*", f"explode(CASE {_own_level(box, sizes)} {visits} END) AS _visit")
        .selectExpr("*", f"CASE _visit % 100 {size_of} END AS _size")
        .selectExpr(
            "*", f"explode(sequence(floor({box}.xmin / _size), floor({box}.xmax / _size))) AS _bx"
        )
        .selectExpr(
            "*", f"explode(sequence(floor({box}.ymin / _size), floor({box}.ymax / _size))) AS _by"
        )
    )
    return rows if left else rows.drop("_size")


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows in bins for a join that shuffles both sides.

    The planner sizes them by their files, before shapes become edges and edges become rows of
    bins, which are some hundred times larger: left to it they are gathered in the driver.
    """
    return rows.hint("merge")


def bbox_pairs(
    left: DataFrame,
    right: DataFrame,
    left_box: str,
    right_box: str,
    on: Sequence[str] = ("package_id",),
    base: float = 4.0,
    ratio: float = 8.0,
    levels: int = 3,
) -> DataFrame:
    """All left x right rows whose boxes overlap (touching counts), each pair once.

    Boxes are hashed to bins of a level chosen by their own size, so the number of
    compared pairs stays in proportion to the pairs that really lie close together,
    wherever the data is dense and however unequal the shapes are. The bin key is an
    ordinary equi-join key: hot bins are split by the adaptive skew join. Column
    names of the two sides must differ except for `on`.
    """
    sizes = bin_sizes(base, ratio, levels)
    keys = [*on, "_visit", "_bx", "_by"]
    joined = _into_bins(left, left_box, sizes, True).join(
        shuffled(_into_bins(right, right_box, sizes, False)), keys
    )
    a, b = left_box, right_box
    # The bin holding the lower left corner of the common box owns the pair.
    return joined.filter(
        f"{a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax "
        f"AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax "
        f"AND floor(greatest({a}.xmin, {b}.xmin) / _size) = _bx "
        f"AND floor(greatest({a}.ymin, {b}.ymin) / _size) = _by"
    ).drop("_visit", "_bx", "_by", "_size")


def shaped(df: DataFrame, keep: Sequence[str], prefix: str, geom: str = "geom") -> DataFrame:
    """Chosen columns plus kind, part count, box and edges of a geometry, prefixed."""
    return df.select(
        *keep,
        F.expr(f"{geom}.kind").alias(f"{prefix}_kind"),
        F.expr(f"size({geom}.parts)").alias(f"{prefix}_parts"),
        F.expr(bbox_of(geom)).alias(f"{prefix}_box"),
        F.expr(turned_edges_of(geom)).alias(f"{prefix}_edges"),
    )


#: Sides of the bins of slabs, level by level.
SIDES = tuple(2.0 * 4.0**level for level in range(9))

EDGE = ("part", "ring", "seq", "x1", "y1", "x2", "y2", "turn")


#: Shapes of up to this many vertices travel as a whole and are compared edge by edge in one row.
FEW_VERTICES = 16


def outlined(df: DataFrame, keep: Sequence[str], prefix: str, geom: str = "geom") -> DataFrame:
    """One row per shape: chosen columns, kind, box, edges, and whether it may travel as a `whole`, prefixed."""
    return df.selectExpr(
        *keep,
        f"{geom}.kind AS {prefix}_kind",
        f"{bbox_of(geom)} AS {prefix}_box",
        f"{turned_edges_of(geom)} AS {prefix}_edges",
        f"size({vertices_of(geom)}) <= {FEW_VERTICES} AS {prefix}_whole",
    )


def edged(shapes: DataFrame, prefix: str) -> DataFrame:
    """One row per edge of shapes out of `outlined`: their columns, the edge's fields and its slab, prefixed.

    The slab is as wide as the edge and as high as its shape. Two shapes' edges have slabs in
    common exactly where they have to be looked at together: for contact, for the strips that
    make a common area, and for the edges above a point. So no shape of many edges travels as a whole.
    """
    x = f"{prefix}_x1, {prefix}_x2"
    return (
        _inlined(shapes.drop(f"{prefix}_whole").withColumnRenamed(f"{prefix}_box", "_own"), prefix, EDGE)
        .withColumn(
            f"{prefix}_box",
            F.expr(f"named_struct('xmin', least({x}), 'ymin', _own.ymin, 'xmax', greatest({x}), 'ymax', _own.ymax)"),
        )
        .drop("_own")
    )


def _inlined(rows: DataFrame, prefix: str, fields: Sequence[str]) -> DataFrame:
    """One row per edge of the array that a row carries, its fields prefixed."""
    kept = [c for c in rows.columns if c != f"{prefix}_edges"]
    return rows.selectExpr(*kept, f"inline({prefix}_edges) AS ({', '.join(f'{prefix}_{f}' for f in fields)})")


class Extent(NamedTuple):
    """Of the shapes of a table: which levels their boxes have, across and up (a bit each), and whether
    any of them must not travel as a whole."""

    across: int
    up: int
    many: bool


def _levels(mask: int) -> list[int]:
    return [level for level in range(len(SIDES)) if mask >> level & 1] or [0]


def _measures(box: str, whole: str, of: str = "true") -> list[str]:
    def mask(axis: str) -> str:
        size = f"{box}.{axis}max - {box}.{axis}min"
        steps = " ".join(f"WHEN {size} <= {side}D THEN {1 << n}" for n, side in enumerate(SIDES[:-1]))
        level = f"CASE WHEN {box} IS NULL THEN 0 {steps} ELSE {1 << len(SIDES) - 1} END"
        return f"coalesce(bit_or(if({of}, {level}, 0)), 0)"

    return [mask("x"), mask("y"), f"coalesce(bool_or({of} AND NOT {whole}), false)"]


def extent(df: DataFrame, geom: str = "geom") -> Extent:
    """What the shapes of a table need of bins; one pass over their boxes."""
    rows = df.selectExpr(f"{bbox_of(geom)} AS b", f"size({vertices_of(geom)}) <= {FEW_VERTICES} AS whole")
    return Extent(*rows.selectExpr(*_measures("b", "whole")).first())


def _extents(left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[Extent, Extent]:
    """The same for both sides, in one job."""
    both = left.selectExpr(f"{a}_box AS b", f"{a}_whole AS whole", "0 AS tag").unionByName(
        right.selectExpr(f"{b}_box AS b", f"{b}_whole AS whole", "1 AS tag")
    )
    found = both.selectExpr(*(m for t in (0, 1) for m in _measures("b", "whole", f"tag = {t}"))).first()
    return Extent(*found[:3]), Extent(*found[3:])


def _into_slabs(
    df: DataFrame, box: str, levels: Sequence[list[int]], others: Sequence[list[int]], left: bool
) -> DataFrame:
    """One row per bin in which a slab has to be compared; turns and levels go axis by axis (see `_into_bins`).

    No level is visited but those that the other side's slabs can have.
    """
    rows = df
    for axis, own_levels, other in zip("xy", levels, others):
        top = own_levels[-1]
        visits = [
            # Left ones meet all of the other side's levels from their own on, and lower ones at their own.
            [*[level for level in other if level >= own], *([100 + own] if other[0] < own else [])] if left
            else [*([own] if other[0] <= own else []), *[100 + level for level in other if level > own]]
            for own in range(top + 1)
        ]
        packed = ["array(" + ", ".join(map(str, v)) + ")" if v else "CAST(array() AS array<int>)" for v in visits]
        steps = " ".join(
            f"WHEN {box}.{axis}max - {box}.{axis}min <= {SIDES[own]}D THEN {packed[own]}" for own in range(top)
        )
        every = f"CASE {steps} ELSE {packed[top]} END" if steps else packed[top]
        side_of = f"(2D * pow(4D, _v{axis} % 100))"
        low, high = f"floor({box}.{axis}min / {side_of})", f"floor({box}.{axis}max / {side_of})"
        rows = rows.selectExpr("*", f"explode({every}) AS _v{axis}").selectExpr(
            "*", f"explode(sequence({low}, {high})) AS _b{axis}"
        )
    return rows


def edge_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, on: Sequence[str] = ("package_id",),
    extents: tuple[Extent, Extent] | None = None, exact: bool = False,
) -> DataFrame:
    """All left x right rows whose slabs (columns a_box and b_box) overlap (touching counts), each pair once.

    Bins are hashed per axis at a level of the slab's own width and height, so a long or tall
    shape costs rows in proportion to its outline, and edges meet only the few others above or
    below them. No level is visited beyond the highest that the data has, or, if `extents` are
    `exact` for these very boxes, none that it hasn't. Column names of the two sides must differ
    except for `on`.
    """
    keys = [*on, "_vx", "_vy", "_bx", "_by"]
    if extents is None:
        extents = _extents(left.withColumn(f"{a}_whole", F.lit(True)), right.withColumn(f"{b}_whole", F.lit(True)), a, b)
        exact = True
    a, b = f"{a}_box", f"{b}_box"
    of_a, of_b = ([_levels(e.across), _levels(e.up)] for e in extents)
    if not exact:
        of_a, of_b = ([list(range(levels[-1] + 1)) for levels in of] for of in (of_a, of_b))
    same = " AND ".join(
        f"{a}.{axis}min <= {b}.{axis}max AND {b}.{axis}min <= {a}.{axis}max "
        # The bin with the lower end of what is common owns the pair.
        f"AND floor(greatest({a}.{axis}min, {b}.{axis}min) / (2D * pow(4D, _v{axis} % 100))) = _b{axis}"
        for axis in "xy"
    )
    joined = _into_slabs(left, a, of_a, of_b, True).join(
        shuffled(_into_slabs(right, b, of_b, of_a, False)), keys
    )
    return joined.filter(same).drop("_vx", "_vy", "_bx", "_by")


def outline_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, edges_of_left: Callable[[DataFrame], DataFrame],
    a_fields: Sequence[str] = EDGE, pad: str = "0D", extents: tuple[Extent, Extent] | None = None,
) -> DataFrame:
    """Left x right edges of shapes that lie together and, padded, have any x in common, each pair once.

    Shapes of few vertices meet as a whole, by their boxes, and a pair's edges come out of its one
    row; what has more goes through the join edge by edge. `extents` are those of both tables (see
    `extent`), where they are costly to read twice.
    """
    extents = extents or _extents(left, right, a, b)
    low, high = f"least({a}_x1, {a}_x2) - {pad}", f"greatest({a}_x1, {a}_x2) + {pad}"
    found = _inlined(whole_pairs(left, right, a, b, extents), a, a_fields).filter(
        f"{low} <= {b}_box.xmax AND {high} >= {b}_box.xmin"
    )
    found = _inlined(found, b, EDGE)
    for more in _long_pairs(left, right, a, b, edges_of_left, extents):
        found = found.unionByName(more)
    return found.filter(f"{low} <= greatest({b}_x1, {b}_x2) AND {high} >= least({b}_x1, {b}_x2)")


def whole_pairs(left: DataFrame, right: DataFrame, a: str, b: str, extents: tuple[Extent, Extent]) -> DataFrame:
    """Pairs of shapes that travel whole and whose boxes overlap, one row each."""

    def part(df: DataFrame, prefix: str, of: Extent) -> DataFrame:
        return (df.filter(f"{prefix}_whole") if of.many else df).drop(f"{prefix}_whole")

    short = [part(df, p, of) for df, p, of in zip((left, right), (a, b), extents)]
    return edge_pairs(*short, a, b, extents=extents, exact=True)


def _long_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, edges_of_left: Callable[[DataFrame], DataFrame],
    extents: tuple[Extent, Extent],
) -> list[DataFrame]:
    """Pairs of edges of all other shapes."""
    more = []
    if extents[0].many:
        more.append((left.filter(f"NOT {a}_whole"), right))
    if extents[1].many:
        more.append((left.filter(f"{a}_whole"), right.filter(f"NOT {b}_whole")))
    return [edge_pairs(edges_of_left(one), edged(other, b), a, b, extents=extents) for one, other in more]


def _flat(predicate: str, *prefixes: str) -> str:
    """A predicate on structs a, b, ... as one on columns a_x1, b_x1, ..."""
    for p in prefixes:
        predicate = re.sub(rf"\b{p}\.(?=({'|'.join(EDGE)})\b)", f"{p}_", predicate)
    return predicate


SIDE = {name: f"_side_{name}" for name in ("a1", "a2", "b1", "b2")}


def _with_sides(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Edge pairs with the values of `sides_of`, each worked out once; keeps the compiled code short."""
    return pairs.selectExpr("*", *(f"{_flat(side, a, b)} AS {SIDE[name]}" for name, side in sides_of(a, b).items()))


def shape_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[str], with_area: bool = True,
    ordered: bool = False, extents: tuple[Extent, Extent] | None = None,
    with_form: bool = False,
) -> DataFrame:
    """Pairs of shapes that meet (touching counts), with the area they have in common.

    The last two keys name the shapes; with `ordered` only pairs with the first below the second
    are compared, as for one table with itself, and `with_form` tells whether any of their edges
    run `along` each other, which is more than single points.

    Both sides come from `outlined` with prefixes a and b. Shapes meet by contact of any two edges,
    or where the first vertex of a part of one lies inside the other, which is the parity of the
    edges above it, part by part. Pairs of short shapes are told in their one row, in batches;
    the edge pairs of the others are folded by one aggregate with map-side combine.
    """
    extents = extents or _extents(left, right, a, b)
    below = f"{keys[-2]} < {keys[-1]}" if ordered else "true"
    whole = whole_pairs(left, right, a, b, extents).filter(below).selectExpr(
        *keys,
        *(f"{p}_edges AS {own}_edges" for p, own in zip((a, b), "ab")),
        *(f"{p}_kind = 'polygon' AS {own}_polygon" for p, own in zip((a, b), "ab")),
        f"greatest({a}_box.ymin, {b}_box.ymin) AS base",
    )
    schema = T.StructType([*(whole.schema[k] for k in keys), T.StructField("common_area", T.DoubleType()), T.StructField("along", T.BooleanType())])
    found = whole.mapInArrow(partial(met_in_batches, keys=list(keys)), schema)
    for more in _long_pairs(left, right, a, b, lambda many: edged(many, a), extents):
        found = found.unionByName(_folded(more.filter(below), a, b, keys, with_area, with_form))
    # A key may name several rows.
    told = [F.sum("common_area").alias("common_area")] if with_area else []
    told += [F.bool_or("along").alias("along")] if with_form else []
    return found.groupBy(*keys).agg(*told) if told else found.select(*keys).distinct()


def _folded(met: DataFrame, a: str, b: str, keys: Sequence[str], with_area: bool, with_form: bool) -> DataFrame:
    """Keys, common_area and along of the pairs of shapes that meet, out of their pairs of edges."""

    def above(of: str, point: str, at: str) -> str:
        start = f"{point}_seq = 0 AND {point}_ring = 0 AND {of}_kind = 'polygon'"
        ray = _flat(crosses_ray_up(of, f"{point}.x1", f"{point}.y1", at), of, point)
        return f"CASE WHEN {start} AND {ray} THEN xxhash64({point}_part) ELSE 0L END"

    # Over a one-element array, or the formula outgrows what the JVM compiles.
    both = ", ".join(f"'{p}', named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, {p}_{f}' for f in EDGE[3:])})" for p in (a, b))
    base = f"greatest({a}_box.ymin, {b}_box.ymin)"
    strip = f"transform(array(named_struct({both}, 'base', {base})), st -> {shared_strip(f'st.{a}', f'st.{b}', 'st.base')})[0]"
    level = " AND ".join(f"{c} = 0" for c in SIDE.values())
    stretch = " OR ".join(
        f"least(greatest({a}_{c}1, {a}_{c}2), greatest({b}_{c}1, {b}_{c}2)) > greatest(least({a}_{c}1, {a}_{c}2), least({b}_{c}1, {b}_{c}2))"
        for c in "xy"
    )
    along = f"{level} AND {_flat(segments_meet(a, b, SIDE), a, b)} AND ({stretch})"
    low, high = f"least({a}_x1, {a}_x2)", f"greatest({a}_x1, {a}_x2)"
    beside = f"{low} <= greatest({b}_x1, {b}_x2) AND {high} >= least({b}_x1, {b}_x2)"
    rows = _with_sides(met.filter(beside), a, b).selectExpr(
        *keys,
        f"{_flat(segments_meet(a, b, SIDE), a, b)} AS meet",
        f"{above(b, a, SIDE['a1'])} AS in_b",
        f"{above(a, b, SIDE['b1'])} AS in_a",
        f"CASE WHEN {a}_kind = 'polygon' AND {b}_kind = 'polygon' THEN {strip} ELSE 0D END AS strip"
        if with_area
        else "0D AS strip",
        f"{along} AS along" if with_form else "false AS along",
    )
    # Each part above which the other shape has an odd number of edges leaves its hash.
    found = [F.bool_or("meet").alias("_meet"), F.bit_xor("in_b").alias("_in_b"), F.bit_xor("in_a").alias("_in_a")]
    # What says nothing of its pair is left out before the shuffle.
    return (
        rows.filter("meet OR in_b != 0 OR in_a != 0 OR strip != 0")
        .groupBy(*keys)
        .agg(
            *found, F.sum("strip").alias("common_area"), F.bool_or("along").alias("along")
        )
        .filter("_meet OR _in_b != 0 OR _in_a != 0")
        .drop("_meet", "_in_b", "_in_a")
    )


def segments_near(a: Sequence[np.ndarray], b: Sequence[np.ndarray], reach: np.ndarray) -> np.ndarray:
    """`functions.geometry.segments_near` on columns x1, y1, x2, y2 of two segments a row: the same steps in the same order."""

    def side(e: Sequence[np.ndarray], px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return (e[2] - e[0]) * (py - e[1]) - (e[3] - e[1]) * (px - e[0])

    limit = reach * reach
    found = np.zeros(len(reach), bool)
    meet = np.ones(len(reach), bool)
    for c in (0, 1):
        meet &= np.minimum(a[c], a[c + 2]) <= np.maximum(b[c], b[c + 2])
        meet &= np.minimum(b[c], b[c + 2]) <= np.maximum(a[c], a[c + 2])
    for e, other in ((b, a), (a, b)):
        dx, dy = e[2] - e[0], e[3] - e[1]
        span = dx * dx + dy * dy
        signs = np.ones(len(reach))
        for n in (0, 2):
            px, py = other[n], other[n + 1]
            off = side(e, px, py)
            signs *= np.sign(off)
            along = (px - e[0]) * dx + (py - e[1]) * dy
            first = (px - e[0]) * (px - e[0]) + (py - e[1]) * (py - e[1])
            last = (px - e[2]) * (px - e[2]) + (py - e[3]) * (py - e[3])
            found |= np.where(along <= 0, first <= limit, np.where(along >= span, last <= limit, off * off <= limit * span))
        meet &= signs <= 0
    return found | meet


def _near_in_batches(
    ax1: pd.Series, ay1: pd.Series, ax2: pd.Series, ay2: pd.Series,
    bx1: pd.Series, by1: pd.Series, bx2: pd.Series, by2: pd.Series, reach: pd.Series,
) -> pd.Series:
    a, b = ([c.to_numpy(float) for c in e] for e in ((ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2)))
    return pd.Series(segments_near(a, b, reach.to_numpy(float)))


def line_pairs(
    lines: DataFrame, shapes: DataFrame, reach: str, keys: Sequence[str], pad: str | None = None
) -> DataFrame:
    """Lines x polygons within a distance of each other, limit included: their `keys`, once a pair.

    Lines of many vertices enter the join segment by segment, so a long one is compared only along
    its course. `lines` has package_id, c_edges and further columns; `shapes` comes from `outlined`
    with prefix s. `reach` and `keys` (columns or expressions with AS) may use columns of either
    side; `pad` is the greatest reach in columns of the lines alone, where `reach` uses others.
    """
    pad = pad or reach
    kept = [c for c in lines.columns if c != "c_edges"]
    fields = EDGE[:-1]
    ends = [(end, fn, sign, axis) for end, fn, sign in (("min", "least", "-"), ("max", "greatest", "+")) for axis in "xy"]
    start = ", ".join(f"'{axis}{end}', double('{'' if end == 'min' else '-'}Infinity')" for end, _, _, axis in ends)
    step = ", ".join(f"'{axis}{end}', {fn}(bx.{axis}{end}, ed.{axis}1, ed.{axis}2)" for end, fn, _, axis in ends)
    around = ", ".join(f"'{axis}{end}', _own.{axis}{end} {sign} _pad" for end, _, sign, axis in ends)
    sound = " AND ".join(finite(f"_own.{axis}{end}") for end, _, _, axis in ends)
    whole = (
        lines.selectExpr(
            *kept, f"{pad} AS _pad", "c_edges AS a_edges",
            f"aggregate(c_edges, named_struct({start}), (bx, ed) -> named_struct({step})) AS _own",
        )
        .selectExpr("*", f"named_struct({around}) AS a_box", f"coalesce(size(a_edges) < {FEW_VERTICES} AND {sound}, false) AS a_whole")
        .drop("_own")
    )
    box = ", ".join(f"'{axis}{end}', {fn}(a_{axis}1, a_{axis}2) {sign} _pad" for end, fn, sign, axis in ends)

    def segments(many: DataFrame) -> DataFrame:
        own = _inlined(many.drop("a_whole", "a_box"), "a", fields)
        return own.withColumn("a_box", F.expr(f"named_struct({box})"))

    names = [k.rsplit(" AS ", 1)[-1] for k in keys]
    beside = "least(s_y1, s_y2) <= greatest(a_y1, a_y2) + _pad AND greatest(s_y1, s_y2) >= least(a_y1, a_y2) - _pad"
    met = outline_pairs(whole, shapes, "a", "s", segments, fields, "_pad")
    ends = [f"{p}_{f}" for p in "as" for f in ("x1", "y1", "x2", "y2")]
    # Said not to be deterministic, or it is worked out once more for the filter.
    close = F.pandas_udf(_near_in_batches, "boolean").asNondeterministic()(*ends, "_reach")
    return (
        met.selectExpr(
            *keys,
            *ends,
            f"{reach} AS _reach",
            f"{beside} AS beside",
            # A line whose first vertex is inside needs no edge contact.
            f"a_seq = 0 AND s_kind = 'polygon' AND {_flat(crosses_ray_up('s', 'a.x1', 'a.y1'), 'a', 's')} AS ray",
        )
        .filter("beside OR ray")
        .select(*names, (F.col("beside") & close).alias("near"), "ray")
        # What says nothing of its pair is left out before the shuffle.
        .filter("near OR ray")
        .groupBy(*names)
        .agg(F.bool_or("near").alias("_near"), F.count_if("ray").alias("_rays"))
        .filter("_near OR _rays % 2 = 1")
        .drop("_near", "_rays")
    )
