"""Short shapes, many at a time: plain arithmetic on Arrow batches of whole shapes.

Each row is looked at by itself, so nothing is shuffled here; what is worked through at once is
bounded by the number of edge pairs. Longer shapes are compared edge by edge in Spark's joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from platwork.operators.graphs import has_loop

#: Edge pairs worked through at once.
AT_ONCE = 1 << 17


def opened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a column of lists, and how many each row has."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(items: pa.Array, field: str) -> np.ndarray:
    return items.field(field).to_numpy(zero_copy_only=False)


def pieces(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most AT_ONCE units of work, or one row."""
    ends, start = np.cumsum(work), 0
    while start < len(work):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


class Ends(NamedTuple):
    """Edges as columns of their ends."""

    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray

    def at(self, i: np.ndarray) -> Ends:
        return Ends(*(c[i] for c in self))

    def end(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self[2 * n - 2], self[2 * n - 1]

    def side(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Positive where a point lies to the left."""
        return (self.x2 - self.x1) * (py - self.y1) - (self.y2 - self.y1) * (px - self.x1)

    def spans(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Is a point in the edge's box?"""
        return (
            (np.minimum(self.x1, self.x2) <= px) & (px <= np.maximum(self.x1, self.x2))
            & (np.minimum(self.y1, self.y2) <= py) & (py <= np.maximum(self.y1, self.y2))
        )


def common(a: Ends, b: Ends, c: int) -> np.ndarray:
    """Length of what two edges' boxes have in common across (0) or up (1); negative if they are apart."""
    return np.minimum(np.maximum(a[c], a[c + 2]), np.maximum(b[c], b[c + 2])) - np.maximum(
        np.minimum(a[c], a[c + 2]), np.minimum(b[c], b[c + 2])
    )


# --- edges of the same record -----------------------------------------------------


class Edges(NamedTuple):
    """Edges of nonzero length of a column of `geom.parts`, numbered within their ring."""

    ends: Ends
    record: np.ndarray
    part: np.ndarray
    ring: np.ndarray
    seq: np.ndarray
    n: np.ndarray


def _edges(parts: pa.Array) -> Edges:
    rings, of_record = opened(parts)
    vertices, of_part = opened(rings)
    points, of_ring = opened(vertices)
    x, y = numbers(points, "x"), numbers(points, "y")
    ring = np.repeat(np.arange(len(of_ring)), of_ring)
    first = np.flatnonzero(ring[1:] == ring[:-1])
    first = first[(x[first] != x[first + 1]) | (y[first] != y[first + 1])]
    ring = ring[first]
    part = np.repeat(np.arange(len(of_part)), of_part)[ring]
    record = np.repeat(np.arange(len(of_record)), of_record)[part]
    seq = np.arange(len(ring)) - np.searchsorted(ring, ring)
    n = np.bincount(ring, minlength=len(of_ring))[ring]
    return Edges(Ends(x[first], y[first], x[first + 1], y[first + 1]), record, part, ring, seq, n)


class Contacts(NamedTuple):
    """Pairs of edges of the same record that touch, cross or overlap: their numbers and sides."""

    a: np.ndarray
    b: np.ndarray
    sides: dict[str, np.ndarray]
    parallel: np.ndarray
    crossing: np.ndarray


def _contacts(edges: Edges) -> Contacts:
    later = np.searchsorted(edges.record, edges.record, "right") - np.arange(len(edges.record)) - 1
    a = np.repeat(np.arange(len(later)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    one, other = edges.ends.at(a), edges.ends.at(b)
    near = (common(one, other, 0) >= 0) & (common(one, other, 1) >= 0)
    a, b = a[near], b[near]
    one, other = edges.ends.at(a), edges.ends.at(b)
    sides = {
        f"{name}{n}": np.sign(of.side(*end.end(n))) for name, of, end in (("a", other, one), ("b", one, other)) for n in (1, 2)
    }
    of_a, of_b = sides["a1"] * sides["a2"], sides["b1"] * sides["b2"]
    met = (of_a <= 0) & (of_b <= 0)
    sides = {name: s[met] for name, s in sides.items()}
    level = np.logical_and.reduce([s == 0 for s in sides.values()])
    return Contacts(a[met], b[met], sides, level, ((of_a < 0) & (of_b < 0))[met])


def _work(parts: pa.Array) -> np.ndarray:
    rings, of_record = opened(parts)
    vertices, of_part = opened(rings)
    part = np.repeat(np.arange(len(of_part)), of_part)
    record = np.repeat(np.arange(len(of_record)), of_record)[part]
    held = np.bincount(record, opened(vertices)[1], len(of_record))
    return held * held / 2 + 1


def _faulty(parts: pa.Array) -> np.ndarray:
    edges = _edges(parts)
    a, b, sides, parallel, crossing = _contacts(edges)
    one, other = edges.ends.at(a), edges.ends.at(b)
    overlap = parallel & ((common(one, other, 0) > 0) | (common(one, other, 1) > 0))
    same = edges.ring[a] == edges.ring[b]
    apart = np.abs(edges.seq[a] - edges.seq[b])
    neighbour = same & ((apart == 1) | (apart == edges.n[a] - 1))
    bad = np.where(neighbour, overlap, same | overlap | crossing)
    found = np.zeros(len(parts), bool)
    found[edges.record[a[bad]]] = True
    # Rings of a part that touch in single points: do these close a loop?
    touching = np.flatnonzero(~bad & ~same & (edges.part[a] == edges.part[b]) & ~found[edges.record[a]])
    touches = defaultdict(set)
    for i in touching:
        for name, of, end in (("a", other, one), ("b", one, other)):
            spots = [
                (end.end(n)[0][i], end.end(n)[1][i]) for n in (1, 2)
                if sides[f"{name}{n}"][i] == 0 and of.at(i).spans(end.end(n)[0][i], end.end(n)[1][i])
            ]
            if spots:
                touches[edges.record[a[i]], edges.part[a[i]]] |= {(edges.ring[a[i]], spots[0]), (edges.ring[b[i]], spots[0])}
                break
    for (record, _), own in touches.items():
        found[record] |= len(own) > 3 and has_loop(own)
    return found


def faulty(parts: pa.Array) -> pa.Array:
    """Do edges of a record cross, overlap or touch where they must not? Of a column of `geom.parts`."""
    with np.errstate(all="ignore"):
        found = [_faulty(parts.slice(i, j - i)) for i, j in pieces(_work(parts))]
    return pa.array(np.concatenate(found) if found else np.zeros(0, bool))


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _points(x: np.ndarray, y: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(POINT))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows: which differ from the one before?"""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _noded(parts: pa.Array) -> pa.Array:
    edges = _edges(parts)
    a, b, sides, _, crossing = _contacts(edges)
    one, other = edges.ends.at(a), edges.ends.at(b)
    ax, ay, bx, by = one.x2 - one.x1, one.y2 - one.y1, other.x2 - other.x1, other.y2 - other.y1
    # One formula for the crossing point, so both edges are cut at the same doubles.
    share = ((other.x1 - one.x1) * by - (other.y1 - one.y1) * bx) / (ax * by - ay * bx)
    cut = crossing & np.isfinite(share)
    px, py = (one.x1 + share * ax)[cut], (one.y1 + share * ay)[cut]
    every = np.arange(len(edges.record))
    marks = [(every, *edges.ends.end(1)), (every, *edges.ends.end(2)), (a[cut], px, py), (b[cut], px, py)]
    for cut_edge, edge, name, end in ((a, one, "b", other), (b, other, "a", one)):
        for n in (1, 2):
            on = (sides[f"{name}{n}"] == 0) & edge.spans(*end.end(n))
            marks.append((cut_edge[on], *(c[on] for c in end.end(n))))
    # Minus zero is zero.
    e, x, y = (np.concatenate(c) for c in zip(*marks))
    x, y = x + 0.0, y + 0.0
    of = edges.ends.at(e)
    along = (x - of.x1) * (of.x2 - of.x1) + (y - of.y1) * (of.y2 - of.y1)
    order = np.lexsort((y, x, along, e))
    e, x, y = e[order], x[order], y[order]
    new = _changes(e, x, y)
    e, x, y = e[new], x[new], y[new]
    i = np.flatnonzero(e[1:] == e[:-1])
    turned = (x[i] > x[i + 1]) | ((x[i] == x[i + 1]) & (y[i] > y[i + 1]))
    p, q = np.where(turned, i + 1, i), np.where(turned, i, i + 1)
    record = edges.record[e[i]]
    order = np.lexsort((y[q], x[q], y[p], x[p], record))
    p, q, record = p[order], q[order], record[order]
    starts = np.flatnonzero(_changes(record, x[p], y[p], x[q], y[q]))
    drawn = np.diff(np.append(starts, len(record)))
    p, q, record = p[starts], q[starts], record[starts]
    rows = pa.StructArray.from_arrays([_points(x[p], y[p]), _points(x[q], y[q]), pa.array(drawn)], ["start", "end", "drawn"])
    offsets = np.append(0, np.cumsum(np.bincount(record, minlength=len(parts))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


#: What `noded` makes of a record.
NODED = "array<struct<start:struct<x:double,y:double>,end:struct<x:double,y:double>,drawn:bigint>>"


def noded(parts: pa.Array) -> pa.Array:
    """Edges of each record cut at their contacts, with the number of times each piece is drawn."""
    with np.errstate(all="ignore"):
        rows = [_noded(parts.slice(i, j - i)) for i, j in pieces(_work(parts))]
    return pa.concat_arrays(rows) if rows else _noded(parts)


# --- edges of two shapes ------------------------------------------------------------


def _strips(a: Ends, b: Ends, turned: np.ndarray, base: np.ndarray) -> np.ndarray:
    """`functions.geometry.shared_strip` of two edges a row: the same steps in the same order."""
    low = np.maximum(np.minimum(a.x1, a.x2), np.minimum(b.x1, b.x2))
    high = np.minimum(np.maximum(a.x1, a.x2), np.maximum(b.x1, b.x2))
    (al, ah), (bl, bh) = ([e.y1 + (x - e.x1) * ((e.y2 - e.y1) / (e.x2 - e.x1)) - base for x in (low, high)] for e in (a, b))
    sign = np.sign(a.x1 - a.x2) * np.sign(b.x1 - b.x2) * turned
    share = (al - bl) / ((al - bl) - (ah - bh))
    knee = al + share * (ah - al)
    bent = (np.minimum(al, bl) + knee) / 2 * share + (knee + np.minimum(ah, bh)) / 2 * (1 - share)
    plain = (np.minimum(al, bl) + np.minimum(ah, bh)) / 2
    crossing = np.sign(al - bl) * np.sign(ah - bh) < 0
    return np.where(high <= low, 0.0, sign * (high - low) * np.where(crossing, bent, plain))


def shapes_met(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of shapes: do they meet, the area in common, and do any of their edges run along each other?

    Columns a_edges, b_edges, a_polygon, b_polygon and base, the height that strips stand on.
    """
    (a_edges, of_a), (b_edges, of_b) = opened(rows.column("a_edges")), opened(rows.column("b_edges"))
    polygon = [rows.column(f"{p}_polygon").to_numpy(zero_copy_only=False).astype(bool) for p in "ab"]
    base = rows.column("base").to_numpy(zero_copy_only=False)
    count = of_a * of_b
    row = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    i = (np.cumsum(of_a) - of_a)[row] + within // of_b[row]
    j = (np.cumsum(of_b) - of_b)[row] + within % of_b[row]
    every = [Ends(*(numbers(e, c) for c in Ends._fields)) for e in (a_edges, b_edges)]
    a, b = every[0].at(i), every[1].at(j)
    sides = [of.side(*end.end(n)) for of, end in ((b, a), (a, b)) for n in (1, 2)]
    meet = (common(a, b, 0) >= 0) & (common(a, b, 1) >= 0)
    for one, two in (sides[:2], sides[2:]):
        meet &= np.sign(one) * np.sign(two) <= 0
    level = np.logical_and.reduce([s == 0 for s in sides])
    along = level & meet & ((common(a, b, 0) > 0) | (common(a, b, 1) > 0))
    met = np.bincount(row, meet, len(count)) > 0
    # The first vertex of a part is inside where the other shape has an odd number of edges above it.
    for edges, own, k, e, off, of, held in (
        (a_edges, a, i, b, sides[0], polygon[1], of_a), (b_edges, b, j, a, sides[2], polygon[0], of_b)
    ):
        above = ((e.x1 <= own.x1) != (e.x2 <= own.x1)) & (np.sign(e.x2 - e.x1) * off < 0)
        owner = np.repeat(np.arange(len(count)), held)
        start = (numbers(edges, "seq") == 0) & (numbers(edges, "ring") == 0) & of[owner]
        inside = start & (np.bincount(k, above, len(edges)) % 2 == 1)
        met |= np.bincount(owner, inside, len(count)) > 0
    turned = numbers(a_edges, "turn")[i] * numbers(b_edges, "turn")[j]
    strips = np.where((polygon[0] & polygon[1])[row], _strips(a, b, turned, base[row]), 0.0)
    return met, np.bincount(row, strips, len(count)), np.bincount(row, along, len(count)) > 0


def met_in_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Keys, common_area and along of the pairs that meet."""
    for batch in batches:
        work = opened(batch.column("a_edges"))[1] * opened(batch.column("b_edges"))[1] + 1
        for start, stop in pieces(work):
            rows = batch.slice(start, stop - start)
            with np.errstate(all="ignore"):
                met, area, along = shapes_met(rows)
            kept = pa.array(met)
            columns = [rows.column(k).filter(kept) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(area[met]), pa.array(along[met])], [*keys, "common_area", "along"])
