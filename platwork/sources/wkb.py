"""WKB columns to and from the geometry struct, one Arrow batch at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from platwork.model import GEOMETRY

# --- fixed values: WKB geometry types -------------------------------------------
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)
KINDS = {
    POINT: "point",
    LINE: "line",
    POLYGON: "polygon",
    MULTI_POINT: "point",
    MULTI_LINE: "line",
    MULTI_POLYGON: "polygon",
    COLLECTION: "collection",
}

VERTEX_ARROW = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PARTS_ARROW = pa.list_(pa.list_(pa.list_(VERTEX_ARROW)))


def _read(buf: bytes, at: int, parts: list) -> tuple[int, str, bool, bool]:
    """Append the parts of the geometry at an offset; (end, kind, has_z, finite_z)."""
    order = "<" if buf[at] == 1 else ">"
    if buf[at] > 1:
        raise ValueError("byte order")
    (code,) = struct.unpack_from(order + "I", buf, at + 1)
    at += 5
    has_z, has_m = bool(code & 0x80000000), bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    code &= 0x0FFFFFFF
    has_z, has_m = has_z or code // 1000 in (1, 3), has_m or code // 1000 in (2, 3)
    code %= 1000
    width = 2 + has_z + has_m
    finite_z = True

    def run(at: int, count: int) -> tuple[int, np.ndarray]:
        nonlocal finite_z
        if at + 8 * width * count > len(buf):
            raise ValueError("truncated")
        block = np.frombuffer(buf, order + "f8", width * count, at).reshape(count, width)
        if has_z and not np.isfinite(block[:, 2]).all():
            finite_z = False
        return at + 8 * width * count, block[:, :2].astype("f8")

    def number(at: int) -> tuple[int, int]:
        return at + 4, struct.unpack_from(order + "I", buf, at)[0]

    if code == POINT:
        at, block = run(at, 1)
        if not np.isnan(block).all():
            parts.append([block])
    elif code == LINE:
        at, count = number(at)
        at, block = run(at, count)
        if count:
            parts.append([block])
    elif code == POLYGON:
        at, rings = number(at)
        shape = []
        for _ in range(rings):
            at, count = number(at)
            at, block = run(at, count)
            shape.append(block)
        if shape:
            parts.append(shape)
    elif code in KINDS:
        at, members = number(at)
        for _ in range(members):
            at, _, member_z, member_ok = _read(buf, at, parts)
            has_z, finite_z = has_z or member_z, finite_z and member_ok
    else:
        raise ValueError("type")
    return at, KINDS[code], has_z, finite_z


def _parts_array(rows: list) -> pa.Array:
    """Nested Arrow lists out of per-row lists of rings, coordinates kept as numpy runs."""
    blocks, ring_at, part_at, row_at, nulls = [], [0], [0], [0], []
    for parts in rows:
        nulls.append(parts is None)
        for rings in parts or ():
            for block in rings:
                blocks.append(block)
                ring_at.append(ring_at[-1] + len(block))
            part_at.append(len(ring_at) - 1)
        row_at.append(len(part_at) - 1)
    xy = np.concatenate(blocks) if blocks else np.empty((0, 2))
    vertices = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(ring_at, pa.int32()), vertices)
    parts = pa.ListArray.from_arrays(pa.array(part_at, pa.int32()), rings)
    return pa.ListArray.from_arrays(pa.array(row_at, pa.int32()), parts)


def _decode_batch(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    kinds, flags, parts, readable, finite = [], [], [], [], []
    for value in batch.column(column):
        raw, shape, kind, has_z, ok, fine = value.as_py(), [], None, False, True, True
        if raw is not None:
            try:
                end, kind, has_z, fine = _read(raw, 0, shape)
                ok = end == len(raw)
            except (ValueError, IndexError, struct.error, RecursionError):
                # Collections nested beyond any sense are no map records either.
                ok = False
        known = ok and raw is not None
        kinds.append(kind if known else None)
        flags.append(has_z if known else None)
        parts.append(shape if known else None)
        readable.append(ok)
        finite.append(fine)
    missing = pa.array([k is None for k in kinds])
    geom = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(flags, pa.bool_()), _parts_array(parts)],
        ["kind", "has_z", "parts"],
        mask=missing,
    )
    return pa.RecordBatch.from_arrays(
        [*batch.columns, geom, pa.array(readable), pa.array(finite)],
        [*batch.schema.names, "geom", "readable", "finite_z"],
    )


def decode_wkb(rows: DataFrame, column: str = "wkb") -> DataFrame:
    """Add geom, readable and finite_z. NULL stays a readable NULL geometry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decode_batch(batch, column)

    schema = (
        StructType.fromDDL(f"geom {GEOMETRY}, readable boolean, finite_z boolean").fields
    )
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *schema]))


def _write(kind: str, has_z: bool, parts: list) -> bytes:
    """ISO little-endian WKB; a has_z geometry gets heights of 1."""
    lift = 1000 if has_z else 0

    def block(ring: np.ndarray) -> bytes:
        if has_z:
            ring = np.column_stack([ring, np.ones(len(ring))])
        return ring.astype("<f8").tobytes()

    def polygon(rings: list) -> bytes:
        body = b"".join(struct.pack("<I", len(r)) + block(r) for r in rings)
        return struct.pack("<BII", 1, POLYGON + lift, len(rings)) + body

    def line(rings: list) -> bytes:
        ring = rings[0] if rings else np.empty((0, 2))
        return struct.pack("<BII", 1, LINE + lift, len(ring)) + block(ring)

    def point(rings: list) -> bytes:
        return struct.pack("<BI", 1, POINT + lift) + block(rings[0][:1])

    single = {"polygon": polygon, "line": line, "point": point}[kind]
    many = {"polygon": MULTI_POLYGON, "line": MULTI_LINE, "point": MULTI_POINT}[kind]
    if len(parts) == 1 or (not parts and kind != "point"):
        return single(parts[0] if parts else [])
    return struct.pack("<BII", 1, many + lift, len(parts)) + b"".join(single(p) for p in parts)


def _encode_batch(batch: pa.RecordBatch, geom: str, name: str) -> pa.RecordBatch:
    column = batch.column(geom)
    out = []
    for value in column:
        shape = value.as_py()
        if shape is None:
            out.append(None)
            continue
        parts = [
            [np.array([(v["x"], v["y"]) for v in ring]).reshape(-1, 2) for ring in part]
            for part in shape["parts"]
        ]
        out.append(_write(shape["kind"], shape["has_z"], parts))
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name]
    )


def with_wkb(rows: DataFrame, geom: str = "geom", name: str = "wkb") -> DataFrame:
    """Add the WKB form of a geometry column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _encode_batch(batch, geom, name)

    return rows.mapInArrow(
        run, StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} binary").fields])
    )
