"""Small tables for the tests."""

from platwork.functions.geometry import ring_geom
from platwork.model import GEOMETRY


def polygon(*rings, has_z=False):
    return ("polygon", has_z, [[[(float(x), float(y)) for x, y in ring] for ring in rings]])


def box(x0, y0, x1, y1, has_z=False):
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], has_z=has_z)


def line(*points):
    return ("line", False, [[[(float(x), float(y)) for x, y in points]]])


def point(x, y):
    return ("point", False, [[[(float(x), float(y))]]])


BOWTIE = polygon([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)])


def records(spark, shapes, layer="layer"):
    rows = [("p", layer, str(name), geom) for name, geom in shapes.items()]
    schema = f"package_id string, layer string, source_record_id string, geom {GEOMETRY}"
    return spark.createDataFrame(rows, schema)


def grids(spark, *rows):
    """rows: role, width, height, cell, left, top."""
    full = [
        (1, role, role, w, h, float(cell), 0.0, float(left), 0.0, -float(cell), float(top),
         "EPSG:32631", -9999.0, "float32", "m", 1)
        for role, w, h, cell, left, top in rows
    ]
    return spark.createDataFrame(
        full,
        "package_id long, role string, grid_id string, width int, height int, a double, b double, "
        "c double, d double, e double, f double, crs string, nodata double, dtype string, "
        "band_unit string, band_count int",
    )


def cells(spark, grid_id, matrix, mask=None):
    rows = [
        (1, grid_id, r, c, float(v), 255 if mask is None else mask[r][c])
        for r, line_ in enumerate(matrix)
        for c, v in enumerate(line_)
    ]
    return spark.createDataFrame(
        rows, "package_id long, grid_id string, row int, col int, value float, mask int"
    )


__all__ = ["ring_geom", "polygon", "box", "line", "point", "records", "grids", "cells", "BOWTIE"]
