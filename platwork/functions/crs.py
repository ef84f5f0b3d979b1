"""Coordinate systems: a small dimension table and transverse Mercator as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: ellipsoids (semi-major axis in metres, inverse flattening) ----
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}
US_FOOT = 1200 / 3937

# --- fixed values: series in the third flattening (lowest power first) ------------
FORWARD_SERIES = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
INVERSE_SERIES = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
LATITUDE_SERIES = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175),
    (0, 0, 0, 0, 4174 / 315, -144838 / 6237),
    (0, 0, 0, 0, 0, 601676 / 22275),
)

CRS_SCHEMA = (
    "crs string, kind string, datum string, unit_factor double, lon0 double, xi0 double, "
    "e0 double, n0 double, radius double, ecc double, "
    "alpha array<double>, beta array<double>, delta array<double>"
)


def _series(table: tuple, n: float) -> list[float]:
    return [sum(c * n ** (power + 1) for power, c in enumerate(row)) for row in table]


def _meridian_angle(lat_degrees: float, ecc: float, alpha: list[float]) -> float:
    sine = math.sin(math.radians(lat_degrees))
    t = math.sinh(math.atanh(sine) - ecc * math.atanh(ecc * sine))
    xi = math.atan(t)
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha))


def _row(crs, kind, datum, ellipsoid, unit=1.0, lon0=0.0, lat0=0.0, k0=1.0, e0=0.0, n0=0.0):
    a, inverse_f = ELLIPSOIDS[ellipsoid]
    f = 1 / inverse_f
    n = f / (2 - f)
    ecc = math.sqrt(f * (2 - f))
    alpha = _series(FORWARD_SERIES, n)
    rectifying = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    xi0 = _meridian_angle(lat0, ecc, alpha) if kind == "tm" else 0.0
    return (
        crs, kind, datum, unit, lon0, xi0, e0, n0, k0 * rectifying, ecc,
        alpha, _series(INVERSE_SERIES, n), _series(LATITUDE_SERIES, n),
    )


def crs_table(spark: SparkSession) -> DataFrame:
    """All known systems: a fixed set of 126 rows, whatever the data size."""
    rows = [
        _row("EPSG:4326", "geographic", "WGS84", "WGS84", math.pi / 180),
        _row("EPSG:4269", "geographic", "NAD83", "GRS80", math.pi / 180),
        _row("EPSG:4258", "geographic", "ETRS89", "GRS80", math.pi / 180),
        _row("EPSG:3857", "projected", "WGS84", "WGS84"),
        _row("EPSG:25831", "tm", "ETRS89", "GRS80", 1.0, 3.0, 0.0, 0.9996, 500000.0),
        _row(
            "EPSG:2236", "tm", "NAD83", "GRS80", US_FOOT, -81.0, 24 + 1 / 3, 0.999941177,
            200000.0 / US_FOOT,
        ),
    ]
    for zone in range(1, 61):
        lon0 = 6.0 * zone - 183.0
        rows.append(
            _row(f"EPSG:{32600 + zone}", "tm", "WGS84", "WGS84", 1.0, lon0, 0.0, 0.9996, 5e5)
        )
        rows.append(
            _row(f"EPSG:{32700 + zone}", "tm", "WGS84", "WGS84", 1.0, lon0, 0.0, 0.9996, 5e5, 1e7)
        )
    return spark.createDataFrame(rows, CRS_SCHEMA)


def with_crs(df: DataFrame, crs: str, prefix: str) -> DataFrame:
    """Join the facts of a coordinate system column; unknown codes give NULL facts."""
    facts = crs_table(df.sparkSession)
    facts = facts.select(F.col("crs").alias(crs), F.struct(*facts.columns[1:]).alias(prefix))
    # A fixed table of about a hundred rows is safe to broadcast.
    return df.join(F.broadcast(facts), crs, "left")


def metric_crs_code(crs: Column, facts: Column) -> Column:
    """NULL for a projected metre system, else why it cannot carry areas."""
    projected = facts["kind"].isin("tm", "projected")
    metre = F.abs(facts["unit_factor"] - 1.0) <= 1e-12
    return (
        F.when(crs.isNull(), "MISSING_CRS")
        .when(facts.isNull(), "INVALID_CRS")
        .when(~projected | ~metre, "NON_METRIC_CRS")
    )


def _sum_series(series: Column, term) -> Column:
    total = F.lit(0.0)
    for j in range(1, 7):
        total = total + F.element_at(series, j) * term(j)
    return total


def tm_forward(df: DataFrame, lon: str, lat: str, facts: str, x: str, y: str) -> DataFrame:
    """Degrees to the plane of a transverse Mercator system, in its own unit.

    Steps are separate projections so that no intermediate is expanded twice.
    """
    ecc, sine = F.col(f"{facts}.ecc"), F.sin(F.radians(lat))
    lam = F.radians(F.col(lon) - F.col(f"{facts}.lon0"))
    df = df.withColumns(
        {"_t": F.sinh(F.atanh(sine) - ecc * F.atanh(ecc * sine)), "_lam": lam}
    ).withColumns(
        {
            "_xi": F.atan2("_t", F.cos("_lam")),
            "_eta": F.asinh(F.sin("_lam") / F.hypot(F.col("_t"), F.cos("_lam"))),
        }
    )
    xi, eta, alpha = F.col("_xi"), F.col("_eta"), F.col(f"{facts}.alpha")
    scale = F.col(f"{facts}.radius") / F.col(f"{facts}.unit_factor")
    east = eta + _sum_series(alpha, lambda j: F.cos(2 * j * xi) * F.sinh(2 * j * eta))
    north = xi + _sum_series(alpha, lambda j: F.sin(2 * j * xi) * F.cosh(2 * j * eta))
    return df.withColumns(
        {
            x: F.col(f"{facts}.e0") + scale * east,
            y: F.col(f"{facts}.n0") + scale * (north - F.col(f"{facts}.xi0")),
        }
    ).drop("_t", "_lam", "_xi", "_eta")


def tm_inverse(df: DataFrame, x: str, y: str, facts: str, lon: str, lat: str) -> DataFrame:
    """Plane coordinates of a transverse Mercator system back to degrees."""
    scale = F.col(f"{facts}.radius") / F.col(f"{facts}.unit_factor")
    df = df.withColumns(
        {
            "_xi": (F.col(y) - F.col(f"{facts}.n0")) / scale + F.col(f"{facts}.xi0"),
            "_eta": (F.col(x) - F.col(f"{facts}.e0")) / scale,
        }
    )
    xi, eta, beta = F.col("_xi"), F.col("_eta"), F.col(f"{facts}.beta")
    df = df.withColumns(
        {
            "_xi1": xi - _sum_series(beta, lambda j: F.sin(2 * j * xi) * F.cosh(2 * j * eta)),
            "_eta1": eta - _sum_series(beta, lambda j: F.cos(2 * j * xi) * F.sinh(2 * j * eta)),
        }
    ).withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    chi = F.col("_chi")
    latitude = chi + _sum_series(F.col(f"{facts}.delta"), lambda j: F.sin(2 * j * chi))
    return df.withColumns(
        {
            lon: F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))) + F.col(f"{facts}.lon0"),
            lat: F.degrees(latitude),
        }
    ).drop("_xi", "_eta", "_xi1", "_eta1", "_chi")


def transform_code(source: Column, target: Column) -> Column:
    """NULL when a transform stays inside one datum and between known systems."""
    return (
        F.when(source.isNull() | target.isNull(), "INVALID_CRS")
        .when(source["datum"] != target["datum"], "DATUM_OPERATION_REQUIRED")
        .when(
            ~source["kind"].isin("tm", "geographic") | (target["kind"] != "tm"),
            "CRS_TRANSFORM_UNAVAILABLE",
        )
    )
