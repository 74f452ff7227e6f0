"""Projected metres to geographic positions as one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(fields: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """Bind named values once and use them in `then`.

    Values used several times over several steps would otherwise be copied into each other wherever
    the optimizer merges projections or pushes a filter down, and the copies multiply.
    """
    bound = F.array(F.struct(*[e.alias(n) for n, e in fields.items()]))
    return F.transform(bound, then)[0]


def wgs84(easting: Column, northing: Column, zone: int = 31) -> Column:
    """Struct (latitude, longitude) of metres on the European 1950 datum.

    Inverse transverse Mercator by its series on the International 1924 ellipsoid, then a
    three-parameter geocentric shift.
    """
    a, f = 6378388.0, 1 / 297.0
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    k0 = 0.9996
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    arc = k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    wa, wf = 6378137.0, 1 / 298.257223563
    we2 = wf * (2 - wf)
    wb = wa * (1 - wf)

    def footpoint(v):
        mu = v["mu"]
        phi = (
            mu
            + F.sin(2 * mu) * (3 * e1 / 2 - 27 * e1**3 / 32)
            + F.sin(4 * mu) * (21 * e1**2 / 16 - 55 * e1**4 / 32)
            + F.sin(6 * mu) * (151 * e1**3 / 96)
            + F.sin(8 * mu) * (1097 * e1**4 / 512)
        )
        return let({"x": v["x"], "phi": phi}, radii)

    def radii(v):
        den = 1 - e2 * F.sin(v["phi"]) * F.sin(v["phi"])
        return let(
            {"x": v["x"], "phi": v["phi"], "den": den, "cos": F.cos(v["phi"]), "tan": F.tan(v["phi"])}, scaled
        )

    def scaled(v):
        n = F.lit(a) / F.sqrt(v["den"])
        return let(
            {
                "phi": v["phi"], "cos": v["cos"], "d": v["x"] / (n * k0),
                "lead": n * v["tan"] / (F.lit(a * (1 - e2)) / F.pow(v["den"], F.lit(1.5))),
                "c1": ep2 * v["cos"] * v["cos"], "t1": v["tan"] * v["tan"],
            },
            inverse,
        )

    def inverse(v):
        d, t1, c1 = v["d"], v["t1"], v["c1"]
        lat = v["phi"] - v["lead"] * (
            d * d / 2
            - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * F.pow(d, F.lit(4)) / 24
            + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * F.pow(d, F.lit(6)) / 720
        )
        lon = F.radians(F.lit(zone * 6.0 - 183.0)) + (
            d
            - (1 + 2 * t1 + c1) * F.pow(d, F.lit(3)) / 6
            + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * F.pow(d, F.lit(5)) / 120
        ) / v["cos"]
        return let({"lat": lat, "lon": lon}, geocentric)

    def geocentric(v):
        nn = F.lit(a) / F.sqrt(1 - e2 * F.sin(v["lat"]) * F.sin(v["lat"]))
        # mean published shift European 1950 -> WGS84, metres
        return let(
            {
                "x": nn * F.cos(v["lat"]) * F.cos(v["lon"]) - 87.0,
                "y": nn * F.cos(v["lat"]) * F.sin(v["lon"]) - 98.0,
                "z": nn * F.lit(1 - e2) * F.sin(v["lat"]) - 121.0,
            },
            polar,
        )

    def polar(v):
        p = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        return let(
            {"p": p, "z": v["z"], "lon": F.atan2(v["y"], v["x"]), "th": F.atan2(v["z"] * wa, p * wb)}, geodetic
        )

    def geodetic(v):
        lat = F.atan2(
            v["z"] + F.lit(we2 / (1 - we2) * wb) * F.pow(F.sin(v["th"]), F.lit(3)),
            v["p"] - F.lit(we2 * wa) * F.pow(F.cos(v["th"]), F.lit(3)),
        )
        return F.struct(F.degrees(lat).alias("latitude"), F.degrees(v["lon"]).alias("longitude"))

    return let({"x": easting - F.lit(500000.0), "mu": northing / F.lit(arc)}, footpoint)


def utm_to_wgs84(
    df: DataFrame, easting: str, northing: str, zone: int = 31, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Add WGS84 latitude and longitude; an unknown coordinate gives NULL for both."""
    known = F.col(easting).isNotNull() & F.col(northing).isNotNull()
    out = df.withColumn("_wgs84", F.when(known, wgs84(F.col(easting), F.col(northing), zone)))
    return out.withColumns({lat: F.col("_wgs84.latitude"), lon: F.col("_wgs84.longitude")}).drop("_wgs84")
