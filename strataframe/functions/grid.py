"""Places on the world's grid: transverse Mercator strips and polar stereographic caps, there and back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import krueger_series, utm, wrap_longitude, zone_id

#: Fixed: WGS84 axis and flattening, UTM and UPS scales and offsets.
AXIS, FLATTENING, UTM_SCALE, UPS_SCALE = 6378137.0, 1 / 298.257223563, 0.9996, 0.994
FALSE_EAST, SOUTH, POLE = 500_000.0, 10_000_000.0, 2_000_000.0
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)


def inverse_series() -> tuple[list[float], list[float]]:
    """Fixed: coefficients of the inverse Krüger series, and from conformal to geographic latitude, to the fourth power."""
    n = FLATTENING / (2 - FLATTENING)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return beta, delta


def geographic(chi: Column) -> Column:
    """Latitude from conformal latitude, both in radians."""
    out = chi
    for j, d in enumerate(inverse_series()[1], 1):
        out = out + d * F.sin(2 * j * chi)
    return out


#: Distance from the pole of a place whose conformal colatitude has a half tangent of 1.
UPS_RADIUS = 2 * AXIS * UPS_SCALE / math.sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E))


def ups(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing on the polar stereographic cap of the latitude's hemisphere."""
    north = lat >= 0
    phi, lam = F.radians(F.abs(lat)), F.radians(lon)
    s = E * F.sin(phi)
    rho = UPS_RADIUS * F.tan(math.pi / 4 - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(E / 2))
    return POLE + rho * F.sin(lam), POLE + F.when(north, -rho).otherwise(rho) * F.cos(lam)


def central_meridian(zone: Column) -> Column:
    """Of a strip's name."""
    return F.substring(zone, 5, 2).cast("int") * 6.0 - 183


def on_grid(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds zone (the one that owns the place), easting and northing there, the southern offset added; null off the earth.

    Steps are columns of their own, so that none is computed more than once."""
    zoned = df.withColumns({"zone": zone_id(F.col(lat), F.col(lon)), "__wrapped": wrap_longitude(F.col(lon))})
    cap = F.startswith("zone", F.lit("ups"))
    strip = utm(F.col(lat), F.col("__wrapped"), F.coalesce(F.when(~cap, central_meridian(F.col("zone"))), F.lit(0.0)))
    polar = ups(F.col(lat), F.col(lon))
    both = zoned.withColumns({"__sx": strip[0], "__sy": strip[1], "__px": polar[0], "__py": polar[1]})
    known = F.col("zone").isNotNull()
    south = F.when(F.col(lat) < 0, SOUTH).otherwise(0.0)
    placed = both.withColumns({"easting": F.when(known, F.when(cap, F.col("__px")).otherwise(F.col("__sx"))), "northing": F.when(known, F.when(cap, F.col("__py")).otherwise(F.col("__sy") + south))})
    return placed.drop("__wrapped", "__sx", "__sy", "__px", "__py")


def off_grid(df: DataFrame, zone: str = "zone", easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Adds lat_back and lon_back (from -180 on) of places on the grid; null for an unknown zone. The inverse Krüger series on a
    strip, the inverse stereographic projection on a cap."""
    cap, north = F.startswith(zone, F.lit("ups")), F.endswith(zone, F.lit("n"))
    scale = UTM_SCALE * krueger_series()[0]
    rows = df.withColumns({
        "__known": F.coalesce(F.col(zone).rlike("^(utm-(0[1-9]|[1-5][0-9]|60)|ups-)[ns]$"), F.lit(False)), "__cap": cap, "__north": north,
        "__xi": (F.col(northing) - F.when(north, 0.0).otherwise(SOUTH)) / scale, "__eta": (F.col(easting) - FALSE_EAST) / scale,
        "__px": F.col(easting) - POLE, "__py": F.when(north, -1.0).otherwise(1.0) * (F.col(northing) - POLE),
    })
    xi, eta = F.col("__xi"), F.col("__eta")
    x, y = eta, xi
    for j, b in enumerate(inverse_series()[0], 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    rows = rows.withColumns({"__x": x, "__y": y})
    px, py = F.col("__px"), F.col("__py")
    rows = rows.withColumns({
        "__chi": F.when(F.col("__cap"), math.pi / 2 - 2 * F.atan(F.hypot(px, py) / UPS_RADIUS)).otherwise(F.asin(F.sin("__y") / F.cosh("__x"))),
        "__lon": F.when(F.col("__cap"), F.when((px == 0) & (py == 0), 0.0).otherwise(F.degrees(F.atan2(px, py)))).otherwise(wrap_longitude(F.when(~F.col("__cap") & F.col("__known"), central_meridian(F.col(zone))) + F.degrees(F.atan2(F.sinh("__x"), F.cos("__y"))))),
    })
    sign = F.when(F.col("__cap") & ~F.col("__north"), -1.0).otherwise(1.0)
    rows = rows.withColumns({"lat_back": F.when(F.col("__known"), sign * F.degrees(geographic(F.col("__chi")))), "lon_back": F.when(F.col("__known"), F.col("__lon"))})
    return rows.drop("__known", "__cap", "__north", "__xi", "__eta", "__px", "__py", "__x", "__y", "__chi", "__lon")
