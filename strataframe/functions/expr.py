"""Scalar functions as Column expressions: geometry, time, physics, quality bits, binning. Nothing here leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
Num = Column | float | int


def col(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def passes(condition: Column) -> Column:
    """True only where the condition holds; null does not pass."""
    return F.coalesce(condition, F.lit(False))


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """Label of the first rule whose condition holds; null where none does."""
    return F.coalesce(*(F.when(passes(c), F.lit(label)) for c, label in rules))


def all_reasons(rules: Sequence[tuple[Column, str]], separator: str = ";") -> Column:
    return F.concat_ws(separator, *(F.when(passes(c), F.lit(label)) for c, label in rules))


def ladder(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds, else the default."""
    return F.coalesce(*(F.when(passes(c), F.lit(v)) for c, v in rules), F.lit(default))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clip(c: Column, low: Num, high: Num) -> Column:
    return F.greatest(col(low), F.least(col(high), c))


# time


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def epoch_hour(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600).cast("long")


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def ceil_hour(ts: Column) -> Column:
    return F.when(floor_hour(ts) == ts, ts).otherwise(floor_hour(ts) + F.expr("INTERVAL 1 HOUR"))


def age_minutes(now: Column, then: Column) -> Column:
    return (epoch(now) - epoch(then)) / 60.0


def season(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ["DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"])), F.month(ts))


def month_index(ts: Column, from_year: int) -> Column:
    return (F.year(ts) - from_year) * 12 + F.month(ts) - 1


def month_fold(ts: Column, from_year: int, folds: int = 3) -> Column:
    return F.pmod(month_index(ts, from_year), F.lit(folds))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def local_solar_hour(ts: Column, lon: Column) -> Column:
    return F.pmod((F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0) + lon / 15.0, F.lit(24.0))


def same_season_date(day: Column, year: Column) -> Column:
    """The same calendar day of another year; 29 February becomes the 28th where there is none."""
    last = F.dayofmonth(F.last_day(F.make_date(year, F.month(day), F.lit(1))))
    return F.make_date(year, F.month(day), F.least(F.dayofmonth(day), last))


def circular_days(a: Column, b: Column, period: int = 365) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(period) - d)


def split_by_date(day: Column, stops: Sequence[tuple[str, str]], default: str) -> Column:
    """Labels of half-open periods: each (end, label) holds for days before its end."""
    return ladder([(day < F.to_date(F.lit(end)), label) for end, label in stops], default)


def cf_time(value: Column, units: Column) -> Column:
    """'<unit> since <time>' as a timestamp."""
    unit = F.regexp_extract(units, r"^(\w+) since", 1)
    scale = ladder([(unit == "seconds", 1.0), (unit == "minutes", 60.0), (unit == "hours", 3600.0), (unit == "days", 86400.0)], None)
    base = F.try_to_timestamp(F.regexp_extract(units, r"since (\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d:\d\d)?)", 1))
    return F.timestamp_micros((F.unix_micros(base) + value * scale.cast("double") * 1e6).cast("long"))


def name_time(name: Column) -> Column:
    """Time in a granule's name: yyyyDDDHHmm (with a year's day) or yyyyMMdd'T'HHmmss."""
    day = F.regexp_extract(name, r"(?<!\d)(\d{4})(\d{3})\.?(\d{2})(\d{2})(?!\d)", 0)
    digits = F.regexp_replace(day, r"\.", "")
    julian = F.when(F.length(digits) == 11, F.make_timestamp(F.substring(digits, 1, 4).cast("int"), F.lit(1), F.lit(1), F.substring(digits, 8, 2).try_cast("int"), F.substring(digits, 10, 2).try_cast("int"), F.lit(0)) + F.make_dt_interval(F.substring(digits, 5, 3).try_cast("int") - 1))
    return F.coalesce(F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}T\d{6})", 1), F.lit("yyyyMMdd'T'HHmmss")), julian)


# geometry


def haversine_km(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance; safe at the antimeridian and for rounding beyond 1."""
    a, b, p, q = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((p - a) / 2), 2.0) + F.cos(a) * F.cos(p) * F.pow(F.sin((q - b) / 2), 2.0)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def nearest_index(lat: Column, lon: Column, per_degree: float) -> tuple[Column, Column]:
    """Row from the north and wrapped column of the nearest node of a global grid; ties go up."""
    columns = int(360 * per_degree)
    return F.floor((90 - lat) * per_degree + 0.5).cast("int"), F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) * per_degree + 0.5), F.lit(columns)).cast("int")


def half_even_cell(degrees: Column, per_degree: float) -> Column:
    """Nearest node with ties to even."""
    return F.bround(degrees * per_degree).cast("int")


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def zone_id(lat: Column, lon: Column) -> Column:
    """Owner of a place: half-open 6-degree strips by hemisphere, polar caps from 84 and below -80 degrees."""
    number = (F.floor((wrap_longitude(lon) + 180) / 6) + 1).cast("int")
    strip = F.concat(F.lit("utm-"), F.lpad(number.cast("string"), 2, "0"), F.when(lat >= 0, "n").otherwise("s"))
    return F.when((lat >= 84) & (lat <= 90), F.lit("ups-n")).when((lat >= -90) & (lat < -80), F.lit("ups-s")).when((lat >= -80) & (lat < 84), strip)


#: Fixed: WGS84 axis and flattening, UTM scale.
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def krueger_series() -> tuple[float, list[float], float]:
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, alpha, 2 * math.sqrt(n) / (1 + n)


def utm(lat: Column, lon: Column, central: Column) -> tuple[Column, Column]:
    """Easting and northing (without the southern offset) by the Krüger series, in metres."""
    radius, alpha, e = krueger_series()
    phi, lam = F.radians(lat), F.radians(lon - central)
    s = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + _K0 * radius * x, _K0 * radius * y


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed area of a polygon from its vertex arrays (not closed)."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def in_convex(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a convex polygon: all cross products of one sign (the border counts)."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get(xs, (i + 1) % n) - F.get(xs, i)) * (y - F.get(ys, i)) - (F.get(ys, (i + 1) % n) - F.get(ys, i)) * (x - F.get(xs, i)))
    return F.forall(cross, lambda c: c >= 0) | F.forall(cross, lambda c: c <= 0)


def box_distance(x: Column, y: Column, half: float, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a square cell's whole footprint to a rectangle."""
    dx = F.greatest(x0 - (x + half), (x - half) - x1, F.lit(0.0))
    dy = F.greatest(y0 - (y + half), (y - half) - y1, F.lit(0.0))
    return F.hypot(dx, dy)


# astronomy


def solar_elevation(ts: Column, lat: Column, lon: Column) -> Column:
    """Solar elevation in degrees by the published low-precision solar position formulas."""
    t = (epoch(ts) / 86400 + 2440587.5 - 2451545) / 36525
    mean_lon = F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + 0.000289 * F.sin(3 * anomaly)
    node = F.radians(125.04 - 1934.136 * t)
    ecliptic = F.radians(mean_lon + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - 0.001813 * t))) / 60) / 60 + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(ecliptic))
    y, l2 = F.pow(F.tan(tilt / 2), 2.0), 2 * F.radians(mean_lon)
    equation = 4 * F.degrees(y * F.sin(l2) - 2 * ecc * F.sin(anomaly) + 4 * ecc * y * F.sin(anomaly) * F.cos(l2) - 0.5 * y * y * F.sin(2 * l2) - 1.25 * ecc * ecc * F.sin(2 * anomaly))
    hour = F.radians(F.pmod(F.pmod(epoch(ts), F.lit(86400.0)) / 60 + equation + 4 * lon, F.lit(1440.0)) / 4 - 180)
    sine = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(hour)
    return F.degrees(F.asin(clip(sine, -1.0, 1.0)))


def light_phase(elevation: Column, day: float = 10, night: float = -6) -> Column:
    """day from ``day`` degrees up, night down to ``night``, else twilight; each use has thresholds of its own."""
    return ladder([(elevation >= day, "day"), (elevation <= night, "night")], "twilight")


SOLAR_CONSTANT = 1361.0


def toa_daily_mean(lat: Column, day_angle: Column) -> Column:
    """Daily mean top-of-atmosphere irradiance from latitude and the year's angle (radians), with polar limits."""
    x = day_angle
    decl = 0.006918 - 0.399912 * F.cos(x) + 0.070257 * F.sin(x) - 0.006758 * F.cos(2 * x) + 0.000907 * F.sin(2 * x) - 0.002697 * F.cos(3 * x) + 0.00148 * F.sin(3 * x)
    factor = 1.00011 + 0.034221 * F.cos(x) + 0.00128 * F.sin(x) + 0.000719 * F.cos(2 * x) + 0.000077 * F.sin(2 * x)
    a, b = F.sin(F.radians(lat)) * F.sin(decl), F.cos(F.radians(lat)) * F.cos(decl)
    sunset = F.when(a - b >= 0, F.lit(math.pi)).when(a + b <= 0, F.lit(0.0)).otherwise(F.acos(clip(-a / b, -1.0, 1.0)))
    return F.greatest(F.lit(0.0), SOLAR_CONSTANT * factor / math.pi * (sunset * a + b * F.sin(sunset)))


# physics and spectra


def reflectance(dn: Column) -> Column:
    return dn * 2.75e-5 - 0.2


def surface_temperature_c(dn: Column) -> Column:
    return dn * 0.00341802 + 149.0 - 273.15


def normalised_difference(a: Column, b: Column) -> Column:
    return F.when(F.abs(a + b) > 1e-6, (a - b) / (a + b))


def albedo_proxy(blue: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    return 0.356 * blue + 0.130 * red + 0.373 * nir + 0.085 * swir1 + 0.072 * swir2 - 0.0018


STEFAN_BOLTZMANN = 5.670374419e-8


def radiometric_temperature_c(up: Column, down: Column, emissivity: Num) -> Column:
    """From upwelling and downwelling longwave; null where the emitted part is not positive."""
    emitted = (up - (1 - col(emissivity)) * down) / (col(emissivity) * STEFAN_BOLTZMANN)
    return F.when((emitted > 0) & (up > 0) & (down > 0), F.pow(emitted, 0.25) - 273.15)


def component_shortwave(direct: Column, diffuse: Column, zenith_deg: Column) -> Column:
    return F.greatest(F.lit(0.0), direct * F.cos(F.radians(zenith_deg)) + diffuse)


def wind_components(direction_deg: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(direction_deg)), F.cos(F.radians(direction_deg))


def bounded_blend(first: Column, second: Column, weight: Num, cap: float) -> Column:
    """first + weight * (second - first), the change at most ``cap`` either way."""
    return first + clip(col(weight) * (second - first), -cap, cap)


# quality bits and binning


def bits(word: Column, shift: int, width: int) -> Column:
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << width) - 1))


def scene_quality_ok(pixel: Column, saturation: Column) -> Column:
    """Not fill, cloud, cirrus or shadow; cloud confidence below medium; no saturated or occluded band."""
    return (pixel.bitwiseAND(F.lit(0b11111)) == 0) & (bits(pixel, 8, 2) < 2) & (saturation.bitwiseAND(F.lit(0b1111110 | 1 << 11)) == 0)


QC_FIELDS = ("mandatory", "data", "cloud", "convergence", "opacity", "emissivity_mmd", "emissivity_error", "lst_error")


def swath_quality(qc: Column) -> dict[str, Column]:
    """Eight fields of two bits each."""
    return {name: bits(qc, 2 * i, 2) for i, name in enumerate(QC_FIELDS)}


def cut(value: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "unknown") -> Column:
    """Right-closed bins: a value equal to an edge falls below it; the last label has no upper edge."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(ladder([(value <= e, label) for e, label in zip(edges, labels, strict=False)], labels[-1]))


def air_group(temperature: Column) -> Column:
    return ladder([(temperature <= 0, "cold"), (temperature >= 30, "hot")], "mild")


def dominant(fractions: dict[str, Column], least: float = 0.5) -> Column:
    """Name of the largest fraction (the first of equals), 'other_or_mixed' below ``least``, 'unknown' where one is missing."""
    best = F.array_max(F.array(*(F.struct(v.alias("f"), F.lit(-i).alias("k"), F.lit(name).alias("name")) for i, (name, v) in enumerate(fractions.items()))))
    return F.when(~all_of([finite(v) for v in fractions.values()]), "unknown").when(best["f"] < least, "other_or_mixed").otherwise(best["name"])


#: Fixed: climate classes by code, 1 to 30; anything else is unknown.
CLIMATE_CLASSES = ("Af", "Am", "Aw", "BWh", "BWk", "BSh", "BSk", "Csa", "Csb", "Csc", "Cwa", "Cwb", "Cwc", "Cfa", "Cfb", "Cfc", "Dsa", "Dsb", "Dsc", "Dsd", "Dwa", "Dwb", "Dwc", "Dwd", "Dfa", "Dfb", "Dfc", "Dfd", "ET", "EF")


def climate_label(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CLIMATE_CLASSES)), code.cast("int") - 1), F.lit("unknown"))


def redact_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?[^#\s]*", "?[redacted]")


def safe_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def key_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def local_time(ts: Column, zone: Column | str) -> tuple[Column, Column]:
    """Civil time in a zone, and whether going back gives the same instant (false in a repeated hour's second pass)."""
    local = F.from_utc_timestamp(ts, zone)
    return local, F.to_utc_timestamp(local, zone) == ts


def acquisition_time(single: Column, range_start: Column) -> Column:
    """A granule's time: its one instant or the start of its range; null where there are both or neither."""
    return F.when(single.isNull() | range_start.isNull(), F.try_to_timestamp(F.coalesce(single, range_start)))
