"""Footprints of granules against an area, and names against the metadata they should agree with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_reason, name_time, shoelace, utm

#: Square kilometres that one granule may cover.
MOST_KM2 = 100_000
#: Fixed: letters of latitude bands, eight degrees each from 80 south.
BANDS = "CDEFGHJKLMNPQRSTUVWX"


def ring_numbers(ring: Column) -> Column:
    """The numbers of a ring's text, null for what is none."""
    return F.transform(F.filter(F.split(ring, r"\s+"), lambda v: v != ""), lambda v: v.try_cast("double"))


def ring_vertices(numbers: Column) -> Column:
    """Vertices (x, y) of latitude and longitude in turn; a last one that repeats the first is left out."""
    n = F.floor(F.size(numbers) / 2)
    points = F.when(n < 1, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(F.get(numbers, 2 * i + 1).alias("x"), F.get(numbers, 2 * i).alias("y"))))
    return F.when((n > 1) & (F.get(numbers, F.lit(0)) == F.get(numbers, (2 * n - 2).cast("int"))) & (F.get(numbers, F.lit(1)) == F.get(numbers, (2 * n - 1).cast("int"))), F.slice(points, 1, (n - 1).cast("int"))).otherwise(points)


def ring_edges(points: Column) -> Column:
    """Sides (i, a, b) of a ring."""
    n = F.size(points)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _between(a: Column, b: Column, c: Column) -> Column:
    """Whether c, on the line through a and b, lies between them."""
    return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def meet(e: Column, f: Column) -> Column:
    """Whether two sides have a point in common."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    turns = F.struct(_turn(a, b, c).alias("c"), _turn(a, b, d).alias("d"), _turn(c, d, a).alias("a"), _turn(c, d, b).alias("b"))

    def decide(t: Column) -> Column:
        on = ((t["c"] == 0) & _between(a, b, c)) | ((t["d"] == 0) & _between(a, b, d)) | ((t["a"] == 0) & _between(c, d, a)) | ((t["b"] == 0) & _between(c, d, b))
        return ((t["c"] * t["d"] < 0) & (t["a"] * t["b"] < 0)) | on

    return F.exists(F.array(turns), decide)  # the turns once, for all conditions


def _folds(e: Column, f: Column) -> Column:
    """Whether a side goes back along the one before it."""
    a, b, c = e["a"], e["b"], f["b"]
    return (_turn(a, b, c) == 0) & ((b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"]) <= 0)


def crosses_itself(edges: Column) -> Column:
    """Whether sides that aren't neighbours meet, or neighbours fold back on each other."""
    n = F.size(edges)

    def pair(e: Column, f: Column) -> Column:
        return (e["i"] < f["i"]) & F.when(f["i"] == e["i"] + 1, _folds(e, f)).when(f["i"] - e["i"] == n - 1, _folds(f, e)).otherwise(meet(e, f))

    return F.exists(edges, lambda e: F.exists(edges, lambda f: pair(e, f)))


def holds(edges: Column, p: Column) -> Column:
    """Whether a ring holds a point (even-odd rule)."""

    def side(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        return spans & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(edges, lambda e: F.coalesce(side(e), F.lit(False)))) % 2 == 1


def rings_meet(edges: Column, others: Column) -> Column:
    """Whether two simple polygons have a point in common: sides that meet, or one inside the other."""
    return F.exists(edges, lambda e: F.exists(others, lambda f: meet(e, f))) | holds(others, F.get(edges, F.lit(0))["a"]) | holds(edges, F.get(others, F.lit(0))["a"])


def box_ring(box: Column) -> Column:
    """``south west north east`` as a ring's text; one that isn't a box is kept as it is, and so malformed."""
    v = ring_numbers(box)
    at = lambda k: F.get(v, F.lit(k))
    good = (F.size(v) == 4) & (at(1) < at(3)) & (at(0) < at(2))
    text = F.concat_ws(" ", *(x.cast("string") for k in ((0, 1), (0, 3), (2, 3), (2, 1)) for x in (at(k[0]), at(k[1]))))
    return F.when(F.coalesce(good, F.lit(False)), text).otherwise("")


def footprint_issues(df: DataFrame, keys: Sequence[str], rings: str, area: str, *, boxes: str | None = None, tile: str | None = None, most_km2: float = MOST_KM2) -> DataFrame:
    """keys, status and issues (joined by ``;``) of each granule's footprint.

    ``rings``: an array of texts, latitude and longitude in turn; ``boxes``: an array of ``south west north east``; ``area``: the
    ring of the area that the granule should cover. A footprint that can't be read has its first problem as only issue
    (malformed_ring, out_of_range, antimeridian, invalid_topology, no_geometry); else any of no_intersection,
    implausible_area (on the area's own strip; rings are added up), invalid_tile and tile_inconsistent. Rings are rows here, so
    an entry may have any number of them; a ring's sides are compared within its row. Repeated keys are one granule.
    """
    keys = list(keys)
    none = F.array().cast("array<string>")
    texts = F.concat(F.coalesce(F.col(rings), none), F.transform(F.coalesce(F.col(boxes), none), box_ring) if boxes else none)
    home = df.select(*keys, F.posexplode_outer(texts).alias("__nth", "__ring"), F.col(area).alias("__area"), (F.col(tile) if tile else F.lit(None).cast("string")).alias("__tile"))
    rows = home.withColumns({"__v": ring_numbers(F.col("__ring")), "__home": ring_edges(ring_vertices(ring_numbers(F.col("__area"))))})
    rows = rows.withColumn("__p", ring_vertices(F.col("__v")))
    xs, ys = F.transform("__p", lambda p: p["x"]), F.transform("__p", lambda p: p["y"])
    malformed = F.col("__ring").isNull() | (F.size("__v") < 8) | (F.size("__v") % 2 == 1) | F.exists("__v", lambda v: v.isNull() | F.isnan(v)) | (F.size("__p") < 3)
    rows = rows.withColumns({"__malformed": F.coalesce(malformed, F.lit(True)), "__x": xs, "__y": ys})
    outside = F.exists("__x", lambda x: F.abs(x) > 180) | F.exists("__y", lambda y: F.abs(y) > 90)
    problems = [(F.col("__nth").isNull(), "no_geometry"), (F.col("__malformed"), "malformed_ring"), (outside, "out_of_range"), (F.array_max("__x") - F.array_min("__x") > 180, "antimeridian")]
    rows = rows.withColumn("__problem", first_reason(problems))
    edges = ring_edges(F.col("__p"))
    rows = rows.withColumn("__edges", F.when(F.col("__problem").isNull(), edges))
    rows = rows.withColumn("__problem", F.coalesce("__problem", F.when(crosses_itself(F.col("__edges")), "invalid_topology")))
    rows = rows.withColumn("__edges", F.when(F.col("__problem").isNull(), F.col("__edges")))
    middle = F.array_max(F.transform("__home", lambda e: e["a"]["x"]))
    rows = rows.withColumn("__central", F.floor((middle + 180) / 6) * 6.0 - 177)
    rows = rows.withColumn("__m", F.when(F.col("__problem").isNull(), F.transform("__p", lambda p: F.struct(*(c.alias(k) for k, c in zip("xy", utm(p["y"], p["x"], F.col("__central")), strict=True))))))
    km2 = F.abs(shoelace(F.transform("__m", lambda p: p["x"]), F.transform("__m", lambda p: p["y"]))) / 1e6
    rows = rows.withColumns({"__meets": F.when(F.col("__problem").isNull(), rings_meet(F.col("__edges"), F.col("__home"))), "__km2": F.when(F.col("__problem").isNull(), km2)})
    zone, band = F.substring("__tile", 1, 2).try_cast("int"), F.instr(F.lit(BANDS), F.substring("__tile", 3, 1))
    bad_tile = F.col("__tile").isNotNull() & ~F.coalesce(zone.between(1, 60) & (band > 0) & (F.length("__tile") >= 3), F.lit(False))
    west, south = (zone - 1) * 6.0 - 180, -80 + (band - 1) * 8.0
    lons, lats = F.transform("__home", lambda e: e["a"]["x"]), F.transform("__home", lambda e: e["a"]["y"])
    apart = (F.array_max(lons) < west - 3) | (F.array_min(lons) > west + 9) | (F.array_max(lats) < south - 2) | (F.array_min(lats) > F.least(south + 10, F.lit(86.0)))
    rows = rows.withColumns({"__bad_tile": bad_tile, "__apart": F.col("__tile").isNotNull() & ~bad_tile & F.coalesce(apart, F.lit(False))})
    each = rows.groupBy(*keys).agg(F.min_by("__problem", F.when(F.col("__problem").isNotNull(), F.col("__nth"))).alias("__first"), F.max(F.when(F.col("__problem") == "no_geometry", True)).alias("__none"), F.max("__meets").alias("__meets"), F.sum("__km2").alias("__km2"), F.max("__bad_tile").alias("__bad_tile"), F.max("__apart").alias("__apart"))
    large = ~F.coalesce((F.col("__km2") <= most_km2) & ~F.isnan("__km2"), F.lit(False))
    listed = F.concat_ws(";", F.when(~F.col("__meets"), "no_intersection"), F.when(large, "implausible_area"), F.when(F.col("__bad_tile"), "invalid_tile"), F.when(F.col("__apart"), "tile_inconsistent"))
    issues = F.coalesce(F.when(F.col("__none"), "no_geometry"), "__first", listed)
    return each.select(*keys, F.when(issues == "", "metadata_consistent").otherwise("review_required").alias("status"), issues.alias("issues"))


def name_identity(df: DataFrame, name: str, start: str, pattern: str, version: str, *, groups: tuple[int, int] = (1, 2), seconds: float = 2.0) -> DataFrame:
    """Adds named_time and name_status: unrecognised_name, version_differs, time_differs (by ``seconds`` or more from the start that
    the metadata has), no_start or consistent. ``groups``: those of the pattern that hold the version and the time."""
    said, at = F.regexp_extract(name, pattern, groups[0]), name_time(F.regexp_extract(name, pattern, groups[1]))
    out = df.withColumns({"__known": F.coalesce(F.col(name).rlike(pattern), F.lit(False)), "__version": said, "named_time": F.when(F.col(name).rlike(pattern), at)})
    gap = F.abs(F.unix_micros("named_time") - F.unix_micros(F.col(start))) / 1e6
    rules = [(~F.col("__known") | F.col("named_time").isNull(), "unrecognised_name"), (F.col("__version") != version, "version_differs"), (F.col(start).isNull(), "no_start"), (gap >= seconds, "time_differs")]
    return out.withColumn("name_status", F.coalesce(first_reason(rules), F.lit("consistent"))).drop("__known", "__version")
