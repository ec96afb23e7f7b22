"""Containment, overlays, block distances, stencils and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import grid as grid_places
from ..operators import joins, windows
from ..session import load
from .registry import query
from .views import GRID_SQL, SAMPLES_SQL, STATIONS_SQL, grid, samples, stations


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


_BOX_SQL = """pts AS (SELECT o_orderkey AS sample_id, o_orderdate AS ts, o_custkey % 100 * 10.0 + 5 AS x, o_orderkey % 100 * 10.0 + 5 AS y FROM orders),
cells AS (SELECT l_orderkey * 10 + l_linenumber AS cell_id, min(l_shipdate) AS s, max(l_shipdate) + INTERVAL 1 HOUR AS e, min(l_suppkey) % 97 * 10.0 AS x0, min(l_partkey) % 89 * 10.0 AS y0, min(l_quantity) AS view FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(f"""WITH {_BOX_SQL}, k AS (SELECT sample_id, cell_id, view, row_number() OVER (PARTITION BY sample_id ORDER BY e DESC, view, cell_id) AS k FROM pts JOIN cells ON x BETWEEN x0 AND x0 + 80 AND y BETWEEN y0 AND y0 + 60 AND e <= ts AND epoch(ts - s) <= 90 * 86400)
SELECT pts.sample_id, cell_id, view FROM pts LEFT JOIN k ON k.sample_id = pts.sample_id AND k = 1""")
def jn_09_causal_containment(spark: SparkSession, d: str) -> DataFrame:
    pts = load(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 100 * 10.0 + 5).alias("x"), (F.col("o_orderkey") % 100 * 10.0 + 5).alias("y"), F.lit(1).alias("region"))
    cells = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("start_ts"), (F.max("l_shipdate") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"), (F.min("l_suppkey") % 97 * 10.0).alias("x0"), (F.min("l_partkey") % 89 * 10.0).alias("y0"), F.min("l_quantity").alias("view"))
    cells = cells.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), "start_ts", "end_ts", "x0", "y0", (F.col("x0") + 80).alias("x1"), (F.col("y0") + 60).alias("y1"), "view", F.lit(1).alias("region"))
    return joins.contains_causal(pts, cells, ["region"], "sample_id", 100.0, 90 * 86400, [F.desc("end_ts"), F.col("view"), F.col("cell_id")], ["cell_id", "view"]).select("sample_id", "cell_id", "view")


_BLOCKS_SQL = "blocks AS (SELECT s_suppkey * 7 % 8 * 500.0 AS y0, s_suppkey * 7 % 8 * 500.0 + 500 AS y1, s_suppkey * 3 % 10 * 500.0 AS x0, s_suppkey * 3 % 10 * 500.0 + 500 AS x1 FROM supplier WHERE (s_suppkey * 7 % 8 + 2 * (s_suppkey * 3 % 10)) % 5 = 0)"


@query(f"WITH {GRID_SQL}, {_BLOCKS_SQL}, m AS (SELECT row, col, min(sqrt(pow(greatest(x0 - (x + 50), (x - 50) - x1, 0), 2) + pow(greatest(y0 - (y + 50), (y - 50) - y1, 0), 2))) AS dist FROM grid, blocks GROUP BY 1, 2) SELECT row, col, dist <= 200 AS in_buffer, round(CASE WHEN dist <= 200 THEN dist END, 6) AS block_distance FROM m")
def jn_16_block_distance(spark: SparkSession, d: str) -> DataFrame:
    cells = grid(spark, d).select("row", "col", "x", "y", F.lit(1).alias("region"), (F.col("row") * 1000 + F.col("col")).alias("cell"))
    blocks = load(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 8).alias("r"), (F.col("s_suppkey") * 3 % 10).alias("c")).filter((F.col("r") + 2 * F.col("c")) % 5 == 0).distinct()
    blocks = blocks.select((F.col("c") * 500.0).alias("x0"), (F.col("c") * 500.0 + 500).alias("x1"), (F.col("r") * 500.0).alias("y0"), (F.col("r") * 500.0 + 500).alias("y1"), F.lit(1).alias("region"))
    out = joins.min_block_distance(cells, blocks, ["region"], "cell", 50.0, 200.0)
    return out.select("row", "col", "in_buffer", F.round(F.when(F.col("in_buffer"), F.col("block_distance")), 6).alias("block_distance"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT s_suppkey, s_suppkey * 37 % 4500 * 1.0 AS x0, s_suppkey * 37 % 4500 + 430.0 AS x1, s_suppkey * 53 % 3500 * 1.0 AS y0, s_suppkey * 53 % 3500 + 370.0 AS y1 FROM supplier), sh AS (SELECT unnest([0.0, 30.0]) AS dx, 0.0 AS dy),
w AS (SELECT s_suppkey, dx, dy, value, size > 10 AS ok, greatest(0, least(x1 + dx, x + 50) - greatest(x0 + dx, x - 50)) * greatest(0, least(y1 + dy, y + 50) - greatest(y0 + dy, y - 50)) AS w, (x1 - x0) * (y1 - y0) AS area FROM c, sh, grid)
SELECT s_suppkey, dx, dy, round(sum(CASE WHEN ok THEN w * value END) / sum(CASE WHEN ok THEN w END), 6) AS mean, round(coalesce(sum(CASE WHEN ok THEN w END), 0) / max(area), 6) AS valid_fraction, count(*) AS cells FROM w WHERE w > 0 GROUP BY 1, 2, 3""")
def jn_18_overlay_mean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    coarse = load(spark, d, "supplier").select("s_suppkey", (k * 37 % 4500 * 1.0).alias("x0"), (k * 37 % 4500 + 430.0).alias("x1"), (k * 53 % 3500 * 1.0).alias("y0"), (k * 53 % 3500 + 370.0).alias("y1"))
    return joins.overlay_mean(grid(spark, d), coarse, 100.0, "s_suppkey", "value", F.col("size") > 10, [(0.0, 0.0), (30.0, 0.0)]).select("s_suppkey", "dx", "dy", _r("mean"), _r("valid_fraction"), "cells")


_N = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
_SUMS = "SELECT g.row, g.col, count(n.value) AS n, sum((n.col - g.col) * CASE WHEN n.row = g.row THEN 2.0 ELSE 1.0 END * n.value) AS sx, sum((n.row - g.row) * CASE WHEN n.col = g.col THEN 2.0 ELSE 1.0 END * n.value) AS sy, max(n.value) - min(n.value) AS relief FROM grid g JOIN grid n ON n.row BETWEEN g.row - 1 AND g.row + 1 AND n.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY 1, 2"


@query(f"WITH {GRID_SQL}, s AS ({_SUMS}) SELECT row, col, round(CASE WHEN n = 9 THEN degrees(atan(sqrt(pow(sx / 800, 2) + pow(sy / 800, 2)))) END, 6) AS slope_deg, round(CASE WHEN n = 9 THEN relief END, 6) AS relief FROM s")
def win_18_stencil(spark: SparkSession, d: str) -> DataFrame:
    return windows.stencil(grid(spark, d), "row", "col", "value", 100.0).select("row", "col", _r("slope_deg"), _r("relief"))


@query("SELECT p_partkey % 500 AS pixel, count(*) FILTER (WHERE p_size > 10) AS valid_scenes, round(quantile_cont(CASE WHEN p_size > 10 THEN p_retailprice END, 0.5), 6) AS composite, min(CASE WHEN p_size > 10 THEN p_size END) AS earliest, max(CASE WHEN p_size > 10 THEN p_size END) AS latest FROM part GROUP BY 1")
def agg_22_median_composite(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("p_size") > 10
    return load(spark, d, "part").groupBy((F.col("p_partkey") % 500).alias("pixel")).agg(F.count_if(ok).alias("valid_scenes"), F.round(F.median(F.when(ok, F.col("p_retailprice"))), 6).alias("composite"), F.min(F.when(ok, F.col("p_size"))).alias("earliest"), F.max(F.when(ok, F.col("p_size"))).alias("latest"))


def resample(cells: DataFrame, size: float, fine: float, value: str, valid, least: float) -> DataFrame:
    """Mean of fine cells by area over square coarse cells; a fine cell on a border counts in each by its share; null where
    less than ``least`` of the area is valid."""
    half = fine / 2
    first, last = (F.floor((F.col(a) + s * half) / size).cast("int") for a, s in (("x", -1), ("x", 1)))
    low, high = (F.floor((F.col(a) + s * half) / size).cast("int") for a, s in (("y", -1), ("y", 1)))
    parts = cells.withColumn("cx", F.explode(F.sequence(first, last))).withColumn("cy", F.explode(F.sequence(low, high)))
    width = lambda a, c: F.greatest(F.lit(0.0), F.least(F.col(a) + half, (F.col(c) + 1) * size) - F.greatest(F.col(a) - half, F.col(c) * size))
    w = width("x", "cx") * width("y", "cy")
    good = F.when(F.coalesce(valid, F.lit(False)), F.col("w"))
    share = F.coalesce(F.sum(good), F.lit(0.0)) / (size * size)
    return parts.withColumn("w", w).filter("w > 0").groupBy("cx", "cy").agg(F.when(share >= least, F.sum(good * F.col(value)) / F.sum(good)).alias("mean"), share.alias("valid_fraction"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT grid.*, cx, cy, greatest(0, least(x + 50, (cx + 1) * 250.0) - greatest(x - 50, cx * 250.0)) * greatest(0, least(y + 50, (cy + 1) * 250.0) - greatest(y - 50, cy * 250.0)) AS w FROM grid, (SELECT CAST(unnest(range(0, 21)) AS INT) AS cx), (SELECT CAST(unnest(range(0, 17)) AS INT) AS cy))
SELECT cx, cy, round(CASE WHEN coalesce(sum(CASE WHEN size > 5 THEN w END), 0) / 62500 >= 0.8 THEN sum(CASE WHEN size > 5 THEN w * value END) / sum(CASE WHEN size > 5 THEN w END) END, 6) AS mean, round(coalesce(sum(CASE WHEN size > 5 THEN w END), 0) / 62500, 6) AS valid_fraction FROM c WHERE w > 0 GROUP BY 1, 2""")
def agg_23_resample(spark: SparkSession, d: str) -> DataFrame:
    """Also the coarser export (AGG-25)."""
    return resample(grid(spark, d), 250.0, 100.0, "value", F.col("size") > 5, 0.8).select("cx", "cy", _r("mean"), _r("valid_fraction"))


@query(f"WITH {GRID_SQL} SELECT CAST(row // 5 AS INT) AS cy, CAST(col // 5 AS INT) AS cx, round(avg(CASE WHEN size BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 6) AS class_1, round(avg(CASE WHEN size BETWEEN 11 AND 25 THEN 1.0 ELSE 0.0 END), 6) AS class_2, count(*) >= 24 AS supported FROM grid GROUP BY 1, 2")
def agg_24_class_fractions(spark: SparkSession, d: str) -> DataFrame:
    share = lambda a, b: F.round(F.avg(F.when(F.col("size").between(a, b), 1.0).otherwise(0.0)), 6)
    return grid(spark, d).groupBy(F.expr("CAST(row div 5 AS INT)").alias("cy"), F.expr("CAST(col div 5 AS INT)").alias("cx")).agg(share(1, 10).alias("class_1"), share(11, 25).alias("class_2"), (F.count(F.lit(1)) >= 24).alias("supported"))


@query(f"WITH {GRID_SQL} SELECT row, col, CASE WHEN greatest(size / 100.0, (50 - size) / 60.0) < 0.5 THEN 'other_or_mixed' WHEN size / 100.0 >= (50 - size) / 60.0 THEN 'tree' ELSE 'built' END AS surface FROM grid")
def win_16_dominant_surface(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("row", "col", E.dominant({"tree": F.col("size") / 100.0, "built": (50 - F.col("size")) / 60.0}).alias("surface"))


@query(f"WITH {GRID_SQL} SELECT row - 10 AS row, col - 5 AS col, x, y, value FROM grid WHERE row BETWEEN 10 AND 29 AND col BETWEEN 5 AND 24")
def prj_05_crop(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).filter(F.col("row").between(10, 29) & F.col("col").between(5, 24)).select((F.col("row") - 10).alias("row"), (F.col("col") - 5).alias("col"), "x", "y", "value")


_QUAD = "[[0.0, 0.0], [30.0 + s_suppkey % 7, 5.0], [25.0, 40.0 + s_suppkey % 11], [-5.0, 30.0]]"


@query(f"WITH q AS (SELECT s_suppkey, {_QUAD} AS v FROM supplier), t AS (SELECT s_suppkey, v, unnest(range(1, 5)) AS i FROM q), s AS (SELECT s_suppkey, v[i][1] AS x0, v[i][2] AS y0, v[i % 4 + 1][1] AS x1, v[i % 4 + 1][2] AS y1 FROM t) SELECT s_suppkey, round(sum(x0 * y1 - x1 * y0) / 2, 6) AS area, bool_and((x1 - x0) * (s_suppkey % 50 - y0) - (y1 - y0) * (s_suppkey % 30 - x0) >= 0) AS inside FROM s GROUP BY 1")
def sc_25_quad_geometry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    xs, ys = F.array(F.lit(0.0), 30.0 + k % 7, F.lit(25.0), F.lit(-5.0)), F.array(F.lit(0.0), F.lit(5.0), 40.0 + k % 11, F.lit(30.0))
    q = load(spark, d, "supplier").select("s_suppkey", xs.alias("xs"), ys.alias("ys"))
    return q.select("s_suppkey", F.round(E.shoelace(F.col("xs"), F.col("ys")), 6).alias("area"), E.in_convex(F.col("xs"), F.col("ys"), (k % 30).cast("double"), (k % 50).cast("double")).alias("inside"))


def _utm_sql() -> str:
    series = E.krueger_series()
    radius, alpha, e = f"{series[0]:.17e}", [f"{a:.17e}" for a in series[1]], f"{series[2]:.17e}"
    x = " + ".join(["eta", *(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    y = " + ".join(["xi", *(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    return f"""WITH {STATIONS_SQL}, p AS (SELECT station_id, sin(radians(lat)) AS s, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS lam FROM stations),
t AS (SELECT *, sinh(atanh(s) - {e} * atanh({e} * s)) AS t FROM p), x AS (SELECT station_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT station_id, round(500000 + 9.996e-1 * {radius} * ({x}), 3) AS easting, round(9.996e-1 * {radius} * ({y}), 3) AS northing FROM x"""


@query(_utm_sql())
def sc_20_projection(spark: SparkSession, d: str) -> DataFrame:
    """Easting and northing; tested against published points."""
    zone = F.floor((F.col("lon") + 180) / 6) * 6 - 177
    x, y = E.utm(F.col("lat"), F.col("lon"), zone.cast("double"))
    return stations(spark, d).select("station_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


def _grid_sql() -> str:
    """The same projections in SQL: forward, then back from the coordinates that were found."""
    (radius, alpha, e), (beta, delta) = E.krueger_series(), grid_places.inverse_series()
    scaled, num = grid_places.UTM_SCALE * radius, lambda x: f"({x:.17e})"
    series = lambda names, c, f, g, a, b: " ".join(f"{names} {num(k)} * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, k in enumerate(c, 1))
    geographic = "chi " + " ".join(f"+ {num(d)} * sin({2 * j} * chi)" for j, d in enumerate(delta, 1))
    return f"""WITH p AS (SELECT s_suppkey AS place, s_suppkey * 7919 % 17999 / 100.0 - 89.99 AS lat, s_suppkey * 104729 % 36000 / 100.0 - 179.995 AS lon FROM supplier),
z AS (SELECT *, floor((lon + 180) / 6) AS k, CASE WHEN lat >= 84 THEN 'ups-n' WHEN lat < -80 THEN 'ups-s' ELSE 'utm-' || lpad(CAST(CAST(floor((lon + 180) / 6) + 1 AS INT) AS VARCHAR), 2, '0') || CASE WHEN lat >= 0 THEN 'n' ELSE 's' END END AS zone FROM p),
a AS (SELECT *, radians(lon - (k * 6 - 177)) AS lam, sin(radians(lat)) AS s, {num(grid_places.E)} * sin(radians(abs(lat))) AS es FROM z),
b AS (SELECT *, sinh(atanh(s) - {num(e)} * atanh({num(e)} * s)) AS t, {num(grid_places.UPS_RADIUS)} * tan(pi() / 4 - radians(abs(lat)) / 2) * pow((1 + es) / (1 - es), {num(grid_places.E / 2)}) AS rho FROM a),
c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, zone LIKE 'ups%' AS cap, CASE WHEN lat < 0 THEN 1e7 ELSE 0 END AS south FROM b),
f AS (SELECT *, CASE WHEN cap THEN 2e6 + rho * sin(radians(lon)) ELSE 500000 + {num(scaled)} * (eta {series("+", alpha, "cos", "sinh", "xi", "eta")}) END AS easting,
  CASE WHEN cap THEN 2e6 + CASE WHEN lat >= 0 THEN -rho ELSE rho END * cos(radians(lon)) ELSE south + {num(scaled)} * (xi {series("+", alpha, "sin", "cosh", "xi", "eta")}) END AS northing FROM c),
g AS (SELECT *, (northing - south) / {num(scaled)} AS y0, (easting - 500000) / {num(scaled)} AS x0, easting - 2e6 AS px, northing - 2e6 AS py FROM f),
h AS (SELECT *, y0 {series("-", beta, "sin", "cosh", "y0", "x0")} AS y, x0 {series("-", beta, "cos", "sinh", "y0", "x0")} AS x FROM g),
i AS (SELECT *, CASE WHEN cap THEN pi() / 2 - 2 * atan(sqrt(px * px + py * py) / {num(grid_places.UPS_RADIUS)}) ELSE asin(sin(y) / cosh(x)) END AS chi FROM h)
SELECT place, zone, round(easting, 3) AS easting, round(northing, 3) AS northing, round(degrees({geographic}) * CASE WHEN cap AND lat < 0 THEN -1 ELSE 1 END, 8) AS lat_back,
  round(CASE WHEN cap THEN degrees(atan2(px, CASE WHEN lat >= 0 THEN -py ELSE py END)) ELSE k * 6 - 177 + degrees(atan2(sinh(x), cos(y))) END, 8) AS lon_back FROM i"""


@query(_grid_sql())
def sc_20_grid_places(spark: SparkSession, d: str) -> DataFrame:
    """Places all over the earth to their zone, polar caps among them, and back again."""
    k = F.col("s_suppkey")
    places = load(spark, d, "supplier").select(k.alias("place"), (k * 7919 % 17999 / 100.0 - 89.99).alias("lat"), (k * 104729 % 36000 / 100.0 - 179.995).alias("lon"))
    back = grid_places.off_grid(grid_places.on_grid(places))
    return back.select("place", "zone", *(F.round(c, 3).alias(c) for c in ("easting", "northing")), *(F.round(c, 8).alias(c) for c in ("lat_back", "lon_back")))


@query("SELECT s_suppkey, 'g100-' || CAST(floor(s_suppkey * 7919 % 600000 / 51200.0) AS BIGINT) || '-' || CAST(floor(s_suppkey * 104729 % 900000 / 51200.0) AS BIGINT) AS tile, CAST(floor(s_suppkey * 7919 % 600000 / 100.0) % 512 AS INT) AS cell_col FROM supplier")
def sc_23_tiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = F.pmod(k * 7919, F.lit(600000)), F.pmod(k * 104729, F.lit(900000))
    return load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("g100-"), F.floor(x / 51200.0), F.lit("-"), F.floor(y / 51200.0)).alias("tile"), F.pmod(F.floor(x / 100.0), F.lit(512)).cast("int").alias("cell_col"))


@query("WITH b AS (SELECT s_suppkey, s_suppkey * 1301 % 3600 / 10.0 - 180 AS west, s_suppkey * 523 % 1100 / 10.0 - 55 AS south FROM supplier) SELECT s_suppkey, CAST(floor(south / 5) + r AS INT) AS row, CAST((floor((west + 180) / 5) + c) % 72 AS INT) AS col FROM b, (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 6)) AS c) WHERE (floor(south / 5) + r) * 5 < south + 12 AND (floor((west + 180) / 5) + c) * 5 < west + 180 + 23")
def sc_24_candidate_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 5 degrees that a box of 23 by 12 degrees touches; the antimeridian wraps."""
    k = F.col("s_suppkey")
    b = load(spark, d, "supplier").select("s_suppkey", (k * 1301 % 3600 / 10.0 - 180).alias("west"), (k * 523 % 1100 / 10.0 - 55).alias("south"))
    span = lambda a, size: F.sequence(F.floor(a / 5), (F.ceil((a + size) / 5) - 1))
    return b.withColumn("row", F.explode(span(F.col("south"), 12))).withColumn("c", F.explode(span(F.col("west") + 180, 23))).select("s_suppkey", F.col("row").cast("int").alias("row"), (F.col("c") % 72).cast("int").alias("col"))


@query(f"WITH {SAMPLES_SQL}, x AS (SELECT sample_id, month, row_number() OVER (PARTITION BY month, CAST(acquisition_id % 4 AS INT) ORDER BY sha256('9:' || sample_id), sample_id) AS k FROM samples) SELECT month, sample_id FROM x WHERE k <= 3")
def srt_04_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("bin", F.col("acquisition_id") % 4)
    return windows.hash_sample(s, ["month", "bin"], "sample_id", 9, 3).select("month", "sample_id")
