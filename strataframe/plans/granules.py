"""Footprints and names of granules against what their metadata say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footprints
from ..session import load
from .registry import query

#: Numbers of a granule, the same in both languages: its centre, half its size, its corners, its area's shift, its tile's zone.
_COLUMNS = {
    "lon": "k * 1301 % 3600 / 10.0 - 180",
    "lat": "k * 523 % 1400 / 10.0 - 70",
    "half": "CASE WHEN k % 19 = 6 THEN 9.0 ELSE 0.3 + k % 4 * 0.2 END",
    "x1": "(lon - half + 540) % 360 - 180",
    "x2": "(lon + half + 540) % 360 - 180",
    "up": "CASE WHEN k % 13 = 5 THEN 200.0 ELSE 0.0 END",
    "y1": "lat - half + up",
    "y2": "lat + half + up",
    "cx": "lon + (k % 5 - 2) * 0.57",
    "zone": "(CAST(floor((lon + 180) / 6) AS INT) + CASE WHEN k % 9 = 0 THEN 5 ELSE 0 END) % 60 + 1",
    "band": "CAST(floor((lat + 80) / 8) AS INT) + 1",
}


def _steps() -> str:
    """A common table for each column, so that later ones can use earlier ones."""
    parts, last = ["g0 AS (SELECT s_suppkey AS k FROM supplier)"], "g0"
    for i, (name, x) in enumerate(_COLUMNS.items(), 1):
        parts.append(f"g{i} AS (SELECT *, CAST({x} AS {'INT' if name in ('zone', 'band') else 'DOUBLE'}) AS {name} FROM {last})")
        last = f"g{i}"
    return ", ".join(parts) + f", g AS (SELECT * FROM {last})"


@query(f"""WITH {_steps()}, p AS (SELECT *, CASE WHEN k % 11 = 4 THEN 'malformed_ring' WHEN k % 13 = 5 THEN 'out_of_range' WHEN abs(x2 - x1) > 180 THEN 'antimeridian' WHEN k % 7 = 3 THEN 'invalid_topology' END AS problem FROM g),
i AS (SELECT k, coalesce(problem, concat_ws(';', CASE WHEN NOT (cx - 0.2 <= x2 AND cx + 0.2 >= x1) THEN 'no_intersection' END, CASE WHEN half = 9 THEN 'implausible_area' END, CASE WHEN k % 17 = 0 THEN 'invalid_tile' WHEN k % 9 = 0 THEN 'tile_inconsistent' END)) AS issues FROM p)
SELECT k AS granule, CASE WHEN issues = '' THEN 'metadata_consistent' ELSE 'review_required' END AS status, issues FROM i""")
def sc_26_footprint_issues(spark: SparkSession, d: str) -> DataFrame:
    """Rings, some of them cut short, crossed, off the earth or over the antimeridian, against a triangle that each should meet."""
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    for name, x in _COLUMNS.items():
        rows = rows.withColumn(name, F.expr(x).cast("int" if name in ("zone", "band") else "double"))
    place = lambda y, x: F.concat(F.col(y).cast("string"), F.lit(" "), F.col(x).cast("string"))
    corners = [place("y1", "x1"), place("y1", "x2"), place("y2", "x2"), place("y2", "x1")]
    order = F.when(F.col("k") % 11 == 4, F.array(*corners[:3])).when(F.col("k") % 7 == 3, F.array(corners[0], corners[2], corners[1], corners[3])).otherwise(F.array(*corners))
    triangle = F.concat_ws(" ", *(c.cast("string") for dx, dy in ((-0.2, -0.2), (0.2, -0.2), (0.0, 0.2), (-0.2, -0.2)) for c in (F.col("lat") + dy, F.col("cx") + dx)))
    tile = F.when(F.col("k") % 17 == 0, "ZZ").otherwise(F.concat(F.lpad(F.col("zone").cast("string"), 2, "0"), F.substring(F.lit(footprints.BANDS), F.col("band"), F.lit(1)), F.lit("PA")))
    granules = rows.select(F.col("k").alias("granule"), F.array(F.array_join(order, " ")).alias("rings"), triangle.alias("area"), tile.alias("tile"))
    return footprints.footprint_issues(granules, ["granule"], "rings", "area", tile="tile")


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderdate + to_seconds(o_orderkey % 86400) AS start FROM orders)
SELECT k, CASE WHEN k % 29 = 0 THEN 'unrecognised_name' WHEN k % 23 = 0 THEN 'version_differs' WHEN k % 5 >= 2 THEN 'time_differs' ELSE 'consistent' END AS name_status,
  CASE WHEN k % 29 <> 0 THEN strftime(start + to_seconds(k % 5), '%Y-%m-%d %H:%M:%S') END AS named_time FROM n""")
def sc_12_names_and_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Times in names, up to four seconds from the start that the metadata has; two seconds are too many."""
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(k.alias("k"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))).alias("start"))
    said = F.date_format(F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("k") % 5).cast("decimal(18,6)")), "yyyyMMdd'T'HHmmss")
    version = F.when(F.col("k") % 23 == 0, "v003").otherwise("v002")
    named = rows.withColumn("name", F.when(F.col("k") % 29 == 0, "browse").otherwise(F.concat(F.lit("ECO"), version, F.lit("_L2T_LSTE_1_2_32UPA_"), said, F.lit("_0600_01"))))
    out = footprints.name_identity(named, "name", "start", r"^ECOv(\d{3})_L2T_LSTE_\d+_\d+_\d{2}[C-X][A-Z]{2}_(\d{8}T\d{6})_", "002")
    return out.select("k", "name_status", F.date_format("named_time", "yyyy-MM-dd HH:mm:ss").alias("named_time"))
