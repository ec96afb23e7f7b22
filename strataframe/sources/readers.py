"""Readers of observation files: each takes a DataFrame of raw text (or a path) and returns typed rows by expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError


def guarded_scan(spark: SparkSession, path: str, ts: str, start: str, stop: str) -> DataFrame:
    """Reads only the time column first and refuses the file if any row lies outside [start, stop); then reads the rest."""
    times = spark.read.parquet(path).select(F.col(ts).cast("timestamp").alias("t"))
    inside = (F.col("t") >= F.to_timestamp(F.lit(start))) & (F.col("t") < F.to_timestamp(F.lit(stop)))
    outside = times.agg(F.count_if(~F.coalesce(inside, F.lit(False)))).first()[0]
    if outside:
        raise ContractError(f"{outside} rows outside [{start}, {stop})")
    return spark.read.parquet(path)


def strings_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text; an empty field is an empty string, not null."""
    return spark.read.csv(path, header=True, sep=separator, inferSchema=False, nullValue="\u0000", emptyValue="").na.fill("")


#: Fixed: what the archive documents. Of these sources these codes pass, for the variables named or for all; no other code does.
PASSING_CODES = (
    (("313", "314", "315", "322", "335", "343", "344", "346"), None, ("0", "1", "4", "5", "9")),
    (("220", "221", "222", "223", "347", "348"), None, ("1",)),
    (("345",), ("relative_humidity", "wind_speed"), ("0",)),
)


def quality_usable(variable: Column, quality: Column, source: Column) -> Column:
    """Whether a reading counts: its code is blank or passes by ``PASSING_CODES``."""
    q, s = F.trim(quality), F.trim(source)
    passing = F.lit(False)
    for sources, variables, codes in PASSING_CODES:
        passing = passing | (s.isin(*sources) & q.isin(*codes) & (variable.isin(*variables) if variables else F.lit(True)))
    return (q == "") | passing


def station_long(wide: DataFrame, variables: Sequence[str], station: str = "STATION", date: str = "DATE", sentinels: Sequence[str] = ("9999", "99999", "999.9", "")) -> DataFrame:
    """station, timestamp_utc, variable, raw, value, quality, source, usable: a wide archive with <v>, <v>_Quality_Code and
    <v>_Source_Code columns in long form; sentinels are null, raw text is kept."""
    parts = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("raw"), F.coalesce(F.col(f"{v}_Quality_Code"), F.lit("")).alias("quality"), F.coalesce(F.col(f"{v}_Source_Code"), F.lit("")).alias("source")) for v in variables))
    long = wide.select(F.col(station).alias("station"), F.try_to_timestamp(F.col(date)).alias("timestamp_utc"), F.explode(parts).alias("p")).select("station", "timestamp_utc", "p.*")
    value = F.when(~F.trim("raw").isin(*sentinels), F.expr("try_cast(trim(raw) AS DOUBLE)"))
    return long.withColumn("value", value).withColumn("usable", F.col("value").isNotNull() & quality_usable(F.col("variable"), F.col("quality"), F.col("source")))


def station_wide(long: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row for each station and time, with the usable value of each variable."""
    return long.groupBy("station", "timestamp_utc").pivot("variable", list(variables)).agg(F.max(F.when(F.col("usable"), F.col("value"))))


def packed_temperature(packed: Column) -> Column:
    """'+0260,1' is 26.0: tenths of a degree with a code; only code 1 counts and 9999 is missing."""
    value, code = F.regexp_extract(packed, r"^([+-]\d{4}),(\d)$", 1), F.regexp_extract(packed, r"^([+-]\d{4}),(\d)$", 2)
    return F.when((code == "1") & ~value.isin("+9999", "-9999", ""), value.try_cast("double") / 10.0 + 0.0)


def inventory(rows: DataFrame, elevation_sentinels: Sequence[float] = (-999.9, -999.0, 9999.0)) -> DataFrame:
    """station_id, lat, lon, elevation from text columns; unusable numbers and sentinels are null."""
    number = lambda c: F.trim(c).try_cast("double")
    height = number("elevation")
    return rows.select("station_id", number("lat").alias("lat"), number("lon").alias("lon"), F.when(~height.isin(*elevation_sentinels), height).alias("elevation"))


def fixed_minutes(lines: DataFrame, text: str, names: Sequence[str], header_lines: int = 2, missing: float = -9999.9) -> DataFrame:
    """Whitespace text with a header and (value, code) pairs after year, day, month, day, hour, minute: one row a line with
    the interval's end; a value counts if its code is 0."""
    line = lines.select("*", F.posexplode(F.split(text, "\n")).alias("line_number", "line")).filter((F.col("line_number") >= header_lines) & (F.trim("line") != ""))
    parts = line.withColumn("p", F.split(F.trim("line"), r"\s+"))
    at = lambda i: F.get("p", F.lit(i)).try_cast("double")
    stamp = F.make_timestamp(at(0).cast("int"), at(2).cast("int"), at(3).cast("int"), at(4).cast("int"), at(5).cast("int"), F.lit(0)) + F.expr("INTERVAL 1 MINUTE")
    values = {name: F.when((at(7 + 2 * i) == 0) & (at(6 + 2 * i) != missing), at(6 + 2 * i)) for i, name in enumerate(names)}
    return parts.select(*(c for c in lines.columns if c != text), stamp.alias("minute_end_utc"), *(v.alias(k) for k, v in values.items()))


def hourly_response(raw: DataFrame, json: str, variables: Sequence[str], units: dict[str, str]) -> DataFrame:
    """A response with parallel hourly arrays and a unit map as one row an hour. ``problem`` names what is wrong with a
    response: a unit, a length, a repeated or missing hour."""
    schema = f"struct<hourly_units: map<string, string>, hourly: struct<time: array<string>, {', '.join(f'{v}: array<double>' for v in variables)}>>"
    parsed = raw.withColumn("__r", F.from_json(json, schema))
    times = F.col("__r.hourly.time")
    seconds = F.transform(times, lambda t: F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm"))))
    # the times are read once a response, not once an hour
    gaps = F.exists(F.array(seconds), lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) - F.get(s, i - 1) != 3600, F.lit(True))))
    problem = F.coalesce(
        F.when(times.isNull(), "unreadable"),
        *(F.when(~F.coalesce(F.col("__r.hourly_units")[v] == u, F.lit(False)), f"unit of {v}") for v, u in units.items()),
        *(F.when(F.coalesce(F.size(f"__r.hourly.{v}"), F.lit(-1)) != F.size(times), f"length of {v}") for v in variables),
        F.when((F.size(times) > 1) & gaps, "hours repeated, missing or out of order"),
    )
    checked = parsed.withColumn("problem", problem)
    rows = checked.withColumn("__h", F.explode_outer(F.when(F.col("problem").isNull(), F.arrays_zip("__r.hourly.time", *(f"__r.hourly.{v}" for v in variables)))))
    return rows.select(*(c for c in raw.columns if c != json), "problem", F.try_to_timestamp("__h.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("hour_utc"), *(F.col(f"__h.{v}").alias(v) for v in variables))


def granules(raw: DataFrame, json: str) -> DataFrame:
    """Catalogue entries as one row a granule: identity, start, day or night flag, first data link, ring; malformed ones
    have a reason."""
    schema = "struct<id: string, title: string, time_start: string, day_night_flag: string, polygons: array<array<string>>, links: array<struct<rel: string, href: string>>>"
    e = raw.withColumn("__e", F.from_json(json, schema))
    link = F.get(F.filter("__e.links", lambda x: x["rel"].endswith("/data#") & x["href"].startswith("https")), F.lit(0))["href"]
    start = F.try_to_timestamp("__e.time_start")
    reason = F.coalesce(F.when(F.col("__e.id").isNull(), "no_identity"), F.when(start.isNull(), "no_start"), F.when(link.isNull(), "no_data_link"), F.when(~F.coalesce(F.col("__e.day_night_flag").isin("DAY", "NIGHT", "BOTH"), F.lit(False)), "no_phase_flag"))
    return e.select("__e.id", "__e.title", start.alias("time_start"), "__e.day_night_flag", link.alias("link"), F.get(F.get(F.col("__e.polygons"), F.lit(0)), F.lit(0)).alias("ring"), reason.alias("rejected_for"))


def ring_points(ring: Column) -> Column:
    """'lat lon lat lon ...' as (x, y) vertices, the closing one left out."""
    numbers = F.transform(F.split(F.trim(ring), r"\s+"), lambda x: x.try_cast("double"))
    points = F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, 2 * i + 1).alias("x"), F.get(numbers, 2 * i).alias("y")))
    return F.when((F.size(points) > 1) & (F.get(points, F.lit(0)) == F.element_at(points, -1)), F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def obstruction_list(lines: DataFrame, text: str = "value") -> DataFrame:
    """orbit, scene, flagged, parsed: records of an index; lines that don't parse stay, marked; exact repeats collapse."""
    pattern = r"^\s*(\d{5})\s+(\d{3})\s+(\d{8}T\d{6})\s+(yes|no)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    ok = F.col(text).rlike(pattern)
    return lines.filter(F.trim(text) != "").select(F.when(ok, part(1)).alias("orbit"), F.when(ok, part(2)).alias("scene"), F.when(ok, F.try_to_timestamp(part(3), F.lit("yyyyMMdd'T'HHmmss"))).alias("start_utc"), F.when(ok, part(4) == "yes").alias("flagged"), ok.alias("parsed"), F.when(~ok, F.col(text)).alias("bad_line")).distinct()


def verified_report(raw: Column, station: Column, hhmm: Column, temperature: Column) -> Column:
    """Null if the raw report confirms station, time and temperature (the tenths group first, then the body), else why not."""
    tenths = F.regexp_extract(raw, r"\bT([01])(\d{3})[01]\d{3}\b", 2)
    sign = F.when(F.regexp_extract(raw, r"\bT([01])(\d{3})[01]\d{3}\b", 1) == "1", -1.0).otherwise(1.0)
    body = F.regexp_replace(F.regexp_extract(raw, r"\s(M?\d{2})/(?:M?\d{2})?(?:\s|$)", 1), "M", "-")
    exact, rough = sign * tenths.try_cast("double") / 10, body.try_cast("double")
    return F.coalesce(
        F.when(raw.isNull(), "no_raw_report"), F.when(~F.coalesce(F.regexp_extract(raw, r"^(?:METAR |SPECI )?([A-Z0-9]{4})\b", 1) == station, F.lit(False)), "station_differs"),
        F.when(~F.coalesce(F.regexp_extract(raw, r"\b\d{2}(\d{4})Z\b", 1) == hhmm, F.lit(False)), "time_differs"),
        F.when(exact.isNotNull(), F.when(F.abs(exact - temperature) > 0.051, "temperature_differs")).when(rough.isNotNull(), F.when(F.abs(rough - temperature) > 0.51, "temperature_differs")).otherwise("no_temperature"),
    )


def forecast_index(lines: DataFrame, text: str = "value") -> DataFrame:
    """record, offset, variable, level, window: lines of a forecast's index; ``copies`` other than 1 are the caller's error."""
    pattern = r"^(\d+):(\d+):d=\d+:([A-Z0-9]+):([^:]+):([^:]*):"
    part = lambda i: F.regexp_extract(text, pattern, i)
    rows = lines.filter(F.col(text).rlike(pattern)).select(part(1).cast("int").alias("record"), part(2).cast("long").alias("offset"), part(3).alias("variable"), part(4).alias("level"), part(5).alias("window"))
    return rows.groupBy("variable", "level", "window").agg(F.min("record").alias("record"), F.min("offset").alias("offset"), F.count(F.lit(1)).alias("copies"))


def associations(raw: DataFrame, json: str) -> DataFrame:
    """A selected plan's sources by groups: (region, date, phase, physical key, revision); revisions stay apart."""
    schema = "struct<sources: array<struct<key: string, start: string, end: string, revision: string, groups: array<struct<region: string, date: string, phase: string>>>>>"
    s = raw.select(F.explode(F.from_json(json, schema)["sources"]).alias("s"))
    return s.select("s.*", F.explode("s.groups").alias("g")).select("g.region", "g.date", "g.phase", F.col("key").alias("physical_key"), F.try_to_timestamp("start").alias("start_utc"), F.try_to_timestamp("end").alias("end_utc"), "revision").distinct()


def grid_pixels(grids: DataFrame, rows: str, columns: str, keys: Sequence[str]) -> DataFrame:
    """Pixel rows of grids given by their size, with ids from their place."""
    cells = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col(rows) - 1))).withColumn("column", F.explode(F.sequence(F.lit(0), F.col(columns) - 1)))
    return cells.withColumn("pixel_id", F.concat_ws(":", *keys, "row", "column"))


def merged_shards(spark: SparkSession, paths: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """All shards as one table with the file of each row, and the keys whose rows differ between files."""
    rows = spark.read.parquet(*paths)
    columns = rows.columns
    tagged = rows.withColumn("shard", F.input_file_name())
    return tagged, rows.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("versions")).filter("versions > 1")
