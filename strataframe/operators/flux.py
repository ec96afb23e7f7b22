"""Proxies of the surface's energy fluxes, each only where its inputs are valid, causal and of the right hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import STEFAN_BOLTZMANN, all_reasons, finite, floor_hour
from .windows import full_window

HOURS = 6
PROXIES = ("absorbed_shortwave", "net_longwave", "recent_absorbed_shortwave")


def six_hour_means(hourly: DataFrame, key: str, hour: str, shortwave: str) -> DataFrame:
    """key, hour, current, mean6: of hours whose last six are all there and not negative."""
    valid = hourly.withColumn("__sw", F.when(F.col(shortwave) >= 0, F.col(shortwave)))
    return valid.withColumn("mean6", full_window(valid, [key], hour, "__sw", HOURS, F.avg)).filter(F.col("mean6").isNotNull()).select(F.col(key).alias("__key"), F.col(hour).alias("__hour"), F.col(shortwave).alias("__current"), "mean6")


def flux_proxies(df: DataFrame, hourly: DataFrame, key: str, *, hourly_key: str = "key", hourly_hour: str = "hour", hourly_value: str = "value") -> DataFrame:
    """Adds the three proxies, what each input check says, how the six-hour mean was had and its age, and the reasons against.

    ``df`` has ts, weather_ts, radiation_ts, optical_ts, older_optical_ts, albedo, shortwave, longwave, air_c, energy_6h_j_m2,
    history_end_ts, history_status, history_hours, history_coverage and ``key``; ``hourly`` the shortwave of whole hours, a row
    a key and hour. Both radiation inputs belong to the hour of ts. The six-hour mean comes from the row's own energy where that
    ends at the hour and is complete, else from the hourly table where its six hours are there and it agrees with the row on
    the current one; it is never interpolated. The latest of the optical times has to be at or before ts. Values are not
    clipped. A row that lacks an input keeps its other proxies; ``complete`` needs all three. Rows are neither dropped nor
    repeated (more than one row for a key and hour in ``hourly`` is the caller's error).
    """
    c = F.col
    cutoff = floor_hour(c("ts"))
    joined = df.withColumn("__cutoff", cutoff).join(six_hour_means(hourly, hourly_key, hourly_hour, hourly_value), (c(key) == c("__key")) & (c("__cutoff") == c("__hour")), "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    optical = F.greatest("optical_ts", "older_optical_ts")
    checks: dict[str, Column] = {
        "target_time": c("ts").isNotNull(),
        "optical_causal": yes(optical <= c("ts")),
        "albedo_valid": yes(finite(c("albedo")) & c("albedo").between(0, 1)),
        "shortwave_valid": yes(finite(c("shortwave")) & (c("shortwave") >= 0)),
        "longwave_valid": yes(finite(c("longwave")) & (c("longwave") > 0)),
        "air_valid": yes(finite(c("air_c")) & (c("air_c") + 273.15 > 0)),
        "shortwave_time_valid": yes(c("weather_ts") == c("__cutoff")),
        "longwave_time_valid": yes(c("radiation_ts") == c("__cutoff")),
    }
    own = yes(finite(c("energy_6h_j_m2")) & (c("energy_6h_j_m2") >= 0) & (c("history_end_ts") == c("__cutoff")) & (c("history_status") == "complete") & (c("history_hours") == HOURS) & (c("history_coverage") == 1.0))
    rebuilt = checks["shortwave_time_valid"] & yes(finite(c("shortwave"))) & yes(F.abs(c("shortwave") - c("__current")) <= 1e-8)
    mean = F.when(own, c("energy_6h_j_m2") / (HOURS * 3600)).when(rebuilt, c("mean6"))
    source = F.when(own, "existing_six_hour_energy").when(rebuilt & c("mean6").isNotNull(), "hourly_table").otherwise("unavailable")
    out = joined.withColumns(checks).withColumns({"history_mean_w_m2": mean, "history_source": source, "history_age_minutes": F.when(mean.isNotNull(), (c("ts").cast("double") - c("__cutoff").cast("double")) / 60)})
    history = c("history_mean_w_m2").isNotNull()
    kelvin = c("air_c") + 273.15
    proxies = {
        PROXIES[0]: F.when(c("albedo_valid") & c("optical_causal") & c("shortwave_valid") & c("shortwave_time_valid"), (1 - c("albedo")) * c("shortwave")),
        PROXIES[1]: F.when(c("longwave_valid") & c("air_valid") & c("longwave_time_valid"), c("longwave") - STEFAN_BOLTZMANN * F.pow(kelvin, 4.0)),
        PROXIES[2]: F.when(c("albedo_valid") & c("optical_causal") & history, (1 - c("albedo")) * c("history_mean_w_m2")),
    }
    out = out.withColumns({k: F.when(finite(v), v) for k, v in proxies.items()})
    labels = [  # fixed: the reasons and their order
        ("target_time", "missing_target_time"),
        ("optical_causal", "missing_or_future_optical_source"),
        ("albedo_valid", "invalid_albedo"),
        ("shortwave_valid", "invalid_shortwave"),
        ("longwave_valid", "invalid_longwave"),
        ("air_valid", "invalid_air_temperature"),
        ("shortwave_time_valid", "shortwave_hour_mismatch"),
        ("longwave_time_valid", "longwave_hour_mismatch"),
    ]
    complete = F.lit(True)
    for name in PROXIES:
        complete = complete & c(name).isNotNull()
    reasons = all_reasons([*((~c(k), label) for k, label in labels), (~history, "incomplete_six_hour_history")])
    out = out.withColumns({**{f"{name}_available": c(name).isNotNull() for name in PROXIES}, "complete": complete, "unavailable_reason": reasons})
    out = out.withColumn("unavailable_reason", F.when(~c("complete") & (c("unavailable_reason") == ""), "nonfinite_derived_proxy").otherwise(c("unavailable_reason")))
    return out.drop("__cutoff", "__key", "__hour", "__current", "mean6")
