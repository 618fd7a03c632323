"""Fixed-width feature vectors of tracks and weather windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp01

TRACK_DIM, WEATHER_DIM = 32, 8
#: Severity of each weather condition.
SEVERITY = {"clear": 0.0, "cloudy": 0.25, "fog": 0.5, "rain": 0.6, "snow": 0.7, "thunderstorm": 1.0}


def _clock(fraction: Column) -> tuple[Column, Column]:
    a = fraction * 2 * math.pi
    return 0.5 + 0.25 * F.sin(a), 0.5 + 0.25 * F.cos(a)


def track_vectors(tracks: DataFrame) -> DataFrame:
    """Adds ``embedding`` (32 floats) to rolled-up tracks; no further pass over their points."""
    c, h = F.col, F.radians("heading_deg")
    part = lambda name, scale: clamp01(c(name) / scale)
    lasted = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    dims = [
        part("mean_alt_m", 12_000), part("min_alt_m", 12_000), part("max_alt_m", 12_000), part("mean_speed_mps", 300), (F.sin(h) + 1) / 2, (F.cos(h) + 1) / 2,
        *_clock((F.hour("started") + F.minute("started") / 60) / 24), part("min_range_m", 50_000), part("max_elevation_deg", 90), part("mean_elevation_deg", 90), clamp01(lasted / 1800),
        c("climb_ratio"), c("descent_ratio"), clamp01(c("straightness")), part("mean_abs_vrate_mps", 15), *[c(f"az_{b}") for b in range(8)], clamp01((c("mean_signal_dbfs") + 40) / 40),
        part("std_speed_mps", 50), part("std_alt_m", 3_000), part("start_range_m", 50_000), part("end_range_m", 50_000), part("n_points", 600), c("overhead").cast("double"), F.lit(0.0),
    ]
    return tracks.withColumn("embedding", F.array(*[d.cast("float") for d in dims]))


def weather_vectors(windows: DataFrame) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("condition")]
    dims = [severity, clamp01(F.col("precip_mm_hr") / 5), clamp01(F.col("wind_mps") / 20), F.col("alert").isNotNull().cast("double"), *_clock(F.hour("start") / 24), F.lit(0.0), F.lit(0.0)]
    return windows.withColumn("embedding", F.array(*[d.cast("float") for d in dims]))
