"""Event rows read as observations: deterministic positions from ids and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OBSERVER, Observer
from ..functions.geo import observer_frame


def observations(events: DataFrame, observer: Observer = OBSERVER) -> DataFrame:
    """(obs_id, entity_id, ts, callsign, lat, lon, alt_m, speed_mps, ...) with the frame's columns."""
    k, i = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    base = events.select(
        i.alias("obs_id"), F.concat(F.lit("u"), F.col("user_id")).alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("callsign"),
        (observer.lat + (k - 50) * F.lit(0.005) + (i % 7) * F.lit(0.0003)).alias("lat"), (observer.lon + ((i * 37) % 100 - F.lit(49.5)) * F.lit(0.006)).alias("lon"),
        (300 + F.col("value") * 20).alias("alt_m"), (F.lit(40.0) + (i * 13) % 200).alias("speed_mps"), (((k * 36 + (i % 11) * 10) % 3600) / F.lit(10.0)).alias("track_deg"),
        (((i * 7) % 41 - 20) / F.lit(2.0)).alias("vertical_rate_mps"), (F.lit(-30.0) + (i * 3) % 28).alias("signal_dbfs"),
    )
    return base.withColumn("f", observer_frame("lat", "lon", "alt_m", observer)).select("*", "f.*").drop("f")
