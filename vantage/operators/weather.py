"""Weather windows: overlaps, hours, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours_covering(start: Column, end: Column) -> Column:
    """Hour starts from the one that holds ``start`` to ``end``, inclusive."""
    return F.sequence(F.date_trunc("hour", start), end, F.expr("interval 1 hour"))


def overlapping(tracks: DataFrame, windows: DataFrame) -> DataFrame:
    """(track_id, window_id) of windows that overlap a track, strictly on both sides.

    Both sides are cut into hours, so the overlap is an equi-join; each pair comes once, from the
    first hour that they share.
    """
    t = tracks.select("track_id", "started", "ended", F.explode(hours_covering(F.col("started"), F.col("ended"))).alias("hour"))
    w = windows.select("window_id", "start", "end", F.explode(hours_covering(F.col("start"), F.col("end"))).alias("hour"))
    first = F.col("hour") == F.greatest(F.date_trunc("hour", "started"), F.date_trunc("hour", "start"))
    return t.join(w, "hour").where(first & (F.col("start") < F.col("ended")) & (F.col("end") > F.col("started"))).select("track_id", "window_id")


def runs(windows: DataFrame) -> DataFrame:
    """Maximal runs of consecutive windows that are neither clear nor cloudy, in order.

    One row per window enters; the order is global, as windows are hours.
    """
    w = Window.orderBy("start", "window_id")
    calm = F.col("condition").isin("clear", "cloudy")
    cut = windows.withColumn("run", F.sum(calm.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~calm)
    first = F.min(F.struct("start", "window_id", "condition")).alias("a")
    return cut.groupBy("run").agg(first, F.max(F.struct("start", "window_id", "end")).alias("z"), F.count("*").alias("n_windows")).select(F.col("a.condition").alias("condition"), F.col("a.start").alias("start"), F.col("z.end").alias("end"), "n_windows")


def from_observations(obs: DataFrame) -> DataFrame:
    """Hourly windows made of an observation table, for data without weather."""
    names = F.array(*[F.lit(x) for x in ("clear", "cloudy", "fog", "rain", "snow", "thunderstorm")])
    by = obs.groupBy(F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"), F.avg("speed_mps").alias("v"), F.max("alt_m").alias("z"))
    return by.select(
        F.concat(F.lit("weather:"), F.date_format("start", "yyyy-MM-dd'T'HH")).alias("window_id"), "start", (F.col("start") + F.expr("interval 1 hour")).alias("end"), F.element_at(names, (F.col("n") % 6 + 1).cast("int")).alias("condition"),
        (F.col("v") / 20).alias("wind_mps"), (F.col("z") / 1000).alias("precip_mm_hr"), F.when(F.col("n") % 6 >= 3, "advisory").alias("alert"),
    )
