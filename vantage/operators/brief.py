"""The daily summary: one row from tracks, scores and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OBSERVER, Observer
from .weather import runs

UNUSUAL_RANK, MENTION_SCORE, LOW_ALT_M = 2, 0.30, 1_500


def most_unusual(scored: DataFrame) -> DataFrame:
    """The highest score, the later track on ties; no row unless it is worth a mention."""
    top = scored.agg(F.max(F.struct("score", "seq", *[c for c in scored.columns if c not in ("score", "seq")])).alias("m")).select("m.*")
    return top.where(F.col("score") > MENTION_SCORE)


def daily_brief(tracks: DataFrame, scored: DataFrame, windows: DataFrame, observer: Observer = OBSERVER) -> DataFrame:
    """observer, date, counts, weather_events and the most unusual track (null if none)."""
    c = F.col
    base = tracks.agg(
        F.coalesce(F.to_date(F.min("started")), F.lit("1970-01-01").cast("date")).alias("date"), F.countDistinct("entity_id").alias("aircraft_observed"), F.count_if("overhead").alias("overhead_candidates"),
    )
    odd = scored.agg(F.count_if(c("band_rank") >= UNUSUAL_RANK).alias("unusual_tracks"))
    line = F.concat(c("condition"), F.lit(" "), F.date_format("start", "HH:mm"), F.lit("–"), F.date_format("end", "HH:mm"), F.lit(" UTC"))
    events = runs(windows).agg(F.transform(F.sort_array(F.collect_list(F.struct("start", line.alias("x")))), lambda s: s["x"]).alias("weather_events"))
    who = F.coalesce(F.nullif("callsign", F.lit("")), F.concat(F.lit("icao24 "), "entity_id"))
    text = F.format_string("%s-altitude pass by %s heading %.0f° at %s UTC (%.0f m): %s", F.when(c("mean_alt_m") < LOW_ALT_M, "low").otherwise("high"), who, c("heading_deg"), F.date_format("closest_approach", "HH:mm"), c("mean_alt_m"), c("reasons")[0])
    top = most_unusual(scored).agg(F.first(F.struct(text.alias("description"), c("score").alias("confidence"))).alias("most_unusual"))
    row = base.crossJoin(odd).crossJoin(events).crossJoin(top)  # one row each
    return row.select(F.lit(observer.name).alias("observer"), "*")


def brief_text(brief: DataFrame) -> DataFrame:
    c = F.col
    weather = F.when(F.size("weather_events") == 0, "clear throughout").otherwise(F.array_join("weather_events", "; "))
    odd = F.when(c("unusual_tracks") == 1, "").otherwise("s")
    head = F.format_string("Sky brief — %s, %s. %d aircraft observed; %d overhead candidates; %d unusual track%s. Weather: %s.", "observer", c("date").cast("string"), "aircraft_observed", "overhead_candidates", "unusual_tracks", odd, weather)
    tail = F.coalesce(F.format_string(" Most unusual event: %s (confidence %.2f).", c("most_unusual.description"), c("most_unusual.confidence")), F.lit(""))
    return brief.select(F.concat(head, F.when(c("most_unusual").isNull(), "").otherwise(tail)).alias("text"))
