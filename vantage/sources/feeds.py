"""Readers of receiver JSON, live polls, element sets, routes, weather and space weather."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FT, KT = 0.3048, 0.514444
RECEIVER = "now double, aircraft array<struct<hex:string,flight:string,lat:double,lon:double,alt_baro:double,gs:double,track:double,baro_rate:double,rssi:double,squawk:string>>"
POLL = "now double, ac array<struct<hex:string,flight:string,lat:double,lon:double,alt_geom:double,alt_baro:string,gs:double,track:double,geom_rate:double,baro_rate:double,rssi:double,squawk:string,category:string,emergency:string,t:string,r:string,seen:double,seen_pos:double>>"


def _moment(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def receiver_states(documents: DataFrame, column: str = "value") -> DataFrame:
    """Aircraft with a position from whole receiver documents; a malformed one is an error."""
    fine = F.when(F.try_parse_json(column).isNull(), F.raise_error(F.lit("malformed receiver document"))).otherwise(F.col(column))
    d = documents.select(F.from_json(fine, RECEIVER).alias("d"))  # a field of another type, like "ground", is null
    a = d.select(F.coalesce("d.now", F.lit(0.0)).alias("now"), F.explode("d.aircraft").alias("a")).where("a.lat is not null and a.lon is not null")
    zero = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0.0))
    return a.select(
        F.lower(F.coalesce("a.hex", F.lit(""))).alias("entity_id"), F.trim(F.coalesce("a.flight", F.lit(""))).alias("callsign"), _moment(F.col("now")).alias("ts"), F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"),
        (zero("alt_baro") * FT).alias("alt_m"), (zero("gs") * KT).alias("speed_mps"), zero("track").alias("track_deg"), (zero("baro_rate") * FT / 60).alias("vertical_rate_mps"), F.coalesce("a.rssi", F.lit(-30.0)).alias("signal_dbfs"),
    )


def poll_states(documents: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a live poll: geometric altitude first, "ground" as 0, rows without altitude, id or
    position dropped, time reduced by the age of the position, vertical rate null if not told."""
    d = documents.select(F.from_json(column, POLL, {"mode": "PERMISSIVE"}).alias("d")).where("d.ac is not null")
    a = d.select(F.col("d.now").alias("now"), F.explode("d.ac").alias("a")).select("now", "a.*")
    feet = F.coalesce("alt_geom", F.when(F.col("alt_baro") == "ground", 0.0).otherwise(F.col("alt_baro").try_cast("double")))
    rate = F.coalesce("geom_rate", "baro_rate", F.lit(0.0)) * FT / 60
    moving = F.col("gs").isNotNull() & F.col("track").isNotNull()
    out = a.select(
        F.lower(F.replace(F.coalesce("hex", F.lit("")), F.lit("~"), F.lit(""))).alias("entity_id"), (F.col("now") - F.coalesce("seen_pos", "seen", F.lit(0.0))).alias("t"), "now",
        F.trim(F.coalesce("flight", F.lit(""))).alias("callsign"), "lat", "lon", (feet * FT).alias("alt_m"), F.when(moving, F.col("gs") * KT).alias("gs_ms"), F.when(moving, F.col("track")).alias("track_deg"), F.when(moving, rate).alias("vrate_ms"),
        "rssi", "squawk", "category", "emergency", F.col("t").alias("type"), F.col("r").alias("reg"),
    )
    return out.where("entity_id <> '' and lat is not null and lon is not null and alt_m is not null")


class Failover:
    """Polls the first of several named sources that answers with a list of aircraft, starting
    with the one that did so last. Sources are functions that return a document's text."""

    def __init__(self, sources: list[tuple[str, Callable[[], str]]]):
        self.sources, self.at, self.failures = sources, 0, 0

    def poll(self) -> tuple[str, str] | None:
        """(name, text), or None if all sources fail; ``failures`` counts such polls in a row."""
        for k in range(len(self.sources)):
            i = (self.at + k) % len(self.sources)
            name, fetch = self.sources[i]
            try:
                text = fetch()
                if not isinstance(json.loads(text).get("ac"), list):
                    raise ValueError("no list of aircraft")
            except Exception:  # noqa: BLE001, S112 - whatever a source does wrong, the next one is asked
                continue
            self.at, self.failures = i, 0
            return name, text
        self.failures += 1
        return None


WEATHER = "temperature_2m double, relative_humidity_2m double, surface_pressure double, wind_speed_10m double, wind_direction_10m double, wind_gusts_10m double, cloud_cover double, precipitation double, weather_code int"


def weather_now(documents: DataFrame, column: str = "value", time: str | None = None) -> DataFrame:
    """The current weather of each document that has it; with ``time`` only of the latest such
    one, so that a failed poll leaves the last reading in place."""
    d = documents.select(*([time] if time else []), F.from_json(column, f"current struct<{WEATHER}>")["current"].alias("c")).where("c is not null")
    return d.agg(F.max_by("c", time).alias("c")).where("c is not null").select("c.*") if time else d.select("c.*")


def latest_kp(documents: DataFrame, column: str = "value") -> DataFrame:
    """The last finite estimated K index of each document."""
    rows = F.from_json(column, "array<struct<time_tag:string,estimated_kp:double>>")
    good = F.filter(rows, lambda x: x["estimated_kp"].isNotNull() & ~F.isnan(x["estimated_kp"]))
    return documents.select(F.try_element_at(good, F.lit(-1)).alias("k")).where("k is not null").select("k.*")


def element_sets(spark: SparkSession, text: DataFrame, column: str = "value") -> DataFrame:
    """(name, l1, l2) of each name line followed by lines that start with "1 " and "2 "."""
    lines = text.select(F.filter(F.transform(F.split(column, "\n"), lambda x: F.rtrim(x)), lambda x: x != "").alias("l"))
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 3), lambda i: F.get("l", i + 1).startswith("1 ") & F.get("l", i + 2).startswith("2 "))
    at = lines.where(F.size("l") >= 3).select("l", F.explode(starts).alias("i"))
    return at.select(F.trim(F.get("l", "i")).alias("name"), F.get("l", F.col("i") + 1).alias("l1"), F.get("l", F.col("i") + 2).alias("l2"))


def freshest(table: DataFrame, key: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The newest row per key of a cache, with whether it is still fresh."""
    newest = table.groupBy(key).agg(F.max_by(F.struct(*table.columns), "fetched_at").alias("r")).select("r.*")
    return newest.withColumn("fresh", F.unix_seconds(now) - F.unix_seconds("fetched_at") <= ttl_seconds)


def cached_elements(cache: DataFrame, group: str, now: float, fetch: Callable[[], str], ttl_seconds: int) -> tuple[DataFrame, str] | None:
    """Element sets of a group and where they come from: a fresh cache, else the network, else a
    stale cache; None without any. ``cache`` has (group, fetched_at seconds, text)."""
    spark = cache.sparkSession
    held = cache.where((F.col("group") == group)).agg(F.max(F.struct("fetched_at", "text")).alias("r")).first().r
    read = lambda text: element_sets(spark, spark.createDataFrame([(text,)], "value string"))
    old = read(held.text) if held is not None else None
    usable = old is not None and not old.isEmpty()
    if usable and now - held.fetched_at < ttl_seconds:
        return old, f"cache ({group})"
    try:
        new = read(fetch())
        if new.isEmpty():
            raise ValueError("no element sets")
        return new, f"network ({group})"
    except Exception:  # noqa: BLE001 - any failure falls back to what was cached
        return (old, f"stale cache ({group})") if usable else None


def with_routes(tracks: DataFrame, routes: DataFrame, now: Column, ttl_seconds: int = 86_400, cap: int = 300) -> DataFrame:
    """Left join to the newest ``cap`` cached routes by callsign, and ``route``: known, none (the
    cache has it that there is no route: a row without an airline and places), ask (not cached,
    or longer than its time to live), or null without a callsign."""
    newest = routes.groupBy(F.upper(F.trim("callsign")).alias("_route")).agg(F.max_by(F.struct("airline", "origin", "destination"), "fetched_at").alias("_r"), F.max("fetched_at").alias("_at"))
    live = newest.orderBy(F.desc("_at"), "_route").limit(cap).where(F.unix_seconds(now) - F.unix_seconds("_at") < ttl_seconds)
    out = tracks.join(F.broadcast(live), F.upper(F.trim("callsign")) == F.col("_route"), "left")  # at most cap rows
    none = F.col("_r.airline").isNull() & F.col("_r.origin").isNull() & F.col("_r.destination").isNull()
    state = F.when(F.trim("callsign") == "", None).when(F.col("_route").isNull(), "ask").when(none, "none").otherwise("known")
    return out.select(*tracks.columns, "_r.airline", "_r.origin", "_r.destination", F.when(F.col("callsign").isNotNull(), state).alias("route"))
