"""The sky as nodes and edges: one select per kind, joined up by union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OBSERVER, OVERHEAD_RANGE_M, Observer
from .weather import hours_covering, overlapping

#: Order of evidence lines by edge kind.
KINDS = ["part_of_track", "observed_by", "near", "during", "correlated_with", "similar_to"]


def _props(**values: Column) -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()]))


def _node(df: DataFrame, node: Column, label: str, **values: Column) -> DataFrame:
    return df.select(node.alias("id"), F.lit(label).alias("label"), _props(**values).alias("props"))


def _edge(df: DataFrame, src: Column, dst: Column, type_: str, **values: Column) -> DataFrame:
    props = _props(**values) if values else F.create_map().cast("map<string,string>")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), props.alias("props"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def window_id(ts: Column) -> Column:
    return F.concat(F.lit("window:"), F.date_format(ts, "yyyy-MM-dd'T'HH"))


def nodes(tracks: DataFrame, windows: DataFrame, anomalies: DataFrame, observer: Observer = OBSERVER) -> DataFrame:
    """(id, label, props) of all kinds; an aircraft has its first track's callsign."""
    c, s = F.col, F.unix_seconds
    one = tracks.sparkSession.range(1)
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), c(x).alias("o")) for r, x in (("first", "first_obs"), ("closest_approach", "closest_obs"), ("last", "last_obs"))])).alias("r")
    hours = tracks.select(F.explode(hours_covering(c("started"), c("ended"))).alias("h")).union(windows.select(F.explode(hours_covering(c("start"), c("end") - F.expr("interval 1 second"))))).distinct()
    first = tracks.groupBy("entity_id").agg(F.min(F.struct("started", "segment", "callsign")).alias("f"))
    return _union([
        _node(one, F.lit(f"observer:{observer.name}"), "Observer", name=F.lit(observer.name), lat=F.lit(observer.lat), lon=F.lit(observer.lon), alt_m=F.lit(observer.alt_m)),
        _node(hours, window_id(c("h")), "TimeWindow", start_epoch=s("h"), end_epoch=s("h") + 3600),
        _node(windows, c("window_id"), "WeatherCell", condition=c("condition"), wind_mps=c("wind_mps"), precip_mm_hr=c("precip_mm_hr"), alert=F.coalesce("alert", F.lit("")), start_epoch=s("start"), end_epoch=s("end")),
        _node(first, F.concat(F.lit("aircraft:"), "entity_id"), "Aircraft", icao24=c("entity_id"), callsign=c("f.callsign")),
        _node(tracks, c("track_id"), "Track", icao24=c("entity_id"), callsign=c("callsign"), started_epoch=s("started"), ended_epoch=s("ended"), min_range_m=c("min_range_m"), max_elevation_deg=c("max_elevation_deg"), closest_azimuth_deg=c("closest_azimuth_deg"), dominant_heading_deg=c("heading_deg"), mean_altitude_m=c("mean_alt_m"), overhead=c("overhead"), n_points=c("n_points"), first_observation_id=c("first_obs"), closest_observation_id=c("closest_obs"), last_observation_id=c("last_obs")),
        _node(tracks.select("track_id", roles), F.concat_ws(":", F.lit("obs"), "track_id", "r.role"), "Observation", observation_id=c("r.o"), role=c("r.role")),
        _node(anomalies, F.concat(F.lit("anomaly:"), "track_id"), "Anomaly", track_id=c("track_id"), score=c("score"), band=c("band"), reasons=F.array_join("reasons", "; ")),
    ])


def edges(tracks: DataFrame, windows: DataFrame, similar: DataFrame, anomalies: DataFrame, observer: Observer = OBSERVER, top_similar: int = 5) -> DataFrame:
    """(src, dst, type, props). ``anomalies`` needs baseline_id; an edge to a baseline that is no
    track is left out by a semi join."""
    c, home = F.col, F.lit(f"observer:{observer.name}")
    roles = F.explode(F.array(*[F.lit(r) for r in ("first", "closest_approach", "last")])).alias("role")
    odd = F.concat(F.lit("anomaly:"), "track_id")
    based = anomalies.join(tracks.select(c("track_id").alias("baseline_id")), "baseline_id", "left_semi")
    return _union([
        _edge(windows.select("window_id", F.explode(hours_covering(c("start"), c("end") - F.expr("interval 1 second"))).alias("h")), c("window_id"), window_id(c("h")), "during"),
        _edge(tracks.select("track_id", roles), F.concat_ws(":", F.lit("obs"), "track_id", "role"), c("track_id"), "part_of_track", role=c("role")),
        _edge(tracks, c("track_id"), F.concat(F.lit("aircraft:"), "entity_id"), "part_of_track"),
        _edge(tracks, c("track_id"), home, "observed_by", min_range_m=c("min_range_m")),
        _edge(tracks.where(c("min_range_m") < OVERHEAD_RANGE_M), c("track_id"), home, "near", range_m=c("min_range_m"), at=c("closest_approach")),
        _edge(tracks.select("track_id", F.explode(hours_covering(c("started"), c("ended"))).alias("h")), c("track_id"), window_id(c("h")), "during"),
        _edge(overlapping(tracks, windows), c("track_id"), c("window_id"), "correlated_with", kind=F.lit("weather_context")),
        _edge(similar.orderBy("distance", "a", "b").limit(top_similar), c("a"), c("b"), "similar_to", distance=c("distance")),
        _edge(anomalies, c("track_id"), odd, "correlated_with", kind=F.lit("anomaly_score")),
        _edge(based, odd, c("baseline_id"), "anomalous_relative_to"),
    ])


def explain(node: DataFrame, edge: DataFrame, track_ids: DataFrame) -> DataFrame:
    """(track_id, aircraft_id, callsign, evidence): two lines on the track, then one per outgoing
    edge in the order of KINDS, with the second hop behind an anomaly. Unknown ids give no row."""
    say, num = F.format_string, lambda k: F.col("props")[k].cast("double")
    own = node.where("label = 'Track'").join(track_ids.select(F.col("track_id").alias("id")), "id", "left_semi")
    p = F.col("props")
    head = own.select(
        F.col("id").alias("track_id"), p["icao24"].alias("aircraft_id"), p["callsign"].alias("callsign"),
        F.array(
            say("track %s stitched from %s observations; evidence: first %s, closest approach %s, last %s", "id", p["n_points"], p["first_observation_id"], p["closest_observation_id"], p["last_observation_id"]),
            say("closest approach %.0f m at azimuth %.0f°, max elevation %.1f°, heading %.0f°, mean altitude %.0f m", num("min_range_m"), num("closest_azimuth_deg"), num("max_elevation_deg"), num("dominant_heading_deg"), num("mean_altitude_m")),
        ).alias("lines"),
    )
    out = edge.join(own.select(F.col("id").alias("src")), "src", "left_semi")
    hop = out.join(node.select(F.col("id").alias("dst"), F.col("label"), F.col("props").alias("q")), "dst", "left")
    back = edge.where("type = 'anomalous_relative_to'").select(F.col("src").alias("dst"), F.col("dst").alias("base"))
    hop = hop.join(back, "dst", "left")
    q, kind = F.col("q"), F.col("type")
    text = (
        F.when(kind == "part_of_track", F.concat(F.lit("flight of "), "dst"))
        .when(kind == "near", F.concat(F.lit("near "), F.col("dst"), F.lit(" (closest approach inside 10 km)")))
        .when(F.col("label") == "WeatherCell", say("correlated_with %s (%s, wind %.1f m/s)", "dst", q["condition"], q["wind_mps"].cast("double")))
        .when(F.col("label") == "Anomaly", F.concat(say("anomaly score %.2f (%s): %s", q["score"].cast("double"), q["band"], q["reasons"]), F.coalesce(F.concat(F.lit("; relative to "), "base"), F.lit(""))))
        .otherwise(F.concat_ws(" ", kind, "dst"))
    )
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    told = hop.groupBy(F.col("src").alias("track_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("k"), "dst", text.alias("x")))), lambda s: s["x"]).alias("more"))
    return head.join(told, "track_id", "left").select("track_id", "aircraft_id", "callsign", F.concat("lines", F.coalesce("more", F.array().cast("array<string>"))).alias("evidence"))
