"""One query per sky operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import astro, geo, labels
from .operators import anomaly, behavior, brief, conflict, embedding, graph, passes, similarity, tracks, weather
from .oracles import ORACLES
from .plans import day
from .shelf import Shelf
from .sources import events as adapter
from .sources import scenario, sinks
from .streaming import live

#: Session gap of the queries over events, whose rows lie hours apart.
GAP = 86_400
#: The element set of the pass query (object 694) and its start.
TLE = ("OBJECT 694", "1 00694U 63047A   26161.07228530  .00001358  00000+0  15205-3 0  9994", "2 00694  30.3551  39.1817 0545986 174.7629 185.8982 14.12503204144697")
START = 1_781_110_800.0


def obs(spark: SparkSession, d: str) -> DataFrame:
    return adapter.observations(spark.read.parquet(f"{d}/events.parquet"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return tracks.stitch(obs(spark, d), GAP)


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return tracks.roll_up(points(spark, d))


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def r(c: Column | str, n: int = 4, name: str | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return (F.round(x, n) + 0.0).alias(name or c)


def wrap(c: Column | str, n: int, name: str | None = None) -> Column:
    """A rounded angle, with 360 as 0."""
    x = F.col(c) if isinstance(c, str) else c
    return F.pmod(F.round(x, n), F.lit(360.0)).alias(name or c)


def project_frames(spark, d):
    return obs(spark, d).select("obs_id", r("range_m"), wrap("azimuth_deg", 6), r("elevation_deg", 6), wrap("bearing_deg", 6))


def ecef_enu(spark, d):
    e = obs(spark, d).withColumn("e", geo.enu(geo.ecef(F.col("lat"), F.col("lon"), F.col("alt_m"))))
    return e.select("obs_id", r("e.east", 3, "east"), r("e.north", 3, "north"), r("e.up", 3, "up"))


def screen_xy(spark, d):
    s = obs(spark, d).withColumn("s", geo.screen_xy(F.col("azimuth_deg"), F.col("elevation_deg"), 800, 600))
    return s.select("obs_id", r("s.x", 3, "x"), r("s.y", 3, "y"), F.col("s.visible").alias("visible"))


def compass_counts(spark, d):
    return obs(spark, d).groupBy(geo.compass(F.col("track_deg")).alias("sector")).agg(F.count("*").alias("n"))


def band_counts(spark, d):
    s = spark.read.parquet(f"{d}/events.parquet").select((F.pmod(F.col("event_id") * 7, F.lit(101)) / 100.0).alias("s"))
    return s.groupBy(labels.band(F.col("s")).alias("band"), labels.band_rank(F.col("s")).alias("rank"), labels.band_action(F.col("s")).alias("action")).agg(F.count("*").alias("n"))


def dead_reckoning(spark, d):
    c = F.col
    p = obs(spark, d).withColumn("p", geo.dead_reckon(c("lat"), c("lon"), c("alt_m"), c("speed_mps"), c("track_deg"), c("vertical_rate_mps"), (c("obs_id") % 25).cast("double")))
    return p.select("obs_id", r("p.lat", 8, "lat"), r("p.lon", 8, "lon"), r("p.alt_m", 4, "alt_m"))


def kp_levels(spark, d):
    k = F.pmod(F.col("event_id"), F.lit(91)) / 10.0
    return spark.read.parquet(f"{d}/events.parquet").groupBy(labels.kp_level(k).alias("level"), labels.aurora_hint(k).alias("aurora")).agg(F.count("*").alias("n"))


def stitch_tracks(spark, d):
    return points(spark, d).groupBy("track_id").agg(F.count("*").alias("n_points"), F.min("ts").alias("started"), F.max("ts").alias("ended")).select("track_id", "n_points", ntz("started"), ntz("ended"))


def callsign_fill(spark, d):
    return points(spark, d).select("obs_id", "track_id", "callsign")


def track_rollup(spark, d):
    return rolled(spark, d).select("track_id", "n_points", r("min_range_m"), "closest_obs", "first_obs", "last_obs", r("max_elevation_deg", 6), ntz("closest_approach"), "overhead", "start_hour")


def track_stats(spark, d):
    return rolled(spark, d).select("track_id", r("mean_alt_m"), r("std_alt_m", 3), r("mean_speed_mps"), r("mean_signal_dbfs"), r("mean_elevation_deg", 6), r("mean_abs_vrate_mps"), r("climb_ratio", 6), r("descent_ratio", 6))


def circular_heading(spark, d):
    return rolled(spark, d).select("track_id", wrap("heading_deg", 4))


def heading_histogram(spark, d):
    return tracks.heading_histogram(points(spark, d))


def azimuth_histogram(spark, d):
    return rolled(spark, d).select("track_id", *[r(f"az_{b}", 6) for b in range(8)])


def path_straightness(spark, d):
    return rolled(spark, d).select("track_id", r("path_m", 2), r("straightness", 6))


def track_embedding(spark, d):
    return embedding.track_vectors(rolled(spark, d)).select("track_id", F.posexplode("embedding").alias("dim", "v")).select("track_id", "dim", r(F.col("v").cast("double"), 4, "value"))


def weather_embedding(spark, d):
    w = embedding.weather_vectors(weather.from_observations(obs(spark, d)))
    return w.select("window_id", F.posexplode("embedding").alias("dim", "v")).select("window_id", "dim", r(F.col("v").cast("double"), 4, "value"))


def derived_motion(spark, d):
    return tracks.derived_motion(points(spark, d)).select("obs_id", r("derived_speed_mps", 4), wrap("derived_track_deg", 4), r("derived_vrate_mps", 6))


def overhead_candidates(spark, d):
    return tracks.overhead(rolled(spark, d)).select("track_id", "entity_id", r("min_range_m"), r("max_elevation_deg", 6))


def window_activity(spark, d):
    t = rolled(spark, d)
    span = t.agg(F.min("started").alias("lo"))
    start = F.col("lo") + F.expr("interval 10 days")
    return tracks.active_in(t.crossJoin(F.broadcast(span)), start, start + F.expr("interval 6 hours"))  # one row


def hour_windows(spark, d):
    hours = F.explode(weather.hours_covering(F.col("started"), F.col("ended"))).alias("h")
    return rolled(spark, d).select("track_id", hours).select("track_id", graph.window_id(F.col("h")).alias("window_id"))


def weather_overlap(spark, d):
    return weather.overlapping(rolled(spark, d), weather.from_observations(obs(spark, d)))


def weather_islands(spark, d):
    return weather.runs(weather.from_observations(obs(spark, d))).select("condition", ntz("start"), ntz("end"), "n_windows")


def hourly_counts(spark, d):
    w = obs(spark, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "entities")


def session_windows(spark, d):
    s = obs(spark, d).groupBy("entity_id", F.session_window("ts", f"{GAP}.999999 seconds")).agg(F.min("ts").alias("started"), F.count("*").alias("n_points"))
    return s.select("entity_id", ntz("started"), "n_points")


def summaries(spark, d):
    return anomaly.sequenced(embedding.track_vectors(rolled(spark, d)))


def prior_baseline(spark, d):
    b = anomaly.prior_baseline(summaries(spark, d))
    return b.select("track_id", "n_prior", r("alt_mean", 3), r("alt_std", 3), r("sig_mean", 4), r("sig_std", 4), "hours_near", r("nearest_corridor", 4))


def leave_one_out_baseline(spark, d):
    b = anomaly.leave_one_out(rolled(spark, d))
    return b.select("track_id", "n_prior", r("alt_mean", 3), r("alt_std", 2), r("sig_mean", 4), r("sig_std", 3), "hours_near", r("nearest_corridor", 4))


def shelved(shelf: Shelf, d: str) -> DataFrame:
    """The summaries, written: what reads them many times plans no more than a scan."""
    t = shelf.put(embedding.track_vectors(rolled(shelf.spark, d)))
    out = shelf.put(anomaly.sequenced(t))
    shelf.drop(t)
    return out


def scores(shelf: Shelf, t: DataFrame) -> DataFrame:
    """Scores of written summaries, their parts written one after the other, so that the driver
    never holds one plan of all of them."""
    return shelf.put(anomaly.score(t, shelf.put(anomaly.prior_baseline(t)), shelf.put(similarity.novelty(t))))


def scored(spark, d):
    shelf = Shelf(spark, "scored")
    return scores(shelf, shelved(shelf, d))


def anomaly_scores(spark, d):
    return scored(spark, d).select("track_id", r("route_deviation", 3), r("altitude_deviation", 3), r("time_of_day_rarity", 4), r("signal_unusualness", 3), r("novelty_score", 3), r("score", 3))


def unusual_top1(spark, d):
    return brief.most_unusual(scored(spark, d)).select("track_id", r("score", 3))


def track_novelty(spark, d):
    return similarity.novelty(shelved(Shelf(spark, "novelty"), d)).select("track_id", r("novelty", 3))


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def knn_top3(spark, d):
    v = vectors(spark, d)
    return similarity.nearest(v, v, 3).select("vec_id", "neighbour", "rank", r("distance", 5))


def novelty_vectors(spark, d):
    v = vectors(spark, d)
    return similarity.nearest(v, v, 3).groupBy("vec_id").agg(r(F.least(F.avg("distance") / similarity.NOVELTY_SCALE, F.lit(1.0)), 5, "novelty"))


def similar_pairs(spark, d):
    v = vectors(spark, d)
    return similarity.similar_pairs(similarity.nearest(v, v, 1), "vec_id", "neighbour").select("a", "b", r("distance", 5))


def now(o: DataFrame) -> Column:
    """The snapshot moment of the live queries: 20 days into the events."""
    return F.lit("2024-01-21 00:00:00").cast("timestamp")


def snapshot(spark, d, speed: int) -> DataFrame:
    """Events as one live picture: their times shrunk by ``speed`` towards the snapshot."""
    o, at = obs(spark, d), F.unix_micros(now(None))
    t = at - F.pmod(F.col("obs_id") * 7919, F.lit(1_200 // speed)) * 1_000_000
    return o.withColumn("ts", F.timestamp_micros(t))


def holding(spark, d):
    return behavior.holding(snapshot(spark, d, 1), now(None))


def go_around(spark, d):
    return behavior.go_around(snapshot(spark, d, 1), now(None))


def planted(spark, d) -> DataFrame:
    """The snapshot with company: a wingman beside every entity, and for every entity a survey
    flight of five legs or, of every third entity, a straight line."""
    p = snapshot(spark, d, 1)
    wing = p.withColumns({"entity_id": F.concat("entity_id", F.lit("w")), "obs_id": F.col("obs_id") + 1_000_000_000, "lat": F.col("lat") + 0.002})
    user = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("i"))
    k, leg, step = F.col("k"), F.floor(F.col("k") / 10), F.col("k") % 10
    straight = F.col("user_id") % 3 == 0
    flown = user.crossJoin(spark.range(50).select(F.col("id").cast("int").alias("k"))).select(  # fifty rows
        (2_000_000_000 + F.col("i") * 50 + k).alias("obs_id"), F.concat(F.lit("g"), "user_id").alias("entity_id"), (now(None) - F.make_dt_interval(secs=(49 - k) * 10)).alias("ts"),
        (F.col("user_id") % 1600 * F.lit(0.05) - 40 + F.lit(0.004) * F.when(straight, k).otherwise(leg)).alias("lat"), F.when(straight, F.lit(-79.0)).otherwise(-79 + 0.003 * F.when(leg % 2 == 0, step).otherwise(9 - step)).alias("lon"),
        F.lit(1000.0).alias("alt_m"), F.lit(60.0).alias("speed_mps"), F.lit(0.0).alias("track_deg"),
    )
    cols = ["obs_id", "entity_id", "ts", "lat", "lon", "alt_m", "speed_mps", "track_deg"]
    return p.select(cols).unionByName(wing.select(cols)).unionByName(flown)


def survey_grid(spark, d):
    return behavior.survey_grid(planted(spark, d), now(None))


def formation_pairs(spark, d):
    return behavior.formation_pairs(planted(spark, d).where("entity_id like 'u%'"), now(None))


def behavior_badges(spark, d):
    return behavior.behaviors(planted(spark, d), now(None)).select("entity_id", F.array_join("behaviors", ",").alias("behaviors"), "badges")


def heading_rate(spark, d):
    return conflict.heading_rate(snapshot(spark, d, 1), now(None)).select("entity_id", r("rate_deg_s", 4))


def conflict_pairs(spark, d):
    return conflict.conflicts(conflict.latest_states(snapshot(spark, d, 1), now(None))).select("a", "b", r("t", 4), r("dh", 2), r("dv", 2))


def predicted_paths(spark, d):
    c = F.col
    p = conflict.predicted_path(c("lat"), c("lon"), c("alt_m"), c("speed_mps"), c("track_deg"), c("vertical_rate_mps"), F.lit(0.5))
    return obs(spark, d).select("obs_id", F.posexplode(p).alias("k", "p")).select("obs_id", "k", r("p.lat", 7, "lat"), r("p.lon", 7, "lon"), r("p.alt_m", 3, "alt_m"))


def greedy_keep(spark, d):
    return live.rolling_batch(obs(spark, d).withColumn("t", F.unix_micros("ts") / 1e6 / 86_400.0)).groupBy("entity_id").agg(F.count("*").alias("n_kept"), F.max("obs_id").alias("last_id"))


def asof_lookup(spark, d):
    o = obs(spark, d)
    left = o.where("callsign = ''").select("obs_id", "entity_id", "ts")
    right = o.where("callsign <> ''").select("entity_id", "ts", F.col("obs_id").alias("seen"))
    return tracks.as_of(left, right, ["entity_id"], "ts", ["seen"]).select("obs_id", "asof_seen")


def recent_window(spark, d):
    return tracks.recent(obs(spark, d), now(None), 86_400).groupBy("entity_id").agg(F.count("*").alias("n"))


def trail_slice(spark, d):
    return tracks.trail(obs(spark, d), now(None), 5).select("entity_id", "obs_id")


def novelty_cap(spark, d):
    return sinks.newest(obs(spark, d), "ts", 500, "obs_id").select("obs_id", "entity_id")


def _graph(spark, d):
    """Tracks, windows and scores are written, as node and edge kinds read them many times."""
    shelf = Shelf(spark, "graph")
    t, w = shelved(shelf, d), shelf.put(weather.from_observations(obs(spark, d)))
    return shelf, t, w, scores(shelf, t).where("band_rank >= 1")


def _pairs(shelf: Shelf, t: DataFrame) -> DataFrame:
    return shelf.put(similarity.similar_pairs(similarity.nearest(t, t, 1, key="track_id"), "track_id", "neighbour"))


def graph_nodes(spark, d):
    _, t, w, s = _graph(spark, d)
    return graph.nodes(t, w, s).select("id", "label")


def graph_edges(spark, d):
    shelf, t, w, s = _graph(spark, d)
    return graph.edges(t, w, _pairs(shelf, t), s).groupBy("type", F.split("dst", "[:-]")[0].alias("to")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


def explain(spark, d):
    shelf, t, w, s = _graph(spark, d)
    return graph.explain(graph.nodes(t, w, s), graph.edges(t, w, _pairs(shelf, t), s), s.select("track_id")).select("track_id", "aircraft_id", "callsign", F.array_join("evidence", "\n").alias("evidence"))


def daily_brief(spark, d):
    shelf = Shelf(spark, "brief")
    t, w = shelved(shelf, d), shelf.put(weather.from_observations(obs(spark, d)))
    b = brief.daily_brief(t, scores(shelf, t), w)
    return b.select("observer", "date", "aircraft_observed", "overhead_candidates", "unusual_tracks", F.array_join("weather_events", "; ").alias("weather"), r("most_unusual.confidence", 3, "confidence"))


def scenario_brief(spark, d):
    return brief.brief_text(day.synthetic_day(spark).brief)


def scenario_graph(spark, d):
    found = day.synthetic_day(spark)
    return found.nodes.select(F.lit("node").alias("what"), F.col("label").alias("kind")).union(found.edges.select(F.lit("edge"), "type")).groupBy("what", "kind").agg(F.count("*").alias("n"))


def scenario_export(spark, d):
    found = day.synthetic_day(spark)
    return sinks.export_rows(found.points, found.tracks, found.scored).select("icao24", "callsign", "overhead", F.size("points").alias("n_points"), F.col("anomaly.score").alias("score"), F.col("anomaly.band").alias("band"))


def _moments(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def sun_position(spark, d):
    return _moments(spark, d).withColumn("s", astro.sun_position(F.col("t"), 43.4675, -79.6877)).select("event_id", wrap("s.az", 4, "az"), r("s.el", 4, "el"))


def moon_position(spark, d):
    return _moments(spark, d).withColumn("s", astro.moon_position(F.col("t"), 43.4675, -79.6877)).select("event_id", wrap("s.az", 4, "az"), r("s.el", 4, "el"))


def sat_sunlit(spark, d):
    i = F.col("event_id")
    sun = _moments(spark, d).withColumn("sun", astro.sun_direction(F.col("t")))
    lit = astro.sunlit((i % 160 - 80).cast("double"), (i * 7 % 360 - 180).cast("double"), F.lit(550_000.0), F.col("sun"))
    return sun.select("event_id", lit.alias("sunlit"))


def satellite_passes(spark, d):
    return passes.predict_passes(spark.createDataFrame([TLE], "name string, l1 string, l2 string"), START)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        project_frames, ecef_enu, screen_xy, compass_counts, band_counts, dead_reckoning, kp_levels, stitch_tracks, callsign_fill, track_rollup, track_stats, circular_heading, heading_histogram,
        azimuth_histogram, path_straightness, track_embedding, weather_embedding, derived_motion, overhead_candidates, window_activity, hour_windows, weather_overlap, weather_islands, hourly_counts,
        session_windows, prior_baseline, leave_one_out_baseline, anomaly_scores, unusual_top1, track_novelty, knn_top3, novelty_vectors, similar_pairs, holding, go_around, survey_grid, formation_pairs,
        behavior_badges, heading_rate, conflict_pairs, predicted_paths, greedy_keep, asof_lookup, recent_window, trail_slice, novelty_cap, graph_nodes, graph_edges, explain, daily_brief,
        scenario_brief, scenario_graph, scenario_export, sun_position, moon_position, sat_sunlit, satellite_passes,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
