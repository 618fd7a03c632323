"""Sky operators: geometry, the seeded day, folds, feeds, passes, streaming, stores."""

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vantage import queries
from vantage.config import OBSERVER
from vantage.functions import astro, geo, labels
from vantage.functions.sgp4 import Elements
from vantage.operators import behavior, conflict, passes, similarity, tracks, weather
from vantage.operators.brief import brief_text
from vantage.operators.graph import explain
from vantage.plans.day import synthetic_day
from vantage.queries import START, TLE
from vantage.sources import feeds, sinks
from vantage.streaming import live

POINT = "entity_id string, obs_id long, ts timestamp, lat double, lon double, alt_m double, speed_mps double, track_deg double, vertical_rate_mps double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(spark, lat, lon, alt):
    return one(spark, geo.observer_frame(F.lit(lat), F.lit(lon), F.lit(alt)))


def test_frame(spark):
    north = frame(spark, OBSERVER.lat + 0.45, OBSERVER.lon, 10_000.0)
    assert min(north.azimuth_deg, 360 - north.azimuth_deg) < 0.5 and 49_000 < north.range_m < 52_500 and 8 < north.elevation_deg < 13
    above = frame(spark, OBSERVER.lat, OBSERVER.lon, OBSERVER.alt_m + 5_000)
    assert above.elevation_deg > 89.9 and abs(above.range_m - 5_000) < 1
    east = frame(spark, OBSERVER.lat, OBSERVER.lon + 0.25, 1_000.0)
    assert abs(east.azimuth_deg - 90) < 0.5 and abs(east.bearing_deg - 90) < 0.5


def test_angles_and_labels(spark):
    assert one(spark, geo.circular_diff_deg(F.lit(350.0), F.lit(10.0))) == 20
    assert [one(spark, geo.compass(F.lit(x))) for x in (0.0, 22.5, 337.4, 337.5)] == ["N", "NE", "NW", "N"]
    assert [one(spark, labels.band(F.lit(x))) for x in (0.3, 0.31, 0.75, 0.9, 0.91, float("nan"))] == ["normal", "mildly unusual", "interesting", "strong anomaly", "rare", "rare"]
    assert one(spark, labels.wmo_text(F.lit(4))) == "wmo 4" and one(spark, labels.wmo_text(F.lit(45))) == "fog"
    assert one(spark, labels.emergency(F.lit("none"), F.lit("7700"))) == "squawk 7700"
    s = one(spark, geo.screen_xy(F.lit(90.0), F.lit(0.0), 800, 600))
    assert (round(s.x), round(s.y), s.visible) == (700, 300, True)


def test_sines_have_the_last_bits_of_the_c_library(spark):
    d = F.col("id") / F.lit(10.0)
    for r in spark.range(3600).select("id", geo.sin_deg(d).alias("s"), geo.cos_deg(d).alias("c")).collect():
        assert (r.s, r.c) == (math.sin(math.radians(r.id / 10)), math.cos(math.radians(r.id / 10)))
    assert one(spark, geo.sin_deg(F.lit(None).cast("double"))) is None and one(spark, geo.sin_deg(F.lit(12.34))) == pytest.approx(math.sin(math.radians(12.34)), rel=1e-15)


def test_opposite_headings_give_the_headings_of_the_sql(spark, tmp_path):
    """Tracks of two points whose headings cancel, of every pair that events can have."""
    at = {(k * 36 + j * 10) % 3600: (k, j) for k in range(100) for j in range(11)}
    pairs = [m for m in range(1800) if m in at and m + 1800 in at]
    rows = [((n * 2 + q) * 11 + at[m + q * 1800][1], n, q, at[m + q * 1800][0]) for n, m in enumerate(pairs) for q in (0, 1)]
    duck = duckdb.connect()
    duck.sql("create table r (i bigint, u bigint, q int, k int)")
    duck.executemany("insert into r values (?, ?, ?, ?)", rows)
    duck.sql("create table events as select i as event_id, timestamp '2024-01-01' + to_hours(q) as ts, u as user_id, 'view' as event_type, 1e0 as value, '{\"k\": ' || k || '}' as props from r")
    duck.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = duck.sql(queries.oracle_sql()["circular_heading"]).fetchall()
    assert len(want) == len(pairs) > 400
    assert sorted(tuple(r) for r in queries.circular_heading(spark, str(tmp_path)).collect()) == sorted(want)


def test_sun(spark):
    at = lambda t: one(spark, astro.sun_position(F.lit(float(t)), OBSERVER.lat, OBSERVER.lon)).el
    assert 60 < at(1_781_110_800) < 80 and at(1_781_067_600) < -10
    assert one(spark, astro.gmst_deg(F.lit(946_728_000.0))) == pytest.approx(280.4606, abs=1e-3)


@pytest.fixture(scope="module")
def day(spark):
    return synthetic_day(spark)


def test_seeded_day(spark, day):
    t = {r.entity_id: r for r in day.tracks.collect()}
    assert day.points.count() == 2820 and len(t) == 10
    assert {k for k, r in t.items() if r.overhead} == {"c07e07", "c08f08", "c0a9a9", "deadbf"}
    s = {r.entity_id: r for r in day.scored.collect()}
    assert len(s) == 5 and {k: round(s[k].score, 3) for k in ("c04d04", "c0a9a9", "deadbf")} == {"c04d04": 0.165, "c0a9a9": 0.570, "deadbf": 0.860}
    pairs = [(r.a, r.b, round(r.distance, 3)) for r in day.similar.take(2)]
    assert pairs == [("track-a03c03-0", "track-c01a01-0", 0.378), ("track-c01a01-0", "track-c04d04-0", 0.448)]
    assert (day.nodes.count(), day.edges.count()) == (109, 111)
    text = brief_text(day.brief).first().text
    assert "rain 14:00–16:00 UTC" in text and "2 unusual tracks" in text and "10 aircraft" in text


def test_explain_and_export(spark, day, tmp_path):
    ids = spark.createDataFrame([("track-deadbf-0",), ("nobody",)], "track_id string")
    found = explain(day.nodes, day.edges, ids).collect()
    assert len(found) == 1 and any(x.startswith("anomaly score 0.86") for x in found[0].evidence)
    text = sinks.export_text(day.points, day.tracks, day.scored, "2026-06-08")
    assert len(json.loads(text)["tracks"]) == 10 and json.loads(text)["tracks"][0]["anomaly"] is None
    sinks.write_export(str(tmp_path / "x.js"), text)
    assert (tmp_path / "x.js").read_text().startswith("const SKY_DATA = {")


def test_window_activity(day):
    at = lambda h: F.lit(f"2026-06-{8 + h // 24:02d} {h % 24:02d}:00:00").cast("timestamp")
    assert [r.entity_id for r in tracks.active_in(day.tracks, at(11), at(12)).collect()] == ["c01a01"]
    assert [r.entity_id for r in tracks.active_in(day.tracks, at(27), at(28)).collect()] == ["deadbf"]


def path(spark, places, entity="x", step=10):
    now = 1_000_000
    n = len(places)
    rows = [(entity, i, now - (n - 1 - i) * step, *p, 100.0, 0.0, 0.0) for i, p in enumerate(places)]
    return spark.createDataFrame(rows, POINT.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")), F.timestamp_seconds(F.lit(now))


def test_behaviors(spark):
    ring = [(43 + 0.012 * math.sin(i / 3), -79 + 0.016 * math.cos(i / 3), 3000.0) for i in range(36)]
    line = [(43 + 0.01 * i, -79.0, 3000.0) for i in range(36)]
    assert behavior.holding(*path(spark, ring)).count() == 1 and behavior.holding(*path(spark, line)).count() == 0
    grid, lat = [], 43.0
    for leg in range(5):
        for k in range(10):
            grid.append((lat, -79 + 0.003 * (k if leg % 2 == 0 else 9 - k), 1000.0))
        lat += 0.004
    assert behavior.survey_grid(*path(spark, grid)).count() == 1 and behavior.survey_grid(*path(spark, line)).count() == 0
    dip = [(43.0, -79 + 0.01 * i, 900.0 - 40 * min(i, 15) + 40 * max(0, i - 15)) for i in range(30)]
    assert behavior.go_around(*path(spark, dip)).count() == 1 and behavior.go_around(*path(spark, line)).count() == 0
    a, now = path(spark, [(43 + 0.001 * i, -79.0, 1000.0) for i in range(6)], "a")
    b, _ = path(spark, [(43 + 0.001 * i, -79.004, 1000.0) for i in range(6)], "b")
    c, _ = path(spark, [(43 + 0.001 * i, -79.05, 1000.0) for i in range(6)], "c")
    both = a.union(b).union(c)
    assert [tuple(r) for r in behavior.formation_pairs(both, now).collect()] == [("a", "b")]
    assert {r.entity_id: r.badges for r in behavior.behaviors(both, now).collect()} == {"a": "FORM", "b": "FORM", "c": ""}


def test_cpa_and_turns(spark):
    v = lambda e, n, u: F.struct(F.lit(float(e)).alias("e"), F.lit(float(n)).alias("n"), F.lit(float(u)).alias("u"))
    head_on = one(spark, conflict.cpa(v(0, 0, 0), v(100, 0, 0), v(10_000, 0, 0), v(-100, 0, 0)))
    assert (head_on.t, head_on.dh) == (50.0, 0.0)
    apart = one(spark, conflict.cpa(v(0, 0, 0), v(-100, 0, 0), v(10_000, 0, 0), v(100, 0, 0)))
    assert (apart.t, apart.dh) == (0.0, 10_000.0)
    turn = [(43.0, -79.0, 1000.0)]
    for i in range(12):
        h = math.radians(3 * 5 * i)
        la = turn[-1][0] + 500 * math.cos(h) / 111_132
        turn.append((la, turn[-1][1] + 500 * math.sin(h) / (111_320 * math.cos(math.radians(la))), 1000.0))
    assert conflict.heading_rate(*path(spark, turn, step=5)).first().rate_deg_s == pytest.approx(3, abs=0.3)
    straight = one(spark, conflict.predicted_path(F.lit(43.0), F.lit(-79.0), F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert len(straight) == 18 and straight[-1].lat == pytest.approx(43 + 9000 / 111_132) and straight[-1].alt_m == 90


def test_receiver_and_poll(spark):
    doc = json.dumps({"now": 1000.5, "aircraft": [{"hex": "ABC", "flight": " X1 ", "lat": 1, "lon": 2, "alt_baro": "ground", "gs": 10}, {"hex": "no"}, {"lat": 1.0, "lon": 1.0, "alt_baro": 1000}]})
    got = feeds.receiver_states(spark.createDataFrame([(doc,)], "value string")).collect()
    assert [(r.entity_id, r.callsign, round(r.alt_m, 1), r.signal_dbfs) for r in got] == [("abc", "X1", 0.0, -30.0), ("", "", 304.8, -30.0)]
    with pytest.raises(Exception, match="malformed"):
        feeds.receiver_states(spark.createDataFrame([("{",)], "value string")).collect()
    poll = json.dumps({"now": 100, "ac": [{"hex": "~A1", "lat": 1, "lon": 2, "alt_baro": "ground", "seen_pos": 4, "gs": 10, "track": 5}, {"hex": "b", "lat": 1, "lon": 2, "alt_baro": "?"}, {"hex": "c", "lat": 1, "lon": 2, "alt_geom": 100, "alt_baro": 9}]})
    got = feeds.poll_states(spark.createDataFrame([(poll,)], "value string")).collect()
    assert [(r.entity_id, r.t, round(r.alt_m, 2), r.track_deg) for r in got] == [("a1", 96.0, 0.0, 5.0), ("c", 100.0, 30.48, None)]


def test_elements_and_passes(spark):
    text = "\n".join(["junk", TLE[0], TLE[1], TLE[2], "BAD", "1 x", "2 y", ""])
    sets = feeds.element_sets(spark, spark.createDataFrame([(text,)], "value string"))
    assert [r.name for r in sets.orderBy("name").collect()] == ["BAD", TLE[0]]
    found = passes.predict_passes(sets, START).collect()
    assert found and all(r.rise <= r.culminate <= r.set and r.set - r.rise < 3600 and 0 < r.max_el <= 90 for r in found)
    at = passes.positions(sets, passes.time_grid(sets, START, 2, 60)).collect()
    assert all(400e3 < r.alt_m < 1_350e3 and abs(r.lat) < 31 for r in at)
    with pytest.raises(ValueError):
        Elements("1 x", "2 y")


def test_nearest_blocks(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(map(tuple, similarity.nearest(v, v, 3).select("vec_id", "rank", "neighbour").collect()))
    monkeypatch.setattr(similarity, "BLOCK", 64)
    assert sorted(map(tuple, similarity.nearest(v, v, 3).select("vec_id", "rank", "neighbour").collect())) == want


def test_rolling_batch_is_greedy(spark):
    t = [0.0, 0.4, 0.6, 1.0, 1.2, 5.0]
    df = spark.createDataFrame([("a", x, i) for i, x in enumerate(t)], "entity_id string, t double, obs_id long")
    assert sorted(r.t for r in live.rolling_batch(df).collect()) == [x for x, k in zip(t, live.greedy_keep(t), strict=True) if k] == [0.0, 0.6, 1.2, 5.0]


def test_rolling_stream(spark, tmp_path):
    rows = [("a", 1000.0 + x, 43.0, -79.0, 100.0, c, None) for x, c in ((0.0, "X"), (0.2, ""), (1.0, ""), (2.0, "Y"))]
    schema = "entity_id string, t double, lat double, lon double, alt_m double, callsign string, emergency string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
    q = live.rolling_tracks(stream).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        got = spark.sql("select * from rolled order by t").collect()
    finally:
        q.stop()
    assert [(r.t - 1000, r.callsign, r.n_points) for r in got] == [(0.0, "X", 1), (1.0, "X", 2), (2.0, "Y", 3)]


def test_stores(spark, tmp_path):
    step = live.append_to(str(tmp_path / "s"))
    seen = []
    run = live.poll_cycle(lambda b, e: seen.append(b.count()), step)
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "entity_id string, t double")
    run(df, 0)
    run(df, 0)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and seen == [2, 2]
    snaps = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 25.0)], "entity_id string, at double")
    assert sinks.cadence(snaps).count() == 2


def test_weather_runs_merge_kinds(spark):
    rows = [(i, c) for i, c in enumerate(["clear", "rain", "fog", "cloudy", "snow"])]
    w = spark.createDataFrame(rows, "h int, condition string").select(F.concat(F.lit("w"), "h").alias("window_id"), F.timestamp_seconds(F.col("h") * 3600).alias("start"), F.timestamp_seconds(F.col("h") * 3600 + 3600).alias("end"), "condition")
    assert [(r.condition, r.n_windows) for r in weather.runs(w).orderBy("start").collect()] == [("rain", 2), ("snow", 1)]


def test_predicted_paths_of_every_observation(spark, sf):
    from vantage import queries
    from vantage.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON

    got = {(r.obs_id, r.k): (r.lat, r.lon, r.alt_m) for r in queries.predicted_paths(spark, sf).collect()}
    seen = queries.obs(spark, sf).select("obs_id", "lat", "lon", "alt_m", "speed_mps", "track_deg", "vertical_rate_mps").collect()
    assert len(seen) == 1000 and len(got) == 18 * len(seen)
    for o in seen:
        la, lo, z = o.lat, o.lon, o.alt_m
        for k in range(18):
            b = math.radians(o.track_deg + 0.5 * 5 * (k + 1))
            la += o.speed_mps * 5 * math.cos(b) / M_PER_DEG_LAT
            lo += o.speed_mps * 5 * math.sin(b) / (M_PER_DEG_LON * math.cos(math.radians(la)))
            z += o.vertical_rate_mps * 5
            assert got[o.obs_id, k][:2] == pytest.approx((la, lo), abs=1e-6) and got[o.obs_id, k][2] == pytest.approx(z, abs=2e-3)


def test_nearest_of_many_copies(spark):
    """More equal vectors than a chunk's few best: ties go by key whatever the order of rows."""
    rng = random.Random(4)
    unit = lambda v: [x / math.hypot(*v) for x in v]
    copy = unit([rng.gauss(0, 1) for _ in range(8)])
    keys = rng.sample(range(10_000), 500)
    vectors = {key: copy if i < 300 else unit([rng.gauss(0, 1) for _ in range(8)]) for i, key in enumerate(keys)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in similarity.nearest(df, df, 3).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour
    for key, v in vectors.items():
        best = sorted((round(math.dist(v, w), 9), other) for other, w in vectors.items() if other != key)[:3]
        assert [got[key][i] for i in (1, 2, 3)] == [other for _, other in best]


def test_hour_windows_of_every_track(spark, sf):
    from datetime import timedelta

    from vantage import queries

    want = set()
    for r in queries.rolled(spark, sf).select("track_id", "started", "ended").collect():
        h = r.started.replace(minute=0, second=0, microsecond=0)
        while h <= r.ended:
            want.add((r.track_id, f"window:{h:%Y-%m-%dT%H}"))
            h += timedelta(hours=1)
    assert {tuple(r) for r in queries.hour_windows(spark, sf).collect()} == want


def test_graph_has_similar_tracks(spark, sf):
    from vantage import queries

    t, _, _, pairs = queries._graph(spark, sf)
    v = {r.track_id: r.embedding for r in t.select("track_id", "embedding").collect()}
    best = {a: min((round(math.dist(x, v[b]), 9), b) for b in v if b != a) for a, x in v.items()}
    want = {(min(a, b), max(a, b)): d for a, (d, b) in best.items()}
    assert {(r.a, r.b): round(r.distance, 9) for r in pairs.collect()} == pytest.approx(want)
    assert [r.n for r in queries.graph_edges(spark, sf).where("type = 'similar_to'").collect()] == [5]
