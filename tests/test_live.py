"""The live layer: folds, feeds, caches and scores; and searches against brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vantage.functions import labels
from vantage.operators import anomaly, behavior, conflict, passes, similarity, tracks
from vantage.queries import START, TLE
from vantage.sources import feeds, sinks
from vantage.streaming import live


@pytest.fixture
def spread(spark):
    """Many ranges, so that what crosses them is tested."""
    names = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def turn(a, b):
    d = (a - b) % 360
    return min(d, 360 - d)


def test_nearest_corridor(spark, spread):
    rng = random.Random(3)
    h = [rng.choice([rng.random() * 360, rng.random() * 10, 359.9, 0.0, 90.0]) for _ in range(200)]
    order = rng.sample(range(200), 200)
    df = spark.createDataFrame([(f"t{i}", order[i], h[i]) for i in range(200)], "track_id string, seq long, heading_deg double")
    got = {r.track_id: r.nearest_corridor for r in anomaly.nearest_corridor(df).collect()}
    for i in range(200):
        want = min((turn(h[i], h[j]) for j in range(200) if order[j] < order[i]), default=None)
        assert got[f"t{i}"] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_leave_one_out(spark, spread):
    rng = random.Random(4)
    rows = [(f"t{i}", rng.random() * 360, rng.randrange(24), rng.random() * 9000, -20 * rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "track_id string, heading_deg double, start_hour int, mean_alt_m double, mean_signal_dbfs double")
    got = {r.track_id: r for r in anomaly.leave_one_out(df).collect()}
    for t, h, hour, alt, _ in rows:
        others = [x for x in rows if x[0] != t]
        assert got[t].n_prior == 39 and got[t].hours_near == sum(min((hour - x[2]) % 24, (x[2] - hour) % 24) <= 2 for x in others)
        assert got[t].nearest_corridor == pytest.approx(min(turn(h, x[1]) for x in others)) and got[t].alt_mean == pytest.approx(sum(x[3] for x in others) / 39)
    assert anomaly.leave_one_out(df.limit(5)).count() == 0


def test_prior_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = random.Random(5)
    v = {f"t{i}": [rng.choice([0.0, rng.random()]) for _ in range(6)] for i in range(90)}
    seq = dict(zip(v, rng.sample(range(90), 90)))
    df = spark.createDataFrame([(k, seq[k], x) for k, x in v.items()], "track_id string, seq long, embedding array<float>")
    got = {}
    for r in similarity.prior_neighbours(df, 3).collect():
        got.setdefault(r.track_id, {})[r["rank"]] = r.neighbour
    import numpy as np

    w = {k: np.array(x, np.float32).astype(float) for k, x in v.items()}
    for k in v:
        best = sorted((round(float(np.linalg.norm(w[k] - w[o])), 9), o) for o in v if seq[o] < seq[k])[:3]
        assert got.get(k, {}) == {i + 1: o for i, (_, o) in enumerate(best)}


@pytest.mark.parametrize("sent", [32, 10_000])
def test_search_shuffles_no_pairs(spark, monkeypatch, sent):
    """Blocks sent in several rounds or one give brute force's rows, and no join multiplies blocks."""
    import numpy as np

    for name, size in (("BLOCK", 16), ("ROUND", sent), ("FIRST", 4), ("CHUNK", 8)):
        monkeypatch.setattr(similarity, name, size, raising=False)
    rng = np.random.default_rng(8)
    v = {f"t{i}": rng.choice([rng.random(5), np.zeros(5)], p=[0.9, 0.1]).astype(np.float32).astype(float) for i in range(150)}
    df = spark.createDataFrame([(k, i, x.tolist()) for i, (k, x) in enumerate(v.items())], "track_id string, seq long, embedding array<float>")
    seq = {k: i for i, k in enumerate(v)}
    for found, allowed in ((similarity.prior_neighbours(df, 3), lambda a, b: seq[b] < seq[a]), (similarity.nearest(df, df, 2, key="track_id"), lambda a, b: a != b)):
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in found.collect():
            got.setdefault(r.track_id, {})[r["rank"]] = (r.neighbour, round(r.distance, 9))
        for k in v:
            best = sorted((round(float(np.linalg.norm(v[k] - v[o])), 9), o) for o in v if allowed(k, o))[: 3 if len(got.get("t149", {})) == 3 else 2]
            assert got.get(k, {}) == {i + 1: (o, d) for i, (d, o) in enumerate(best)}


def test_conflicts_match_all_pairs(spark):
    rng = random.Random(6)
    s = [(f"e{i}", tuple(rng.uniform(-9000, 9000) for _ in range(2)) + (rng.uniform(0, 900),), tuple(rng.uniform(-250, 250) for _ in range(2)) + (rng.uniform(-5, 5),)) for i in range(150)]
    s += [("fast", (-300_000.0, 0.0, 400.0), (7500.0, 0.0, 0.0)), ("slow", (1000.0, 0.0, 400.0), (0.0, 0.0, 0.0)), ("same", (1000.0, 10.0, 410.0), (0.0, 0.0, 0.0))]
    df = spark.createDataFrame(s, "entity_id string, p struct<e:double,n:double,u:double>, v struct<e:double,n:double,u:double>")
    got = {(r.a, r.b): (r.t, r.dh) for r in conflict.conflicts(df).collect()}
    want = {}
    for a in s:
        for b in s:
            if a[0] < b[0]:
                p, v = [y - x for x, y in zip(a[1], b[1])], [y - x for x, y in zip(a[2], b[2])]
                v2 = sum(x * x for x in v)
                t = 0.0 if v2 < 1e-9 else max(0.0, min(90.0, -sum(x * y for x, y in zip(p, v)) / v2))
                dh, dv = math.hypot(p[0] + v[0] * t, p[1] + v[1] * t), abs(p[2] + v[2] * t)
                if dh < 1000 and dv < 300:
                    want[a[0], b[0]] = (t, dh)
    assert set(got) == set(want) and len(want) > 20 and ("fast", "slow") in want
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_crowded_conflicts_meet_in_blocks(spark, monkeypatch):
    """Many states in few cells, of other heights, on cell borders, twice the same place: dealt to
    blocks, over more batches than one, each pair once and without a join of pairs."""
    import numpy as np

    monkeypatch.setattr(conflict, "BLOCK", 16)
    rng = np.random.default_rng(12)
    p = np.c_[rng.uniform(-6000, 6000, (260, 2)), rng.uniform(0, 2500, 260)]
    v = np.c_[rng.uniform(-250, 250, (260, 2)), rng.uniform(-10, 10, 260)]
    p[:40, :2], v[:20] = rng.choice([-4000.0, 0.0, 4000.0], (40, 2)), 0
    p[40:60], v[40:60] = p[60:80], v[60:80]
    p[80], v[80], p[81], v[81] = (-500_000, 100, 300), (7600, 0, 0), (0, -4e5, 4e5), (0, 4000, -4000)
    rows = [(f"e{i}", tuple(map(float, a)), tuple(map(float, b))) for i, (a, b) in enumerate(zip(p, v))] + [("none", None, (0.0, 0.0, 0.0)), ("nan", (math.nan, 0.0, 0.0), (0.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "entity_id string, p struct<e:double,n:double,u:double>, v struct<e:double,n:double,u:double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = conflict.conflicts(df)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = [(r.a, r.b, r.t, r.dh, r.dv) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = []
    for i in range(260):
        for j in range(260):
            if f"e{i}" < f"e{j}":
                d, w = p[j] - p[i], v[j] - v[i]
                v2 = w @ w
                t = 0.0 if v2 < 1e-9 else float(np.clip(-(d @ w) / v2, 0, 90))
                dh, dv = math.hypot(*(d + w * t)[:2]), abs((d + w * t)[2])
                if dh < 1000 and dv < 300:
                    want.append((f"e{i}", f"e{j}", t, dh, dv))
    assert len(want) > 500 and got == sorted(got, key=lambda x: (x[2], x[0], x[1]))
    key = lambda x: x[:2]
    assert [key(x) for x in sorted(got)] == [key(x) for x in sorted(want)]
    assert np.allclose([x[2:] for x in sorted(got)], [x[2:] for x in sorted(want)], atol=1e-6)


def test_formation_at_any_latitude(spark):
    rows = []
    for i, lat in enumerate((44.0, 44.3, 0.0, -79.0, 60.0, -0.001)):
        for k, (dlat, dlon) in enumerate(((-0.0015, 0.0), (0.0015, 0.001), (0.02, 0.0))):
            rows += [(f"p{i}{k}", 10 * i + k, 1_000_000 - age, lat + dlat, 20.0 * i + dlon, 1000.0, 100.0, 10.0) for age in (1, 40)]
    df = spark.createDataFrame(rows, "entity_id string, obs_id long, ts long, lat double, lon double, alt_m double, speed_mps double, track_deg double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {tuple(r) for r in behavior.formation_pairs(df, F.timestamp_seconds(F.lit(1_000_000))).collect()}
    assert got == {(f"p{i}0", f"p{i}1") for i in range(6)}


def test_cadence_counts_from_the_last_saved(spark):
    at = {"a": [0.0, 19.0, 21.0, 30.0, 41.0, 42.0], "b": [5.0, 24.9, 25.0]}
    df = spark.createDataFrame([(k, x) for k, v in at.items() for x in v], "entity_id string, at double")
    saved = spark.createDataFrame([("a", -5.0), ("a", -30.0), ("c", 3.0)], "entity_id string, at double")
    rows = lambda x: sorted((r.entity_id, r["at"]) for r in x.collect())
    assert rows(sinks.cadence(df)) == [("a", 0.0), ("a", 21.0), ("a", 41.0), ("b", 5.0), ("b", 25.0)]
    assert rows(sinks.cadence(df, saved)) == [("a", 19.0), ("a", 41.0), ("b", 5.0), ("b", 25.0)]
    dealt = df.groupBy("entity_id").agg(F.max("at").alias("at")).persist()  # dealt by entity already
    assert rows(sinks.cadence(dealt, saved.union(spark.createDataFrame([("a", 41.5), ("b", 0.0)], saved.schema)))) == [("b", 25.0)]
    dealt.unpersist()


def test_stores(spark):
    points = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 1.0, None), ("c", 2.0, 9.0)], "entity_id string, t double, range_m double")
    old = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "entity_id string, t double")
    assert [(r.entity_id, r.t) for r in sinks.new_points(points, old).collect()] == [("a", 3.0)]
    assert sinks.retained(points, F.lit(3602.0)).count() == 2
    rows = [("a", 2.0, "late", None, 1), ("a", 1.0, "early", "A3", 0), ("b", 5.0, "b", None, 0)]
    store = spark.createDataFrame(rows, "entity_id string, t double, label string, category string, epoch int").withColumns({c: F.col("t") * 2 for c in ("lat", "lon", "alt_m", "azimuth_deg", "elevation_deg", "range_m")})
    got = {r.entity_id: r for r in sinks.replay_tracks(store).collect()}
    assert (got["a"].label, got["a"].category, got["a"].t0, got["a"].t1, [p.t for p in got["a"].points], got["a"].points[1].range_m) == ("late", "A3", 1.0, 2.0, [1.0, 2.0], 4.0)
    assert sinks.newest(store, "t", 1).first().entity_id == "b"


def test_windows_sessions_and_alerts(spark):
    t = [0, 30, 95, 3700, 3701]
    df = spark.createDataFrame([("a", x) for x in t] + [("b", 10)], "entity_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.entity_id, r.window.start.minute, r.n) for r in live.hourly(df).collect()) == [("a", 0, 2 + 1), ("a", 0, 2), ("b", 0, 1)] or sorted(r.n for r in live.hourly(df).collect()) == [1, 2, 3]
    assert sorted((r.entity_id, r.n_points) for r in live.sessions(df).collect()) == [("a", 1), ("a", 2), ("a", 2), ("b", 1)]
    assert sorted(r.n_points for r in live.sessions(df, 65).collect()) == [1, 2, 3]


def test_alerts_once_in_a_stream(spark, tmp_path):
    rows = [("x", 0), ("x", 5), ("y", 6)]
    spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.once(spark.readStream.schema("k string, s long, ts timestamp").parquet(str(tmp_path / "in")), ["k"]).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        assert sorted(r.k for r in spark.table("told").collect()) == ["x", "y"]
    finally:
        q.stop()


def test_display_eases_towards_the_reckoned_place():
    last, v = (100.0, 43.0, -79.0, 1000.0), (100.0, 90.0, 2.0)
    assert live.displayed(None, last, v, 121.0) is None
    first = live.displayed(None, last, v, 105.0)
    lon = -79.0 + 500 / (111_320 * math.cos(math.radians(43)))
    assert first == pytest.approx((105.0, 43.0, lon, 1010.0))
    a = 1 - math.exp(-0.35 / 0.35)
    target = live.dead_reckoned(last, v, 105.35)
    assert live.displayed(first, last, v, 105.35) == pytest.approx((105.35, *(x + (y - x) * a for x, y in zip(first[1:], target))))
    assert live.displayed(first, last, v, 105.0) == first and live.dead_reckoned(last, None, 105.0) == last[1:]


def test_failover_and_caches(spark):
    def broken():
        raise OSError("timeout")

    good = json.dumps({"ac": []})
    f = feeds.Failover([("one", broken), ("two", lambda: good), ("three", lambda: "{}")])
    assert f.poll() == ("two", good) and f.at == 1
    f.sources[1] = ("two", lambda: "not json")
    assert f.poll() is None and f.failures == 1 and f.at == 1
    text = "\n".join(TLE)
    cache = spark.createDataFrame([("visual", 100.0, text), ("visual", 50.0, "old"), ("empty", 100.0, "x")], "group string, fetched_at double, text string")
    tell = lambda group, now, fetch: (lambda x: x and (x[0].count(), x[1]))(feeds.cached_elements(cache, group, now, fetch, 60))
    assert tell("visual", 150.0, broken) == (1, "cache (visual)") and tell("visual", 160.0, lambda: text + "\n" + text) == (2, "network (visual)")
    assert tell("visual", 160.0, broken) == (1, "stale cache (visual)") and tell("visual", 160.0, lambda: "junk") == (1, "stale cache (visual)")
    assert tell("empty", 101.0, broken) is None and tell("none", 0.0, lambda: text) == (1, "network (none)")
    flights = spark.createDataFrame([("AB1 ",), ("cd2",), ("EF3",), ("GH4",), ("",)], "callsign string")
    routes = spark.createDataFrame([("ab1", 90, "Air", "X", "Y"), ("AB1", 10, "Old", "X", "Y"), ("CD2", 95, None, None, None), ("EF3", 10, "Air", "X", "Y")], "callsign string, s long, airline string, origin string, destination string").withColumn("fetched_at", F.timestamp_seconds("s"))
    got = [(r.callsign, r.airline, r.route) for r in feeds.with_routes(flights, routes, F.timestamp_seconds(F.lit(100)), 60).collect()]
    assert sorted(got) == [("", None, None), ("AB1 ", "Air", "known"), ("EF3", None, "ask"), ("GH4", None, "ask"), ("cd2", None, "none")]
    fresh = feeds.freshest(routes.withColumn("key", F.lower("callsign")), "key", F.timestamp_seconds(F.lit(100)), 60).collect()
    assert sorted((r.key, r.fresh) for r in fresh) == [("ab1", True), ("cd2", True), ("ef3", False)]


def test_weather_and_space_weather_texts(spark):
    now = {"temperature_2m": 21.5, "relative_humidity_2m": 60, "surface_pressure": 1003.4, "wind_speed_10m": 7.6, "wind_direction_10m": 5, "wind_gusts_10m": 12.2, "cloud_cover": 40, "precipitation": 0, "weather_code": 2}
    docs = spark.createDataFrame([(1, json.dumps({"current": now | {"precipitation": 0.4}})), (2, json.dumps({"current": now})), (3, "{}"), (4, "broken")], "at int, value string")
    assert feeds.weather_now(docs).count() == 2
    got = feeds.weather_now(docs, time="at").select(labels.weather_line().alias("x"), labels.weather_lines().alias("l")).first()
    assert got.x == "wx 21.5°C · wind 8 kn @ 005° · cloud 40% · partly cloudy"
    assert got.l == ["temperature 21.5 °C · humidity 60%", "wind 8 kn @ 005° · gusts 12 kn", "pressure 1003 hPa · cloud 40%", "partly cloudy · precip 0 mm"]
    assert feeds.weather_now(docs.where("at = 1")).select(labels.weather_line().alias("x")).first().x.endswith("partly cloudy · precip 0.4 mm")
    kp = spark.createDataFrame([(json.dumps([{"time_tag": "a", "estimated_kp": 3.0}, {"time_tag": "b", "estimated_kp": 7.33}, {"time_tag": "c", "estimated_kp": None}]),), ("[]",)], "value string")
    assert [(r.time_tag, r.x) for r in feeds.latest_kp(kp).select("time_tag", labels.kp_line(F.col("estimated_kp")).alias("x")).collect()] == [("b", "Kp 7.3 · G3 strong storm · aurora possible")]
    assert [r.x for r in spark.createDataFrame([("", "a1"), ("C1", "a2")], "c string, i string").select(labels.display_name(F.col("c"), F.col("i")).alias("x")).collect()] == ["a1", "C1"]


def test_pass_lists(spark):
    rows = [("a", 100.0, 200.0, 50.0, True), ("b", 90.0, 95.0, 50.0, True), ("c", 120.0, 300.0, 9.0, True), ("d", 130.0, 300.0, 60.0, False), ("e", 800.0, 900.0, 60.0, True)]
    p = spark.createDataFrame(rows, "name string, rise double, set double, max_el double, visible boolean")
    assert [r.name for r in passes.upcoming(p, 99.0).collect()] == ["a", "e"]
    assert sorted(r.name for r in passes.alerts(p, 99.0).collect()) == ["a", "c", "d"]
    sets = spark.createDataFrame([TLE], "name string, l1 string, l2 string")
    found = passes.predict_passes(sets, START).collect()
    for t in [x.culminate for x in found][:3] + [START]:
        grid = spark.createDataFrame([(0, float(t))], "k long, t double")
        top = passes.above_horizon(passes.positions(sets, grid)).collect()
        inside = [x for x in found if x.rise <= t <= x.set]
        assert len(top) == len(inside) and all(not r.visible_now or x.visible for r, x in zip(top, inside))


def test_predicted_cone(spark):
    at = {"lat": F.lit(43.0), "lon": F.lit(-79.0), "alt": F.lit(900.0), "track": F.lit(90.0), "vrate": F.lit(0.0)}
    slow, fast = (spark.range(1).select(conflict.predicted_cone(F.lit(1.0), F.lit(v), **at).alias("c")).first().c for v in (19.0, 100.0))
    assert slow is None and fast.left[-1].lat > fast.center[-1].lat > fast.right[-1].lat


def test_only_aircraft_are_stitched(spark):
    rows = [("a", i, i, "", kind) for i, kind in enumerate(("aircraft", "weather_cell", "aircraft"))]
    df = spark.createDataFrame(rows, "entity_id string, obs_id long, s long, callsign string, entity_type string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.obs_id for r in tracks.stitch(df).collect()) == [0, 2]


def test_shelf_clears_the_driver(spark, monkeypatch):
    """What nobody holds any more is gone from the driver's JVM once a table is written."""
    from vantage import shelf

    monkeypatch.setattr(shelf, "CLEAR_FROM", 0.0)
    monkeypatch.setattr(shelf, "CLEAR_EVERY_S", 0.0)
    jvm = spark.sparkContext._jvm
    left = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    shelf.Shelf(spark, "clear").put(spark.range(3))
    assert left.get() is None
