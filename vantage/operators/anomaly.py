"""Composite anomaly score of each track against strictly earlier ones."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WEIGHTS, AnomalyWeights
from ..functions.geo import circular_diff_deg, clamp01
from ..functions.labels import band, band_rank

ROUTE_DEG, Z_SCALE, HOUR_REACH, HOUR_FULL = 60.0, 2.5, 2, 3.0
ALT_FLOOR, SIGNAL_FLOOR = 500.0, 1.0


def _hour() -> Column:
    return F.date_trunc("hour", "started")


def sequenced(tracks: DataFrame) -> DataFrame:
    """Adds ``seq``, from 0 in order of (started, entity_id, segment).

    Tracks are numbered within each hour, on top of the running count of the hours before, so
    that one task orders no more than an hour's tracks; only the row per hour is ordered globally.
    """
    inside, before = Window.partitionBy("_hour").orderBy("started", "entity_id", "segment"), Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = tracks.groupBy(_hour().alias("_at")).count().select("_at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = tracks.withColumn("_hour", _hour()).withColumn("_in", F.row_number().over(inside))
    out = numbered.join(counts, F.col("_hour").eqNullSafe(F.col("_at")))
    return out.select(*tracks.columns, (F.col("_before") + F.col("_in") - 1).alias("seq"))


def prior_baseline(tracks: DataFrame, weights: AnomalyWeights = WEIGHTS) -> DataFrame:
    """Per track what earlier ones say: counts, means, spreads, nearest heading, hours nearby.

    Sums over the hours before a track's own come from one row per hour; those within the hour
    from a window by hour. Tracks of one hour share their start hour.
    """
    alt, sig = F.col("mean_alt_m"), F.col("mean_signal_dbfs")
    sums = {"n": F.count("*"), "a1": F.sum(alt), "a2": F.sum(alt * alt), "s1": F.sum(sig), "s2": F.sum(sig * sig)}
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_hour").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    small = tracks.select("track_id", "seq", "start_hour", "mean_alt_m", "mean_signal_dbfs", _hour().alias("_hour"))
    totals = small.groupBy(F.col("_hour").alias("_at")).agg(F.first("start_hour").alias("h"), *[c.alias(k) for k, c in sums.items()])
    near = F.aggregate(F.col("hours"), F.lit(0).cast("long"), lambda n, x: n + F.when(F.least(F.pmod(F.col("h") - x["h"], F.lit(24)), F.pmod(x["h"] - F.col("h"), F.lit(24))) <= HOUR_REACH, x["n"]).otherwise(0))
    by_hour = [F.struct(F.lit(h).alias("h"), F.coalesce(F.sum(F.when(F.col("h") == h, F.col("n"))).over(before), F.lit(0)).alias("n")) for h in range(24)]
    earlier = totals.select("_at", "h", F.array(*by_hour).alias("hours"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"p_{k}") for k in sums])
    earlier = earlier.select("_at", near.alias("p_near"), *[f"p_{k}" for k in sums])
    rows = small.select("track_id", "_hour", *[F.coalesce(c.over(inside), F.lit(0)).alias(f"i_{k}") for k, c in sums.items()])
    both = rows.join(earlier, F.col("_hour").eqNullSafe(F.col("_at"))).select("track_id", (F.col("p_near") + F.col("i_n")).alias("hours_near"), *[(F.col(f"p_{k}") + F.col(f"i_{k}")).alias(k) for k in sums])

    def stats(x: str, floor: float) -> tuple[Column, Column]:
        n = F.nullif(F.col("n"), F.lit(0))
        mean = F.col(f"{x}1") / n
        spread = F.sqrt(F.greatest(F.col(f"{x}2") / n - mean * mean, F.lit(0.0)))
        return F.coalesce(mean, F.lit(0.0)), F.when(n.isNull(), 0.0).otherwise(F.greatest(spread, F.lit(floor)))

    (am, asd), (sm, ssd) = stats("a", ALT_FLOOR), stats("s", SIGNAL_FLOOR)
    base = both.select("track_id", F.col("n").alias("n_prior"), am.alias("alt_mean"), asd.alias("alt_std"), sm.alias("sig_mean"), ssd.alias("sig_std"), "hours_near")
    return base.join(nearest_corridor(tracks), "track_id")


_SIDES = "seq long, h double, below double, above double, pid int, note string"


def _smaller(seq: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest place before it with a smaller number (-1 if none), and the
    places that no later one undercuts: where such numbers are looked for from beyond the end."""
    stack: list[int] = []
    out = []
    for i, x in enumerate(seq):
        while stack and seq[stack[-1]] >= x:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out, stack


def _beside(t: pa.Table) -> pa.Table:
    """Headings next below and above among earlier tracks of one range of headings, and a note."""
    t = t.sort_by("h")
    seq, h = t.column("seq").to_pylist(), t.column("h").to_pylist()
    n = len(seq)
    below, left = _smaller(seq)
    above, right = _smaller(seq[::-1])
    above = [n - 1 - i if i >= 0 else -1 for i in reversed(above)]
    pid = t.column("pid")[0].as_py()
    note = json.dumps({"below": [(h[i], seq[i]) for i in left], "above": [(h[n - 1 - i], seq[n - 1 - i]) for i in right]})
    pick = lambda at: pa.array([h[i] if i >= 0 else None for i in at], pa.float64())
    rows = pa.table([t.column("seq"), t.column("h"), pick(below), pick(above), t.column("pid"), pa.nulls(n, pa.string())], [c.split()[0] for c in _SIDES.split(", ")])
    last = pa.table({f.name: pa.array([{"pid": pid, "note": note}.get(f.name)], f.type) for f in rows.schema})
    return pa.concat_tables([rows.combine_chunks(), last])


def _round_trip(notes: dict[int, list], turn: float) -> dict[int, list]:
    """By range what stands before it on the circle: headings, nearest first, with falling
    numbers. ``turn`` is added to headings of ranges that lie a turn away."""
    order, out, came = sorted(notes, reverse=turn > 0), {}, []
    for lap in (1, 0):
        for pid in order:
            out[pid] = came
            own = [(h + turn * lap, s) for h, s in reversed(notes[pid])]
            low = min((s for _, s in own), default=None)
            came = own + [x for x in came if low is None or x[1] < low]
    return out


def nearest_corridor(tracks: DataFrame) -> DataFrame:
    """(track_id, nearest_corridor): smallest turn to a heading of an earlier track, null for the first.

    Of tracks with one heading only the first counts for others, and the rest have it at no turn.
    In the order of headings, the nearest earlier one is the nearest place on either side with a
    smaller ``seq``. Each range of headings finds those with a stack; what a range can't tell is
    looked up among the places of other ranges that nothing nearer undercuts, some log n per
    range. Ranges are cut at fixed values, so that a task that runs again sees the same rows.
    """
    spark = tracks.sparkSession
    rows = tracks.select("track_id", F.col("seq").cast("long").alias("seq"), F.col("heading_deg").alias("h")).where("h is not null")
    firsts = rows.groupBy("h").agg(F.min("seq").alias("seq"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(firsts.approxQuantile("h", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    pid = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("h")))
    solved = firsts.withColumn("pid", pid).groupBy("pid").applyInArrow(_beside, _SIDES)
    notes = {r.pid: json.loads(r.note) for r in solved.where("note is not null").select("pid", "note").collect()}  # one row per range
    below, above = (_round_trip({k: x[side] for k, x in notes.items()}, turn) for side, turn in (("below", -360.0), ("above", 360.0)))
    stair = "array<struct<h:double,seq:long>>"
    near = F.broadcast(spark.createDataFrame([(k, below[k], above[k]) for k in sorted(notes)], f"pid int, b {stair}, a {stair}"))
    first = lambda side, stairs: F.coalesce(F.col(side), F.get(F.filter(stairs, lambda e: e["seq"] < F.col("seq")), 0)["h"])
    told = solved.where("note is null").join(near, "pid").select("h", "seq", F.least(F.col("h") - first("below", "b"), first("above", "a") - F.col("h")).alias("near"), F.lit(True).alias("is_first"))
    out = rows.join(told, ["h", "seq"], "left").select("track_id", F.when(F.col("is_first"), F.col("near")).otherwise(0.0).alias("nearest_corridor"))
    return tracks.select("track_id").join(out, "track_id", "left")


def live_summary(points: DataFrame) -> DataFrame:
    """Live tracks as the score takes them: heading of the latest velocity (0 if none), signal of
    the latest report (-20 if none), elevation from -90 up.

    points: entity_id, t, alt_m, range_m, elevation_deg, and track_deg, rssi and callsign as last known.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t")))
    by = points.groupBy("entity_id").agg(
        F.count("*").alias("n_points"), F.avg("alt_m").alias("mean_alt_m"), F.coalesce(F.min("range_m"), F.lit(0.0)).alias("min_range_m"), F.greatest(F.max("elevation_deg"), F.lit(-90.0)).alias("max_elevation_deg"),
        F.coalesce(last("track_deg"), F.lit(0.0)).alias("heading_deg"), F.coalesce(last("rssi"), F.lit(-20.0)).alias("mean_signal_dbfs"), F.coalesce(last("callsign"), F.lit("")).alias("callsign"), F.min("t").alias("t0"),
    )
    return by.withColumns({"track_id": F.col("entity_id"), "start_hour": F.hour(F.timestamp_micros((F.col("t0") * 1e6).cast("long")))})


def leave_one_out(tracks: DataFrame, least: int = 6) -> DataFrame:
    """Per track what all others say, none of them needing to be earlier: means and spreads from
    totals, start hours nearby from one row per hour, the nearest heading among those before and
    those after in any order. Nothing with fewer than ``least`` tracks."""
    total = tracks.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in ("mean_alt_m", "mean_signal_dbfs") for p, f in (("s", F.sum), ("q", lambda x: F.sum(F.col(x) * F.col(x))))], *[F.count_if(F.col("start_hour") == h).alias(f"h_{h}") for h in range(24)])
    both = tracks.crossJoin(F.broadcast(total)).where(F.col("n") >= least)  # one row of totals

    def stats(c: str, floor: float) -> tuple[Column, Column]:
        m = (F.col(f"s_{c}") - F.col(c)) / (F.col("n") - 1)
        v = (F.col(f"q_{c}") - F.col(c) * F.col(c)) / (F.col("n") - 1) - m * m
        return m, F.greatest(F.sqrt(F.greatest(v, F.lit(0.0))), F.lit(floor))

    hours = F.array(*[F.col(f"h_{h}") for h in range(24)])
    near = sum((F.get(hours, F.pmod(F.col("start_hour") + k, F.lit(24))) for k in range(-HOUR_REACH, HOUR_REACH + 1)), F.lit(0)) - 1
    am, asd = stats("mean_alt_m", ALT_FLOOR)
    sm, ssd = stats("mean_signal_dbfs", SIGNAL_FLOOR)
    out = both.select("track_id", am.alias("alt_mean"), asd.alias("alt_std"), sm.alias("sig_mean"), ssd.alias("sig_std"), (F.col("n") - 1).alias("n_prior"), near.alias("hours_near"))
    code = tracks.select("track_id", "heading_deg", F.xxhash64("track_id").alias("seq"))
    sides = nearest_corridor(code).withColumnRenamed("nearest_corridor", "a").join(nearest_corridor(code.withColumn("seq", -F.col("seq"))).withColumnRenamed("nearest_corridor", "b"), "track_id")
    return out.join(sides.select("track_id", F.least("a", "b").alias("nearest_corridor")), "track_id")


def score(tracks: DataFrame, baseline: DataFrame, novelty: DataFrame, weights: AnomalyWeights = WEIGHTS) -> DataFrame:
    """Components, score, band and reasons of tracks with enough history."""
    t = tracks.join(baseline, "track_id").join(novelty, "track_id").where(F.col("n_prior") >= weights.min_history)
    c = F.col
    alt_z = F.abs(c("mean_alt_m") - c("alt_mean")) / F.greatest(c("alt_std"), F.lit(1.0))
    sig_z = F.when(c("sig_std") == 0, float("inf")).otherwise(F.abs(c("mean_signal_dbfs") - c("sig_mean")) / F.nullif(c("sig_std"), F.lit(0.0)))
    t = t.withColumns({
        "alt_z": alt_z, "sig_z": sig_z,
        "route_deviation": F.coalesce(F.least(c("nearest_corridor") / ROUTE_DEG, F.lit(1.0)), F.lit(0.5)),
        "altitude_deviation": F.least(alt_z / Z_SCALE, F.lit(1.0)),
        "time_of_day_rarity": F.greatest(1 - c("hours_near") / HOUR_FULL, F.lit(0.0)),
        "signal_unusualness": F.least(sig_z / Z_SCALE, F.lit(1.0)),
        "novelty_score": clamp01(c("novelty")),
    })
    parts = [(weights.route, "route_deviation"), (weights.altitude, "altitude_deviation"), (weights.hour, "time_of_day_rarity"), (weights.signal, "signal_unusualness"), (weights.novelty, "novelty_score")]
    t = t.withColumn("score", sum((w * c(p) for w, p in parts[1:]), parts[0][0] * c(parts[0][1])))
    return t.withColumns({"band": band(c("score")), "band_rank": band_rank(c("score")), "reasons": _reasons()})


def _reasons() -> Column:
    c, say = F.col, F.format_string
    told = F.array_compact(F.array(
        F.when(c("route_deviation") > 0.5, say("heading %.0f° is %.0f° from the nearest known corridor", c("heading_deg"), c("nearest_corridor"))),
        F.when(c("altitude_deviation") > 0.5, say("mean altitude %.0f m is %.1fσ from the local mean of %.0f m", c("mean_alt_m"), c("alt_z"), c("alt_mean"))),
        F.when(c("time_of_day_rarity") > 0.5, say("start hour %02d UTC has %d earlier tracks within 2 h", c("start_hour"), c("hours_near"))),
        F.when(c("signal_unusualness") > 0.5, say("signal %.1f dBFS is %.1fσ from the mean of %.1f dBFS", c("mean_signal_dbfs"), c("sig_z"), c("sig_mean"))),
        F.when(c("novelty_score") > 0.5, say("vector novelty %.2f: nothing similar so far", c("novelty_score"))),
        F.when((c("callsign") == "") & (c("score") > 0.30), F.lit("no callsign broadcast")),
    ))
    usual = F.array(say("within the usual range: heading %.0f°, altitude %.0f m, score %.2f", c("heading_deg"), c("mean_alt_m"), c("score")))
    return F.when(F.size(told) > 0, told).otherwise(usual)
