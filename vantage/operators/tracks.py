"""Sessions of observations, and what is known of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GAP_SECONDS, OVERHEAD_ELEVATION_DEG, OVERHEAD_RANGE_M
from ..functions.geo import cos_deg, flat_distance_m, normalize_deg, sin_deg

_ORDER = ["ts", "obs_id"]


def stitch(obs: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Adds segment, track_id and the filled callsign: one shuffle by entity for all windows.

    A new segment starts where whole elapsed seconds exceed the gap; segments count from 0 per
    entity. A segment's callsign is the entity's first non-empty one up to the segment's end. Where
    rows tell their entity type, those of aircraft alone are stitched.
    """
    obs = obs.where("entity_type = 'aircraft'") if "entity_type" in obs.columns else obs
    by = Window.partitionBy("entity_id").orderBy(*_ORDER)
    gap = F.expr("timestampdiff(SECOND, _prev, ts)") > gap_seconds
    out = obs.withColumn("_prev", F.lag("ts").over(by))
    out = out.withColumn("segment", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.first(F.nullif("callsign", F.lit("")), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("entity_id", "segment").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_known", known).withColumn("callsign", F.coalesce(F.last("_known").over(whole), F.lit("")))
    return out.withColumn("track_id", F.format_string("track-%s-%d", "entity_id", "segment")).drop("_prev", "_known")


def steps(points: DataFrame) -> DataFrame:
    """Adds step_m, the distance from the point before in the track (null at the first)."""
    w = Window.partitionBy("entity_id", "segment").orderBy(*_ORDER)
    return points.withColumn("step_m", flat_distance_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def circular_mean(deg: Column | str) -> Column:
    """Opposite angles leave only the rounding errors of their sines, so these must have SQL's last bits."""
    return normalize_deg(F.degrees(F.atan2(F.sum(sin_deg(deg)), F.sum(cos_deg(deg)))))


def roll_up(points: DataFrame) -> DataFrame:
    """One row per track; ties of the closest point go to the earliest."""
    closest = F.struct("range_m", "ts", "obs_id", "azimuth_deg")
    at = F.struct("ts", "obs_id", "lat", "lon", "range_m")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rolled = steps(points).groupBy("entity_id", "segment", "track_id").agg(
        F.first("callsign").alias("callsign"), F.count("*").alias("n_points"), F.min(at).alias("_a"), F.max(at).alias("_z"), F.min(closest).alias("_c"),
        F.max("elevation_deg").alias("max_elevation_deg"), zero(F.avg("alt_m")).alias("mean_alt_m"), zero(F.stddev_pop("alt_m")).alias("std_alt_m"),
        F.min("alt_m").alias("min_alt_m"), F.max("alt_m").alias("max_alt_m"), zero(F.avg("speed_mps")).alias("mean_speed_mps"), zero(F.stddev_pop("speed_mps")).alias("std_speed_mps"),
        zero(F.avg("signal_dbfs")).alias("mean_signal_dbfs"), zero(F.avg("elevation_deg")).alias("mean_elevation_deg"), zero(F.avg(F.abs("vertical_rate_mps"))).alias("mean_abs_vrate_mps"),
        F.avg((F.col("vertical_rate_mps") > 2).cast("double")).alias("climb_ratio"), F.avg((F.col("vertical_rate_mps") < -2).cast("double")).alias("descent_ratio"),
        circular_mean("track_deg").alias("heading_deg"), zero(F.sum("step_m")).alias("path_m"),
        *[F.avg((F.floor(F.pmod(F.col("azimuth_deg"), F.lit(360.0)) / 45) % 8 == b).cast("double")).alias(f"az_{b}") for b in range(8)],
    )
    net = flat_distance_m(F.col("_a.lat"), F.col("_a.lon"), F.col("_z.lat"), F.col("_z.lon"))
    out = rolled.select(
        "*", F.col("_a.ts").alias("started"), F.col("_z.ts").alias("ended"), F.col("_a.obs_id").alias("first_obs"), F.col("_z.obs_id").alias("last_obs"), F.col("_c.obs_id").alias("closest_obs"),
        F.col("_c.range_m").alias("min_range_m"), F.col("_c.ts").alias("closest_approach"), F.col("_c.azimuth_deg").alias("closest_azimuth_deg"), F.col("_a.range_m").alias("start_range_m"), F.col("_z.range_m").alias("end_range_m"),
        F.when(F.col("path_m") < 1, 1.0).otherwise(F.least(F.try_divide(net, F.col("path_m")), F.lit(1.0))).alias("straightness"),
    ).drop("_a", "_z", "_c")
    over = (F.col("min_range_m") < OVERHEAD_RANGE_M) & (F.col("max_elevation_deg") > OVERHEAD_ELEVATION_DEG)
    return out.withColumn("start_hour", F.hour("started")).withColumn("overhead", over)


def overhead(tracks: DataFrame) -> DataFrame:
    return tracks.where("overhead").orderBy("track_id")


def active_in(tracks: DataFrame, start: Column, end: Column) -> DataFrame:
    """(entity_id, track_id) of tracks that touch [start, end], in whole seconds, sorted."""
    sec = F.unix_seconds
    return tracks.where((sec("started") <= sec(end)) & (sec("ended") >= sec(start))).select("entity_id", "track_id").orderBy("entity_id", "track_id")


def heading_histogram(points: DataFrame, bins: int = 8) -> DataFrame:
    width = 360.0 / bins
    counts = [F.sum((F.floor(normalize_deg(F.col("track_deg")) / width) % bins == b).cast("int")).alias(f"h{b}") for b in range(bins)]
    return points.groupBy("track_id").agg(*counts)


def derived_motion(points: DataFrame) -> DataFrame:
    """Speed, heading and climb from positions alone: the arriving step's, carried where time
    or place stand still; the first point copies the second."""
    from ..functions.geo import flat_bearing_deg

    w = Window.partitionBy("track_id").orderBy(*_ORDER)
    dt = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6
    la, lo, al = (F.lag(c).over(w) for c in ("lat", "lon", "alt_m"))
    d = flat_distance_m(la, lo, F.col("lat"), F.col("lon"))
    raw = points.withColumns({"_dt": dt, "_d": d, "_b": flat_bearing_deg(la, lo, F.col("lat"), F.col("lon")), "_z": F.col("alt_m") - al, "_n": F.row_number().over(w)})
    moved = F.col("_dt") > 0
    step = raw.withColumns({"_v": F.when(moved, F.col("_d") / F.col("_dt")), "_h": F.when(moved & (F.col("_d") > 0), F.col("_b")), "_r": F.when(moved, F.col("_z") / F.col("_dt"))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = step.withColumns({o: F.coalesce(F.last(c, True).over(upto), F.lit(0.0)) for c, o in (("_v", "_sv"), ("_h", "_sh"), ("_r", "_sr"))})
    first = {o: F.when(F.col("_n") == 1, F.coalesce(F.lead(c).over(w), F.lit(0.0))).otherwise(F.col(c)) for c, o in (("_sv", "derived_speed_mps"), ("_sh", "derived_track_deg"), ("_sr", "derived_vrate_mps"))}
    return carried.withColumns(first).drop("_dt", "_d", "_b", "_z", "_n", "_v", "_h", "_r", "_sv", "_sh", "_sr")


def recent(points: DataFrame, now: Column, seconds: float) -> DataFrame:
    return points.where(F.unix_micros("ts") >= F.unix_micros(now) - int(seconds * 1e6))


def trail(points: DataFrame, upto: Column, n: int = 150) -> DataFrame:
    """Each track's last n points up to a time."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("obs_id"))
    return points.where(F.col("ts") <= upto).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Backward as-of join: each left row with the right row's values of the latest time <= its own.

    Both sides meet in one union and one window by key, so there is no join to multiply rows;
    of right rows with the same time the one with the largest values counts.
    """
    packed = F.struct(*values).alias("_v")
    rows = left.select(*left.columns, F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"), F.lit(1).alias("_side"))
    others = right.select(*keys, time, packed, F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(others, allowMissingColumns=True).withColumn("_m", F.last("_v", True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_m.{v}").alias(f"asof_{v}") for v in values])


