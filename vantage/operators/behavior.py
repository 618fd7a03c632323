"""Holding, survey grids, go-arounds and formations, judged as of one moment.

``points`` has entity_id, ts, obs_id, lat, lon, alt_m, speed_mps, track_deg; ``now`` is a
literal or column expression the same for all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.geo import circular_diff_deg, ecef, flat_bearing_deg, flat_distance_m
from .tracks import recent

BADGES = {"holding": "HOLD", "grid": "GRID", "goaround": "G/A", "formation": "FORM"}


def _in_time() -> WindowSpec:
    return Window.partitionBy("entity_id").orderBy("ts", "obs_id")


def _ends(points: DataFrame) -> Column:
    at = F.struct("ts", "obs_id", "lat", "lon")
    a, z = F.min(at), F.max(at)
    return flat_distance_m(a["lat"], a["lon"], z["lat"], z["lon"])


def holding(points: DataFrame, now: Column) -> DataFrame:
    """entity_id of those that flew 4 km or more in 6 minutes and got less than a quarter of it away."""
    w = recent(points, now, 360).withColumn("d", flat_distance_m(F.lag("lat").over(_in_time()), F.lag("lon").over(_in_time()), F.col("lat"), F.col("lon")))
    by = w.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("d").alias("path"), _ends(w).alias("net"))
    return by.where("n >= 8 and path >= 4000 and net / path < 0.25").select("entity_id")


def go_around(points: DataFrame, now: Column) -> DataFrame:
    """entity_id of those that sank to 600 m or less within 10 minutes and climbed out again."""
    w = recent(points, now, 600).withColumn("i", F.row_number().over(_in_time()))
    low = w.groupBy("entity_id").agg(F.count("*").alias("n"), F.min(F.struct("alt_m", "i")).alias("m"))
    both = w.join(low, "entity_id").groupBy("entity_id", "n", "m").agg(F.max(F.when(F.col("i") < F.col("m.i"), F.col("alt_m"))).alias("pre"), F.max(F.when(F.col("i") >= F.col("m.i"), F.col("alt_m"))).alias("post"))
    rule = "n >= 10 and m.alt_m <= 600 and m.i > 1 and m.i - 1 < n - 3 and pre - m.alt_m >= 150 and post - m.alt_m >= 200"
    return both.where(rule).select("entity_id")


def survey_grid(points: DataFrame, now: Column) -> DataFrame:
    """entity_id of those with four or more straight legs and three or more reversals in 20 minutes.

    A leg goes on while the bearing stays within 25 degrees of its own running mean, which no
    window can tell, so each entity's steps are folded as one sorted array.
    """
    w = recent(points, now, 1200)
    step = w.withColumns({"d": flat_distance_m(F.lag("lat").over(_in_time()), F.lag("lon").over(_in_time()), F.col("lat"), F.col("lon")), "b": flat_bearing_deg(F.lag("lat").over(_in_time()), F.lag("lon").over(_in_time()), F.col("lat"), F.col("lon"))})
    by = step.groupBy("entity_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("d") >= 15, F.struct("ts", "obs_id", "d", "b")))).alias("s")).where("n >= 24")
    mean = "pmod(degrees(atan2(a.s, a.c)), 360d)"
    off = f"pmod(x.b - {mean}, 360d)"
    legs = F.expr(f"""aggregate(s, named_struct('s', 0d, 'c', 0d, 'n', 0, 'len', 0d, 'legs', cast(array() as array<double>)),
        (a, x) -> case when a.n > 0 and least({off}, 360d - {off}) < 25
            then named_struct('s', a.s + sin(radians(x.b)), 'c', a.c + cos(radians(x.b)), 'n', a.n + 1, 'len', a.len + x.d, 'legs', a.legs)
            else named_struct('s', sin(radians(x.b)), 'c', cos(radians(x.b)), 'n', 1, 'len', x.d, 'legs', if(a.n >= 4 and a.len >= 800, array_append(a.legs, {mean}), a.legs)) end,
        a -> if(a.n >= 4 and a.len >= 800, array_append(a.legs, {mean}), a.legs))""")
    turns = F.filter(F.sequence(F.lit(1), F.size("legs") - 1), lambda i: circular_diff_deg(F.get("legs", i), F.get("legs", i - 1)) > 155)
    return by.withColumn("legs", legs).where(F.size("legs") >= 4).where(F.size(turns) >= 3).select("entity_id")


def formation_pairs(points: DataFrame, now: Column, cell_m: float = 1_100.0) -> DataFrame:
    """(a, b) of fresh moving entities that fly alike within 1 km now and 1.2 km half a minute ago.

    Latest positions meet by cells of their place on the ellipsoid (earth-centred x, y, z) and the
    cells around, so that only those nearby are paired, at any latitude. Cells are a tenth wider
    than the distance, which covers what flat distances differ from those.
    """
    latest = points.groupBy("entity_id").agg(F.max(F.struct("ts", "obs_id", "lat", "lon", "alt_m", "speed_mps", "track_deg")).alias("p"))
    before = points.where(F.unix_micros("ts") <= F.unix_micros(now) - 30_000_000).groupBy("entity_id").agg(F.max(F.struct("ts", "obs_id", "lat", "lon")).alias("q"))
    fresh = latest.where((F.unix_micros(now) - F.unix_micros("p.ts") < 30_000_000) & (F.col("p.speed_mps") > 30)).join(before, "entity_id", "left")
    at = fresh.withColumn("at", ecef(F.col("p.lat"), F.col("p.lon"), F.lit(0.0)))
    cells = at.select(F.struct("entity_id", "p", "q").alias("e"), *[F.floor(F.col(f"at.{k}") / cell_m).cast("int").alias(f"c{k}") for k in "xyz"])
    around = lambda k: F.explode(F.sequence(F.col(f"c{k}") - 1, F.col(f"c{k}") + 1)).alias(f"c{k}")
    a = cells.select(F.col("e").alias("a"), "cx", "cy", "cz")
    b = cells.select(F.col("e").alias("b"), around("x"), "cy", "cz").select("b", "cx", around("y"), "cz").select("b", "cx", "cy", around("z"))
    p, q = F.col("a.p"), F.col("b.p")
    near = flat_distance_m(p["lat"], p["lon"], q["lat"], q["lon"]) <= 1000
    was = flat_distance_m(F.col("a.q.lat"), F.col("a.q.lon"), F.col("b.q.lat"), F.col("b.q.lon")) > 1200
    alike = (circular_diff_deg(p["track_deg"], q["track_deg"]) <= 15) & (F.abs(p["speed_mps"] - q["speed_mps"]) / F.greatest(p["speed_mps"], q["speed_mps"]) <= 0.15) & (F.abs(p["alt_m"] - q["alt_m"]) <= 600)
    pairs = a.join(b, ["cx", "cy", "cz"]).where((F.col("a.entity_id") < F.col("b.entity_id")) & near & alike & ~F.coalesce(was, F.lit(False)))
    return pairs.select(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"))


def behaviors(points: DataFrame, now: Column) -> DataFrame:
    """(entity_id, behaviors, badges); holding hides a grid."""
    pairs = formation_pairs(points, now)
    found = {"holding": holding(points, now), "grid": survey_grid(points, now), "goaround": go_around(points, now), "formation": pairs.select(F.col("a").alias("entity_id")).union(pairs.select("b")).distinct()}
    out = points.select("entity_id").distinct()
    for k, df in found.items():
        out = out.join(df.withColumn(k, F.lit(True)), "entity_id", "left")
    said = lambda k: F.coalesce(k, F.lit(False)) & (~F.coalesce("holding", F.lit(False)) if k == "grid" else F.lit(True))
    names = F.array_compact(F.array(*[F.when(said(k), k) for k in found]))
    badges = F.array_compact(F.array(*[F.when(said(k), BADGES[k]) for k in found]))
    return out.select("entity_id", names.alias("behaviors"), F.array_join(badges, "·").alias("badges"))
