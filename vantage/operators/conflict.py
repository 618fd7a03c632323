"""Closest points of approach, turn rates and predicted paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON, flat_bearing_deg, flat_distance_m

HORIZON_S, H_LIMIT_M, V_LIMIT_M, FRESH_S = 90.0, 1_000.0, 300.0, 30
#: Width of a cell and what rounding may move a place by; states of a cell that meet in one block, and pairs that are taken at once.
CELL_M, SLACK_M, BLOCK, PAIRS = 4_000.0, 1.0, 4_096, 1 << 18


def position_enu(az: Column, el: Column, rng: Column) -> Column:
    a, e = F.radians(az), F.radians(el)
    return F.struct((F.cos(e) * rng * F.sin(a)).alias("e"), (F.cos(e) * rng * F.cos(a)).alias("n"), (rng * F.sin(e)).alias("u"))


def velocity_enu(speed: Column, track: Column, vrate: Column) -> Column:
    b = F.radians(track)
    return F.struct((speed * F.sin(b)).alias("e"), (speed * F.cos(b)).alias("n"), F.coalesce(vrate, F.lit(0.0)).alias("u"))


def cpa(pa: Column, va: Column, pb: Column, vb: Column, horizon: float = HORIZON_S) -> Column:
    """struct<t, dh, dv> of two constant velocities, t within [0, horizon]."""
    p, v = [pb[k] - pa[k] for k in "enu"], [vb[k] - va[k] for k in "enu"]
    v2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    t = F.when(v2 < 1e-9, 0.0).otherwise(-(p[0] * v[0] + p[1] * v[1] + p[2] * v[2]) / F.greatest(v2, F.lit(1e-9)))
    t = F.greatest(F.least(t, F.lit(horizon)), F.lit(0.0))
    return F.struct(t.alias("t"), F.hypot(p[0] + v[0] * t, p[1] + v[1] * t).alias("dh"), F.abs(p[2] + v[2] * t).alias("dv"))


def latest_states(points: DataFrame, now: Column, fresh_seconds: int = FRESH_S) -> DataFrame:
    fresh = points.where(F.unix_micros(now) - F.unix_micros("ts") <= fresh_seconds * 1_000_000)
    last = fresh.groupBy("entity_id").agg(F.max(F.struct("ts", "obs_id", "azimuth_deg", "elevation_deg", "range_m", "speed_mps", "track_deg", "vertical_rate_mps")).alias("s")).select("entity_id", "s.*")
    return last.select("entity_id", position_enu(F.col("azimuth_deg"), F.col("elevation_deg"), F.col("range_m")).alias("p"), velocity_enu(F.col("speed_mps"), F.col("track_deg"), F.col("vertical_rate_mps")).alias("v"), "speed_mps")


def _meet(horizon: float, slice_s: float, id_type: pa.DataType) -> Callable:
    """Pairs of a cell's states, sorted by cell, whose closest approach is too close and falls into
    the cell: ``as_a`` states against ``as_b`` ones, those of one height first."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: t.column(n).to_numpy() for n in t.column_names if n != "id"}
        at, ids = c["slice"] * slice_s, t.column("id").combine_chunks()
        half = (np.minimum(at + slice_s, horizon) - at) / 2
        e, n, u = (c[f"p{x}"] + c[f"v{x}"] * (at + half) for x in "enu")  # halfway through the slice
        cell = np.r_[0, np.cumsum(_starts(c))]
        a, b = np.flatnonzero(c["as_a"]), np.flatnonzero(c["as_b"])
        if not len(a) or not len(b):
            return
        # Cells lie behind one another on a line of heights, wide enough apart: those of a height are a stretch of it.
        reach = V_LIMIT_M + half[a] * (np.abs(c["vu"][a]) + np.abs(c["vu"][b]).max())
        wide = u.max() - u.min() + 2 * reach.max() + 4 * SLACK_M
        line = cell * wide + (u - u.min())
        reach += SLACK_M + 1e-14 * line.max()
        b = b[np.argsort(line[b])]
        lo, hi = np.searchsorted(line[b], line[a] - reach), np.searchsorted(line[b], line[a] + reach, "right")
        ends = np.cumsum(hi - lo)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)), len(a)])
        for s, z in zip(cuts[:-1], cuts[1:]):
            many = (hi - lo)[s:z]
            i, k = np.repeat(a[s:z], many), np.arange(many.sum())
            j = b[k + np.repeat(hi[s:z] - np.cumsum(many), many)]

            def keep(fine: np.ndarray) -> None:
                nonlocal i, j
                i, j = i[fine], j[fine]

            same = np.flatnonzero((c["h"][i] == c["h"][j]) & (i != j))  # rarely any: other ids of one hash
            first = c["h"][i] < c["h"][j]
            first[same] = [ids[x].as_py() < ids[y].as_py() for x, y in zip(i[same], j[same])]
            keep(first)
            for mid, v in ((e, c["ve"]), (n, c["vn"])):
                keep(np.abs(mid[j] - mid[i]) <= H_LIMIT_M + SLACK_M + half[i] * np.abs(v[j] - v[i]))
            p, v = [c[f"p{x}"][j] - c[f"p{x}"][i] for x in "enu"], [c[f"v{x}"][j] - c[f"v{x}"][i] for x in "enu"]
            v2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
            when = np.where(v2 < 1e-9, 0.0, -(p[0] * v[0] + p[1] * v[1] + p[2] * v[2]) / np.maximum(v2, 1e-9))
            when = np.maximum(np.minimum(when, horizon), 0.0)
            dh, dv = np.hypot(p[0] + v[0] * when, p[1] + v[1] * when), np.abs(p[2] + v[2] * when)
            here = np.minimum(np.floor(when / slice_s), np.ceil(horizon / slice_s) - 1) == c["slice"][i]
            for x, cells in (("e", c["cx"]), ("n", c["cy"])):
                here &= np.floor((c[f"p{x}"][i] + c[f"v{x}"][i] * when) / CELL_M) == cells[i]
            here &= (dh < H_LIMIT_M) & (dv < V_LIMIT_M)
            if here.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[here])), ids.take(pa.array(j[here])), pa.array(when[here]), pa.array(dh[here]), pa.array(dv[here])], ["x", "y", "t", "dh", "dv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.set_column(t.column_names.index("id"), "id", t.column("id").cast(id_type))
            held = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            starts = np.flatnonzero(_starts({n: held.column(n).to_numpy() for n in _PLACE}))
            if len(starts):  # the last cell may go on in the next batch
                yield from pairs(held.slice(0, starts[-1] + 1).combine_chunks())
                held = held.slice(starts[-1] + 1)
        if held is not None and len(held):
            yield from pairs(held.combine_chunks())

    return run


_PLACE = ["slice", "cx", "cy", "block"]


def _starts(c: dict[str, np.ndarray]) -> np.ndarray:
    """True where a row's place differs from that of the row before; without the first row."""
    return np.logical_or.reduce([c[n][1:] != c[n][:-1] for n in _PLACE])


def conflicts(states: DataFrame, horizon: float = HORIZON_S, slice_s: float = 15.0) -> DataFrame:
    """(a, b, t, dh, dv) of pairs that come too close within the horizon, soonest first.

    Pairs that do are less than H_LIMIT_M apart, on the ground, at the moment t of their closest
    approach. So each state goes, slice by slice of the horizon, into the cells that its own
    straight path crosses or passes within that limit. A pair counts in one of them alone: the
    slice of its closest approach, and the cell where one of the two, the one with the smaller
    hash, is then. A fast state passes more cells and widens nobody else's. Crowded cells are
    dealt to blocks of about BLOCK states that meet each other pair by pair of blocks.
    """
    state = [F.col(f"{x}.{k}").cast("double").alias(f"{x}{k}") for x in "pv" for k in "enu"]
    flat = states.where("entity_id is not null").select(F.col("entity_id").alias("id"), F.xxhash64("entity_id").alias("h"), *state)
    for x in flat.columns[2:]:
        flat = flat.where(F.abs(x) < float("inf"))
    cut = flat.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(horizon / slice_s)) - 1))))

    def cells(axis: str, margin: float) -> list[Column]:
        ends = [F.col(f"p{axis}") + F.col(f"v{axis}") * F.least((F.col("slice") + k) * F.lit(slice_s), F.lit(horizon)) for k in (0, 1)]
        return [F.floor((F.least(*ends) - margin) / CELL_M), F.floor((F.greatest(*ends) + margin) / CELL_M)]

    own = F.lit(True)
    for axis, place in (("e", "cx"), ("n", "cy")):
        cut = cut.withColumn(place, F.explode(F.sequence(*cells(axis, H_LIMIT_M + SLACK_M))))
        own &= F.col(place).between(*cells(axis, SLACK_M))
    cut = cut.withColumn("own", own)
    crowds = cut.groupBy("slice", "cx", "cy").agg(F.ceil(F.count("*") / BLOCK).alias("k")).where("k > 1")  # few: a BLOCK of rows each
    # Block i * k + j of a cell of k * k holds its i-th part's own states against its j-th part.
    k, mine = F.coalesce("k", F.lit(1)), F.pmod("h", F.coalesce("k", F.lit(1)))
    each = F.sequence(F.lit(0).cast("long"), k - 1)
    as_b = F.transform(each, lambda x: x * k + mine)
    blocks = F.when(k == 1, F.array(F.lit(0).cast("long"))).when(F.col("own"), F.array_union(as_b, F.transform(each, lambda x: mine * k + x))).otherwise(as_b)
    dealt = cut.join(F.broadcast(crowds), ["slice", "cx", "cy"], "left").withColumn("block", F.explode(blocks))
    dealt = dealt.select("slice", "cx", "cy", "block", "id", "h", *flat.columns[2:], (F.col("own") & (F.floor(F.col("block") / k) == mine)).alias("as_a"), (F.col("block") % k == mine).alias("as_b"))
    spark, kind = states.sparkSession, states.schema["entity_id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = dealt.repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(_meet(horizon, slice_s, id_type), f"x {kind}, y {kind}, t double, dh double, dv double")
    # Dealt out once more, so that sorting doesn't look for the pairs twice.
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "t", "dh", "dv").repartition("a", "b").orderBy("t", "a", "b")


def heading_rate(points: DataFrame, now: Column, seconds: float = 90.0) -> DataFrame:
    """(entity_id, rate_deg_s): mean signed turn rate between steps of more than 30 m; 0 without any."""
    w = Window.partitionBy("entity_id").orderBy("ts", "obs_id")
    new = points.where(F.unix_micros("ts") >= F.unix_micros(now) - int(seconds * 1e6))
    dt = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6
    prev = [F.lag(c).over(w) for c in ("lat", "lon")]
    step = new.withColumns({"dt": dt, "d": flat_distance_m(*prev, F.col("lat"), F.col("lon")), "b": flat_bearing_deg(*prev, F.col("lat"), F.col("lon"))})
    turn = F.pmod(F.col("b") - F.lag("b").over(w) + 540, F.lit(360.0)) - 180
    rates = step.where("d > 30 and dt > 0").withColumn("rate", turn / F.col("dt")).groupBy("entity_id").agg(F.avg("rate").alias("rate"))
    return points.select("entity_id").distinct().join(rates, "entity_id", "left").select("entity_id", F.coalesce("rate", F.lit(0.0)).alias("rate_deg_s"))


def predicted_path(lat: Column, lon: Column, alt: Column, speed: Column, track: Column, vrate: Column, rate: Column, seconds: int = 90, step: int = 5) -> Column:
    """Array of (lat, lon, alt_m) every ``step`` seconds; the heading turns before each step."""
    start = F.array(F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), alt.cast("double").alias("alt_m")))

    def go(path: Column, k: Column) -> Column:
        at, b = F.element_at(path, -1), F.radians(track + rate * k)
        la = at["lat"] + speed * step * F.cos(b) / M_PER_DEG_LAT
        lo = at["lon"] + speed * step * F.sin(b) / (M_PER_DEG_LON * F.cos(F.radians(la)))
        return F.array_append(path, F.struct(la.alias("lat"), lo.alias("lon"), (at["alt_m"] + F.coalesce(vrate, F.lit(0.0)) * step).alias("alt_m")))

    out = F.aggregate(F.sequence(F.lit(step), F.lit(seconds), F.lit(step)), start, go)
    return F.slice(out, 2, seconds // step)


def predicted_cone(rate: Column, speed: Column, **at: Column) -> Column:
    """struct<center, left, right> of paths; null below 20 m/s."""
    spread = 0.3 + F.abs(rate) * 0.5
    paths = [predicted_path(speed=speed, rate=r, **at).alias(n) for n, r in (("center", rate), ("left", rate - spread), ("right", rate + spread))]
    return F.when(speed >= 20, F.struct(*paths))
