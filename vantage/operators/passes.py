"""Satellite positions and predicted passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OBSERVER, Observer
from ..functions import astro
from ..functions.geo import observer_frame
from ..functions.sgp4 import Elements, propagate


def _propagated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        l1, l2, t = (b.column(c).to_pylist() for c in ("l1", "l2", "t"))
        out, times, at = np.full((len(t), 3), np.nan), np.array(t, float), {}
        for i, key in enumerate(zip(l1, l2, strict=True)):
            at.setdefault(key, []).append(i)
        for key, rows in at.items():
            try:
                el = Elements(*key)
            except (ValueError, IndexError, TypeError):
                continue
            out[rows] = propagate(el, (times[rows] - el.epoch) / 60)
        xyz = [pa.array(np.where(np.isnan(out[:, j]), None, out[:, j]), pa.float64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays([b.column("name"), b.column("k"), b.column("t"), *xyz], ["name", "k", "t", "x", "y", "z"])


def valid_elements(l1: Column, l2: Column) -> Column:
    """Whether a pair of lines has the form and the checksums of an element set."""

    def check(line: Column) -> Column:
        digits = F.transform(F.split(F.substring(line, 1, 68), ""), lambda ch: F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).when(ch == "-", 1).otherwise(0))
        return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == F.substring(line, 69, 1).try_cast("int")

    return F.coalesce((F.length(l1) >= 69) & (F.length(l2) >= 69) & l1.startswith("1 ") & l2.startswith("2 ") & check(l1) & check(l2), F.lit(False))


def positions(elements: DataFrame, times: DataFrame, observer: Observer = OBSERVER) -> DataFrame:
    """(name, k, t, lat, lon, alt_m, frame columns) per element set and time; null where the
    propagation fails. ``times`` is the small grid (k, t), broadcast to the element sets."""
    good = elements.where(valid_elements(F.col("l1"), F.col("l2")))
    raw = good.join(F.broadcast(times)).mapInArrow(_propagated, "name string, k long, t double, x double, y double, z double")
    geo = raw.withColumn("g", astro.teme_to_geodetic(F.col("x"), F.col("y"), F.col("z"), F.col("t"))).select("name", "k", "t", "g.*")
    return geo.withColumn("f", observer_frame("lat", "lon", "alt_m", observer)).select("name", "k", "t", "lat", "lon", "alt_m", "f.*")


def time_grid(elements: DataFrame, start: float, hours: float, step: float = 30.0) -> DataFrame:
    step = step if step > 0 else 30.0
    n = max(1, int(np.ceil(max(hours, 0.0) * 3600 / step)))
    return elements.sparkSession.range(n + 1).select(F.col("id").alias("k"), (F.lit(float(start)) + F.col("id") * float(step)).alias("t"))


def predict_passes(elements: DataFrame, start: float, hours: float = 24.0, step: float = 30.0, observer: Observer = OBSERVER) -> DataFrame:
    """(name, rise, culminate, set, max_el, az_culminate, visible) of each stay above the horizon.

    Rise and set are interpolated between samples; a pass open at the end of the grid is cut
    there; a pass is visible if at any sample the satellite is sunlit and the observer's sky dark.
    """
    grid = time_grid(elements, start, hours, step)
    sun = grid.select("k", astro.sun_direction(F.col("t")).alias("sun")).withColumn("dark", astro.sun_elevation(observer.lat, observer.lon, F.col("sun")) < astro.DARK_SUN_DEG)
    at = positions(elements, grid, observer).join(F.broadcast(sun), "k")
    w, el = Window.partitionBy("name").orderBy("k"), F.col("elevation_deg")
    up = F.coalesce(el > 0, F.lit(False))
    rows = at.withColumns({"up": up, "p_el": F.lag("elevation_deg").over(w), "p_t": F.lag("t").over(w), "n_el": F.lead("elevation_deg").over(w), "n_t": F.lead("t").over(w), "run": F.sum((~up).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rise = F.when(F.col("p_el") <= 0, F.col("p_t") + step * -F.col("p_el") / (el - F.col("p_el"))).otherwise(F.col("t"))
    end = F.when(F.col("n_el").isNotNull(), F.col("t") + step * el / (el - F.col("n_el"))).otherwise(F.col("t"))
    seen = F.col("dark") & astro.sunlit(F.col("lat"), F.col("lon"), F.col("alt_m"), F.col("sun"))
    by = rows.where("up").withColumns({"rise": rise, "end": end, "seen": seen}).groupBy("name", "run")
    best = F.max(F.struct("elevation_deg", (-F.col("k")).alias("first"), "t", "azimuth_deg"))
    out = by.agg(F.min(F.struct("k", "rise")).alias("a"), F.max(F.struct("k", "end")).alias("z"), best.alias("c"), F.max("seen").alias("visible"))
    return out.select("name", F.col("a.rise").alias("rise"), F.col("c.t").alias("culminate"), F.col("z.end").alias("set"), F.col("c.elevation_deg").alias("max_el"), F.col("c.azimuth_deg").alias("az_culminate"), "visible")


def upcoming(passes: DataFrame, now: float, n: int = 10) -> DataFrame:
    return passes.where(F.col("visible") & (F.col("set") > now) & (F.col("max_el") >= 10)).orderBy("rise", "name").limit(n)


def alerts(passes: DataFrame, now: float, ahead: float = 300.0) -> DataFrame:
    return passes.where((F.col("rise") > now) & (F.col("rise") - now <= ahead)).dropDuplicates(["name", "rise"])


def above_horizon(at: DataFrame, n: int = 80, observer: Observer = OBSERVER) -> DataFrame:
    """The n highest satellites of ``positions`` at one time, and whether each can be seen: it is
    sunlit and the observer's sky dark."""
    sun = at.withColumn("_sun", astro.sun_direction(F.col("t")))
    dark = astro.sun_elevation(observer.lat, observer.lon, F.col("_sun")) < astro.DARK_SUN_DEG
    seen = sun.withColumn("visible_now", dark & astro.sunlit(F.col("lat"), F.col("lon"), F.col("alt_m"), F.col("_sun"))).drop("_sun")
    return seen.where("elevation_deg > 0").orderBy(F.desc("elevation_deg"), "name").limit(n)
