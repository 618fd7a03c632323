"""The live layer: keyed rolling state, expiry, windows and stores under Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import M_PER_DEG_LON

#: A point counts if it is this much later than the last kept one; points kept; seconds to expiry.
MIN_STEP_S, MAX_POINTS, STALE_S, SMOOTHING_S, RESET_S = 0.5, 720, 120, 0.35, 20.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "entity_id string, t double, lat double, lon double, alt_m double, shown_lat double, shown_lon double, shown_alt_m double, callsign string, emergency string, n_points int"


def greedy_keep(times: list[float], step: float = MIN_STEP_S) -> list[bool]:
    """Which times are kept if each must be later than the last kept one by more than ``step``."""
    out, last = [], None
    for t in times:
        out.append(last is None or t > last + step)
        last = t if out[-1] else last
    return out


def dead_reckoned(last: tuple, velocity: tuple | None, now: float) -> tuple:
    """(lat, lon, alt_m) at ``now`` by the last point (t, lat, lon, alt_m) and (speed, track,
    climb); the point itself where the velocity isn't known, or it isn't between 0 and 20 s old."""
    t, lat, lon, alt = last
    dt = now - t
    if velocity is None or not 0 < dt <= RESET_S:
        return lat, lon, alt
    d, b = velocity[0] * dt, math.radians(velocity[1])
    return lat + d * math.cos(b) / M_PER_DEG_LON, lon + d * math.sin(b) / (M_PER_DEG_LON * math.cos(math.radians(lat))), alt + (velocity[2] or 0.0) * dt


def displayed(shown: tuple | None, last: tuple, velocity: tuple | None, now: float) -> tuple | None:
    """(t, lat, lon, alt_m) to show at ``now``: eased from what was shown towards the
    dead-reckoned place; nothing once the last point is over 20 s old."""
    if now - last[0] > RESET_S:
        return None
    target = dead_reckoned(last, velocity, now)
    if shown is None or now <= shown[0]:
        return now, *target
    a = 1 - math.exp(-(now - shown[0]) / SMOOTHING_S)
    return now, *(x + (y - x) * a for x, y in zip(shown[1:], target, strict=True))


def _value(row, name: str) -> float | None:
    x = getattr(row, name, None)
    return None if x is None or x != x else float(x)


class RollingTracks(StatefulProcessor):
    """Per entity: the last kept point, sticky metadata and velocity, the displayed position and a
    bounded trail. Rows may tell the time of their poll (now) and gs_ms, track_deg, vrate_ms."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "point array<double>, shown array<double>, velocity array<double>, callsign string, emergency string")
        self.trail = handle.getListState("trail", "t double, lat double, lon double, alt_m double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        point, shown, velocity, call, flag = self.last.get() if self.last.exists() else (None,) * 5
        point, shown, velocity = (tuple(x) if x else None for x in (point, shown, velocity))
        kept = list(self.trail.get()) if self.trail.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("t").itertuples():
            call = (r.callsign or "").strip() or call
            flag = r.emergency if isinstance(r.emergency, str) and r.emergency not in ("", "none") else None
            if _value(r, "gs_ms") is not None and _value(r, "track_deg") is not None:
                velocity = (_value(r, "gs_ms"), _value(r, "track_deg"), _value(r, "vrate_ms") or 0.0)
            if point is not None and not r.t > point[0] + MIN_STEP_S:
                continue
            point = (float(r.t), float(r.lat), float(r.lon), float(r.alt_m))
            now = _value(r, "now")
            shown = displayed(shown, point, velocity, point[0] if now is None else now)
            kept = [*kept, point][-MAX_POINTS:]
            out.append((key[0], *point, *(shown[1:] if shown else (None,) * 3), call, flag, len(kept)))
        if point is not None:
            self.last.update((list(point), list(shown) if shown else None, list(velocity) if velocity else None, call, flag))
            self.trail.put([tuple(x) for x in kept])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((point[0] + STALE_S) * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.last.clear()
        self.trail.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def rolling_tracks(states: DataFrame) -> DataFrame:
    """Kept points of a stream of poll states with ``ts``; needs the RocksDB state store."""
    marked = states.withWatermark("ts", f"{STALE_S} seconds")
    return marked.groupBy("entity_id").transformWithStateInPandas(RollingTracks(), OUT, "Append", "EventTime")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, sorted by entity and time, that are later than the last kept one."""
    who, last = None, None
    for b in batches:
        keep = []
        for entity, t in zip(b.column("entity_id").to_pylist(), b.column("t").to_pylist(), strict=True):
            good = entity != who or last is None or (t is not None and t > last + MIN_STEP_S)
            who, last = entity, t if good else last
            keep.append(good)
        yield b.filter(pa.array(keep, pa.bool_()))


def rolling_batch(states: DataFrame) -> DataFrame:
    """(entity_id, t, obs_id) that the same rule keeps of a whole table. A lag would compare with
    rows that were not kept, so each task walks its entities in order and holds one time."""
    rows = states.select("entity_id", F.col("t").cast("double").alias("t"), F.col("obs_id").cast("long").alias("obs_id"))
    return rows.repartition(F.xxhash64("entity_id")).sortWithinPartitions("entity_id", "t", "obs_id").mapInArrow(_kept, rows.schema)


def hourly(states: DataFrame) -> DataFrame:
    """Points per entity and tumbling hour of a stream or table."""
    return states.withWatermark("ts", f"{STALE_S} seconds").groupBy(F.window("ts", "1 hour"), "entity_id").agg(F.count("*").alias("n"))


def sessions(states: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """Reception sessions: rows merge while whole elapsed seconds stay within the gap."""
    w = F.session_window("ts", f"{gap_seconds}.999999 seconds")
    return states.withWatermark("ts", f"{STALE_S} seconds").groupBy(w, "entity_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_points"))


def once(alerts: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    return alerts.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def poll_cycle(*steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs steps in their order over one persisted batch: score
    before append, so that a batch is never compared with itself."""

    def run(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            for step in steps:
                step(held, epoch)
        finally:
            held.unpersist()

    return run


def append_to(path: str, partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """A step that appends a batch as parquet; a repeated epoch overwrites its own folder."""

    def run(batch: DataFrame, epoch: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/epoch={epoch}")

    return run
