"""Exports and stores."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OBSERVER, Observer


def export_rows(points: DataFrame, tracks: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per track as the export has it: rounded points and the score (null if unscored)."""
    c = F.col
    at = F.struct(F.unix_seconds("ts").alias("t"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt_m", 1).alias("alt_m"))
    line = points.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "obs_id", at.alias("p")))), lambda s: s["p"]).alias("points"))
    odd = scored.select("track_id", F.struct(F.round("score", 3).alias("score"), "band", "reasons").alias("anomaly"))
    return tracks.join(line, "track_id").join(odd, "track_id", "left").select("track_id", c("entity_id").alias("icao24"), "callsign", "overhead", "points", "anomaly", "started")


def export_text(points: DataFrame, tracks: DataFrame, scored: DataFrame, day_start: str, observer: Observer = OBSERVER) -> str:
    rows = export_rows(points, tracks, scored).orderBy("started", "track_id").drop("track_id", "started")
    found = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    home = {"name": observer.name, "lat": observer.lat, "lon": observer.lon, "alt_m": observer.alt_m}
    return json.dumps({"observer": home, "day_start": day_start, "tracks": found}, indent=2, ensure_ascii=False)


def write_export(path: str, text: str) -> None:
    """Plain JSON, or a script that sets SKY_DATA for paths that end in .js."""
    Path(path).write_text(f"const SKY_DATA = {text};\n" if path.endswith(".js") else text + "\n")


def newest(store: DataFrame, time: str, n: int = 5_000, tie: str = "entity_id") -> DataFrame:
    """The newest n rows of a store: a distributed top-n, not a global sort."""
    return store.orderBy(F.desc(time), tie).limit(n)


def new_points(points: DataFrame, recorded: DataFrame) -> DataFrame:
    """Projected points after each entity's last recorded time."""
    last = recorded.groupBy("entity_id").agg(F.max("t").alias("_last"))
    return points.where("range_m is not null").join(last, "entity_id", "left").where(F.col("_last").isNull() | (F.col("t") > F.col("_last"))).drop("_last")


def retained(store: DataFrame, now: Column, seconds: int = 3_600) -> DataFrame:
    return store.where(F.col("t") >= now - seconds)


def cadence(snapshots: DataFrame, saved: DataFrame | None = None, seconds: float = 20.0) -> DataFrame:
    """Snapshots of each entity that are ``seconds`` or more later than its last saved one, in
    order: one kept is the last saved one for those after it. ``saved`` are earlier snapshots."""
    rows = snapshots.withColumn("_old", F.lit(False))
    if saved is not None:
        rows = saved.groupBy("entity_id").agg(F.max("at").alias("at")).withColumn("_old", F.lit(True)).unionByName(rows, allowMissingColumns=True).select(*rows.columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last = None, None
        for b in batches:
            keep = []
            for entity, at, old in zip(*(b.column(c).to_pylist() for c in ("entity_id", "at", "_old")), strict=True):
                good = old or entity != who or at >= last + seconds
                who, last = entity, at if good else last
                keep.append(good and not old)
            yield b.drop_columns("_old").filter(pa.array(keep, pa.bool_()))

    # By a hash of the key: a shuffle by the key itself may be left out above a union of cached tables.
    return rows.repartition(F.xxhash64("entity_id")).sortWithinPartitions("entity_id", "at").mapInArrow(walk, snapshots.schema)


def replay_tracks(store: DataFrame) -> DataFrame:
    """Recorded points grouped by entity in time order, with the label written last, the category
    written first, and the times of the first and last point."""
    at = F.struct("t", "lat", "lon", "alt_m", "azimuth_deg", "elevation_deg", "range_m")
    order = F.struct("epoch", "t")
    out = store.groupBy("entity_id").agg(F.max_by("label", order).alias("label"), F.min_by("category", order).alias("category"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.sort_array(F.collect_list(at)).alias("points"))
    return out.select("entity_id", "label", "category", "t0", "t1", "points")
