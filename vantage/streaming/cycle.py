"""The poll cycle as one foreachBatch function: project, novelty, score, behaviours, conflicts, record.

Stores are parquet folders with one subfolder per epoch, so a repeated epoch replaces its own
rows; a batch is judged against stores as they were before it, then appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OBSERVER, OVERHEAD_ELEVATION_DEG, OVERHEAD_RANGE_M, WEIGHTS, Observer
from ..functions.geo import observer_frame
from ..functions.labels import display_name, emergency
from ..operators import anomaly, behavior, conflict, embedding, similarity, tracks
from ..sources import sinks
from .live import MAX_POINTS, STALE_S, rolling_batch

#: Seconds of points that stay for replay, between prunings, and between saved snapshots of an
#: entity; snapshots that the novelty memory holds; fixes that a snapshot needs.
WINDOW_S, PRUNE_EVERY_S, PERSIST_MIN_S, MEMORY, MIN_FIXES = 3_600, 300, 20.0, 5_000, 4
POINT = "entity_id string, obs_id long, ts timestamp, t double, now double, lat double, lon double, alt_m double, speed_mps double, track_deg double, vertical_rate_mps double, signal_dbfs double, rssi double, callsign string, label string, category string, emergency string, range_m double, azimuth_deg double, elevation_deg double"
SNAPSHOT = "entity_id string, at double, embedding array<float>"


class SkyCycle:
    """``SkyCycle(folder)`` takes batches of ``feeds.poll_states`` rows and keeps the tables
    points, memory, scores, behaviors and conflicts there."""

    def __init__(self, folder: str, observer: Observer = OBSERVER):
        self.folder, self.observer, self.pruned = folder.rstrip("/"), observer, None

    def _files(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, spark: SparkSession, name: str, schema: str, before: int | None = None) -> DataFrame:
        """A table as it is, or as it was before an epoch."""
        p, files = self._files(spark, f"{self.folder}/{name}")
        if not files.exists(p):
            return spark.createDataFrame([], f"{schema}, epoch int")
        out = spark.read.schema(f"{schema}, epoch int").parquet(f"{self.folder}/{name}")
        return out if before is None else out.where(F.col("epoch") < before)

    def _put(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def project(self, batch: DataFrame) -> DataFrame:
        """Poll rows with the observer's frame, as points."""
        b = batch.withColumn("f", observer_frame("lat", "lon", "alt_m", self.observer)).select("*", "f.*")
        c = F.col
        return b.select(
            "entity_id", F.xxhash64("entity_id", "t").alias("obs_id"), F.timestamp_micros((c("t") * 1e6).cast("long")).alias("ts"), c("t").cast("double").alias("t"), c("now").cast("double").alias("now"), "lat", "lon", "alt_m", c("gs_ms").alias("speed_mps"), "track_deg",
            c("vrate_ms").alias("vertical_rate_mps"), F.coalesce("rssi", F.lit(-20.0)).alias("signal_dbfs"), "rssi", "callsign", display_name(c("callsign"), c("entity_id")).alias("label"), "category", emergency(c("emergency"), c("squawk")).alias("emergency"),
            "range_m", "azimuth_deg", "elevation_deg",
        )

    def picture(self, points: DataFrame, now: float) -> DataFrame:
        """Kept points of the entities seen lately, the newest ``MAX_POINTS`` of each."""
        recent = points.where(F.col("t") <= now).join(points.groupBy("entity_id").agg(F.max("t").alias("_z")).where(F.col("_z") >= now - STALE_S).select("entity_id"), "entity_id", "left_semi")
        return tracks.trail(recent.join(rolling_batch(recent), ["entity_id", "t", "obs_id"], "left_semi"), F.timestamp_micros(F.lit(int(now * 1e6))), MAX_POINTS)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("now")).first()[0]
        if now is None:
            return
        moment = F.timestamp_micros(F.lit(int(now * 1e6)))
        new = self.project(batch).dropDuplicates(["entity_id", "t"])
        held = self.picture(self.read(spark, "points", POINT, epoch).drop("epoch").unionByName(new), now).persist()
        memory = self.read(spark, "memory", SNAPSHOT, epoch)
        flown = tracks.derived_motion(held.withColumns({"segment": F.lit(0), "track_id": F.col("entity_id")}))
        shape = flown.select(*[c for c in flown.columns if c not in ("speed_mps", "track_deg", "vertical_rate_mps", "derived_speed_mps", "derived_track_deg", "derived_vrate_mps")], F.col("derived_speed_mps").alias("speed_mps"), F.col("derived_track_deg").alias("track_deg"), F.col("derived_vrate_mps").alias("vertical_rate_mps"))
        snapshots = embedding.track_vectors(tracks.roll_up(shape)).where(F.col("n_points") >= MIN_FIXES).select("entity_id", F.lit(float(now)).alias("at"), "embedding", "n_points").persist()
        novelty = similarity.live_novelty(snapshots, memory)
        live = anomaly.live_summary(held)
        fresh = live.select("track_id").join(novelty.withColumnRenamed("entity_id", "track_id"), "track_id", "left").select("track_id", F.coalesce("novelty", F.lit(0.0)).alias("novelty"), F.lit(None).cast("string").alias("baseline_id"))
        scored = anomaly.score(live, anomaly.leave_one_out(live), fresh, WEIGHTS)
        over = (F.col("min_range_m") < OVERHEAD_RANGE_M) & (F.col("max_elevation_deg") > OVERHEAD_ELEVATION_DEG)
        self._put(scored.select("entity_id", "score", "band", "reasons", over.alias("overhead")), "scores", epoch)
        self._put(behavior.behaviors(held, moment), "behaviors", epoch)
        self._put(conflict.conflicts(conflict.latest_states(held.where("speed_mps is not null and track_deg is not null"), moment)), "conflicts", epoch)
        told = held.join(new.select("entity_id", "t"), ["entity_id", "t"], "left_semi").select(*[c.split()[0] for c in POINT.split(", ")])
        self._put(sinks.new_points(told, self.read(spark, "points", POINT, epoch)), "points", epoch)
        self._put(sinks.cadence(snapshots.drop("n_points"), memory.select("entity_id", "at"), PERSIST_MIN_S), "memory", epoch)
        held.unpersist()
        snapshots.unpersist()
        if self.pruned is None or now - self.pruned > PRUNE_EVERY_S:
            self.prune(spark, now)
            self.pruned = now

    def prune(self, spark: SparkSession, now: float) -> None:
        """Deletes epochs whose points all left the replay window, and snapshots beyond the cap."""
        last = self.read(spark, "points", POINT).groupBy("epoch").agg(F.max("t").alias("t")).where(F.col("t") < now - WINDOW_S)
        sizes = self.read(spark, "memory", SNAPSHOT).groupBy("epoch").count().orderBy(F.desc("epoch"))
        gone = [("points", r.epoch) for r in last.collect()]  # one row per epoch
        total = 0
        for r in sizes.collect():
            if total >= MEMORY:
                gone.append(("memory", r.epoch))
            total += r["count"]
        for name, epoch in gone:
            p, files = self._files(spark, f"{self.folder}/{name}/epoch={epoch}")
            files.delete(p, True)

    def replay(self, spark: SparkSession) -> DataFrame:
        """Recorded tracks of the replay window."""
        points = self.read(spark, "points", POINT)
        return sinks.replay_tracks(points.join(F.broadcast(points.agg((F.max("t") - WINDOW_S).alias("_from"))), F.col("t") >= F.col("_from")))  # one row
