"""From observations to the daily brief as one set of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GAP_SECONDS, OBSERVER, WEIGHTS, AnomalyWeights, Observer
from ..operators import anomaly, brief, embedding, graph, similarity, tracks
from ..sources import scenario


@dataclass
class Report:
    points: DataFrame
    tracks: DataFrame
    scored: DataFrame
    similar: DataFrame
    nodes: DataFrame
    edges: DataFrame
    brief: DataFrame

    def close(self) -> None:
        """Gives back the memory of the tables that others are made from."""
        self.tracks.unpersist()
        self.scored.unpersist()


def report(obs: DataFrame, windows: DataFrame, observer: Observer = OBSERVER, weights: AnomalyWeights = WEIGHTS, gap_seconds: int = GAP_SECONDS) -> Report:
    points = tracks.stitch(obs, gap_seconds)
    rolled = anomaly.sequenced(embedding.track_vectors(tracks.roll_up(points))).persist()  # one row per track, read by all that follows
    new = similarity.novelty(rolled)
    scored = anomaly.score(rolled, anomaly.prior_baseline(rolled), new, weights).persist()
    pairs = similarity.similar_pairs(similarity.nearest(rolled, rolled, 1, key="track_id"), "track_id", "neighbour")
    odd = scored.where(F.col("band_rank") >= brief.UNUSUAL_RANK)
    return Report(points, rolled, scored, pairs, graph.nodes(rolled, windows, odd, observer), graph.edges(rolled, windows, pairs, odd, observer), brief.daily_brief(rolled, scored, windows, observer))


def synthetic_day(spark: SparkSession, seed: int = 42) -> Report:
    return report(scenario.observed(scenario.traffic(spark, seed)), scenario.weather(spark, seed))
