"""Settings of an observer and of the anomaly score."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Observer:
    name: str = "oakville_node"
    lat: float = 43.4675
    lon: float = -79.6877
    alt_m: float = 100.0


@dataclass(frozen=True)
class AnomalyWeights:
    route: float = 0.30
    altitude: float = 0.20
    hour: float = 0.15
    signal: float = 0.15
    cross_sensor: float = 0.10
    novelty: float = 0.10
    alert_threshold: float = 0.76
    min_history: int = 5


OBSERVER = Observer()
WEIGHTS = AnomalyWeights()
#: Overhead rule and session gap.
OVERHEAD_RANGE_M, OVERHEAD_ELEVATION_DEG, GAP_SECONDS = 10_000.0, 5.0, 60
ENTITY_TYPES = ("aircraft", "weather_cell", "rf_event", "audio_event", "camera_event", "satellite")
