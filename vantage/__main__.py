"""``python -m vantage [--emit-json PATH]``: report on the synthetic day, or export it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.brief import brief_text
from .operators.graph import explain
from .plans.day import synthetic_day
from .sources.scenario import DAY_START
from .sources.sinks import export_text, write_export


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--emit-json", metavar="PATH")
    path = args.parse_args().emit_json
    spark = SparkSession.builder.appName("vantage").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    day = synthetic_day(spark)
    tracks, scored = day.tracks.cache(), day.scored.cache()
    if path:
        write_export(path, export_text(day.points, tracks, scored, DAY_START.isoformat()))
        return
    tracks.select("track_id", "callsign", "n_points", "min_range_m", "max_elevation_deg", "overhead").orderBy("started").show(50, False)
    print(f"graph: {day.nodes.count()} nodes, {day.edges.count()} edges")
    day.similar.limit(5).show(truncate=False)
    scored.select("track_id", "score", "band", "reasons").orderBy("seq").show(50, False)
    worst = scored.where("band_rank >= 2").orderBy("score", ascending=False).limit(1).select("track_id")
    for r in explain(day.nodes, day.edges, worst).toLocalIterator():
        print(r.track_id, *r.evidence, sep="\n  ")
    print(brief_text(day.brief).first().text)


if __name__ == "__main__":
    main()
