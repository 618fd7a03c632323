"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target ratio f is taken floor(f) times, and once more with
probability frac(f). The extra copies are drawn by the cube method: inclusion probabilities move
through the null space of the balance constraints (token and document totals) until all but two
per block are 0 or 1, long documents first; what is left over and the shortest documents meet
again in larger blocks. In the last block of a source the two documents left over and the HELD
shortest ones land together on the subset with the nearest totals. Blocks bound the work of a task, so a source with a third of all rows is many
blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, words_of

#: Documents that one task balances at once; sources whose totals may come to the driver.
BLOCK, MAX_SOURCES = 4_000, 1_000_000
#: Short documents that take no part in the flight: of a block, which go on to the next level,
#: and of a source's last block, which land.
PASSED, HELD = 2, 10
_EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Each source's target: ``share`` of all sizes by weight, at most ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, total = set(order), share * sum(sizes.values())
    while left:
        rest, sum_w = total - sum(out.values()), sum(weight[s] for s in order if s in left)
        over = [s for s in order if s in left and rest * weight[s] / sum_w > most * sizes[s]]
        for s in over or list(left):
            out[s] = float(most * sizes[s]) if over else rest * weight[s] / sum_w
            left.discard(s)
    return out


def fly(x: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities along the null space of (x, 1) until two at most are fractional."""
    pi = pi.copy()
    live: list[int] = []
    todo = iter(np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS)))
    draws, used = rng.random(len(pi) + 3), 0
    while True:
        while len(live) < 3 and (i := next(todo, None)) is not None:
            live.append(int(i))
        if len(live) < 3:
            return pi
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up, down = np.inf, np.inf
        for i, d in zip(live, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pi[i]) / d), min(down, pi[i] / d)
            elif d < 0:
                up, down = min(up, pi[i] / -d), min(down, (1 - pi[i]) / -d)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for i, d in zip(live, u, strict=True):
            v = pi[i] + step * d
            pi[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
        live = [i for i in live if 0 < pi[i] < 1]


def land(x: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Rounds the last fractional documents to the nearest total of x, then of documents, then to
    the likeliest subset."""
    out, open_ = pi.copy(), np.flatnonzero((pi > 0) & (pi < 1))
    if len(open_):
        picks = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
        p = pi[open_]
        odds = (picks * np.log(p) + (1 - picks) * np.log(1 - p)).sum(1)
        order = np.lexsort((-odds, np.abs(picks.sum(1) - p.sum()).round(9), np.abs(picks @ x[open_] - x[open_] @ p).round(6)))
        out[open_] = picks[order[0]]
    return out


def _balance(seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("h", "ascending"), ("doc_id", "ascending")])
        x, pi = t.column("size").to_numpy().astype(float), t.column("pi").to_numpy().copy()
        src, block, blocks = (t.column(c)[0].as_py() for c in ("src", "block", "blocks"))
        flown = max(0, len(x) - (HELD if blocks == 1 else PASSED))
        pi[:flown] = fly(x[:flown], pi[:flown], np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}:{src}:{block}:{blocks}".encode())))
        if blocks == 1:
            pi = land(x, pi)
        return t.set_column(t.column_names.index("pi"), "pi", pa.array(pi, pa.float64())).select(["doc_id", "src", "size", "h", "pi"])

    return run


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row.

    Sources in code point order, null last, have ``weights`` in turn. Sizes are words; documents
    of size 0 (null and empty texts) are taken 0 words. Reruns agree: draws depend on seed,
    source and block only. Repeated rows are drawn one by one. Empty tables give empty results.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "mix")
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"))
    sized = shelf.put(raw)
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = targets({r.source: r.size for r in totals}, weights, share, most)
    rows = []
    for i, r in enumerate(sorted(totals, key=lambda r: (r.source is None, r.source))):
        ratio = want[r.source] / r.size if r.size else 0.0
        whole = int(ratio + _EPS)
        rows.append((r.source, i, r.size, want[r.source], whole, min(max(ratio - whole, 0.0), 1.0), max(1, -(-r.n // BLOCK))))
    plan = spark.createDataFrame(rows, "p_source string, src int, source_size long, target double, whole int, pi double, blocks long")
    if len(rows) <= 100_000:
        plan = F.broadcast(plan)
    all_ = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left")
    code = F.xxhash64("doc_id", "size")
    open_ = all_.where("size > 0").select("doc_id", "src", "size", code.alias("h"), "pi", "blocks")
    done, level = [], {i: r[6] for i, r in enumerate(rows)}
    while True:
        at = F.pmod(F.xxhash64("h", "doc_id", F.lit(len(done))), "blocks")
        moved = shelf.put(open_.withColumn("block", at).groupBy("src", "block").applyInArrow(_balance(seed), "doc_id long, src int, size long, h long, pi double"))
        done.append(moved.where("pi = 0 or pi = 1"))
        if all(n == 1 for n in level.values()):
            break
        counts = {r.src: r["count"] for r in moved.where("pi > 0 and pi < 1").groupBy("src").count().collect()}
        level = {i: max(1, -(-counts.get(i, 0) // BLOCK)) for i in level}
        if not counts:
            break
        blocks = F.broadcast(spark.createDataFrame(list(level.items()), "src int, blocks long")) if len(level) <= 100_000 else spark.createDataFrame(list(level.items()), "src int, blocks long")
        open_ = moved.where("pi > 0 and pi < 1").join(blocks, "src")
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.union(d)
    facts = plan.select("src", F.col("p_source").alias("source"), "source_size", "target", "whole")
    taken = drawn.join(facts, "src").select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pi").cast("int")).alias("copies"))
    none = all_.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies"))
    return taken.unionByName(none).withColumn("taken", F.col("size") * F.col("copies"))
