"""Repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

Only lines that stand twice somewhere enter; stretches of them are segments, whose suffixes get
ranks: each round sorts (rank, ranks 1, 2 and 3 prefixes on) by range, which is two doublings for
one sort, ties broken by place, so that a group of equal suffixes of any size spreads over tasks;
a group that crosses tasks is joined up from one summary row per task. Rounds end when no group
splits any more.

Prefix lengths shared with the preceding suffix (LCP) are compared only where they don't follow
from the line before (the permuted-array property), and only as many lines as needed travel.
A suffix lies in nested LCP intervals; the longest one that also holds an earlier place gives its
run: so many lines stand in full at the interval's first place. One pass over each sorted task
finds them with a stack of levels, and a staircase per task border joins the tasks up. Runs that
no longer run of the line before contains are maximal, and what they cover goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, fresh

#: Lines of two suffixes that are compared first; the rest follows only where all of them agree.
SLICE = 32
_NEVER = 2**31 - 1
_KEYS = ["r", "r1", "r2", "r3"]
_PREV = ["doc", "th", "seg", "pos", "h"]
_ROW = ["doc", "th", "seg", "pos", "h", "at", "lone"]
_PLACE = ["doc", "th", "pos"]


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers one sorted task: g is where a row's group of equal keys starts, p_* the row before."""
    n, g, last, key = 0, 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _KEYS])
        new = np.r_[key is None or tuple(keys[:, 0]) != key, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
        loc = np.arange(n, n + b.num_rows)
        at = np.where(new, loc, -1)
        at[0] = at[0] if new[0] else g
        at = np.maximum.accumulate(at)
        prev = [pa.concat_arrays([pa.array([last and last[c]], b.column(c).type), b.column(c).slice(0, b.num_rows - 1)]) for c in _PREV]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*_ROW, *_KEYS, "pid"]), pa.array(at, pa.int64()), pa.array(loc, pa.int64()), *prev], [*_ROW, *_KEYS, "pid", "g", "loc", *[f"p_{c}" for c in _PREV]])
        n, g, key, last = n + b.num_rows, int(at[-1]), tuple(keys[:, -1]), {c: b.column(c)[-1].as_py() for c in _PREV}


_ROW_TYPE = "doc long, th long, seg int, pos int, h long, at int, lone boolean"
_RANKED = f"{_ROW_TYPE}, r long, r1 long, r2 long, r3 long, pid int, g long, loc long, p_doc long, p_th long, p_seg int, p_pos int, p_h long"


def _ranked(rows: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame, int]:
    """Sorted rows with rank, their raw table, and the number of groups of equal keys."""
    spark = rows.sparkSession
    keys = [*_KEYS, "doc", "th", "pos"]
    raw = shelf.put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()).mapInArrow(_rank, _RANKED))
    end = F.struct(*_KEYS, "doc", "th", "pos", "seg", "h")
    ends = raw.groupBy("pid").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), F.max("g").alias("g"), F.sum((F.col("g") == F.col("loc")).cast("long")).alias("groups"))
    carried, before, start, groups = [], None, 0, 0
    for e in sorted(ends.collect(), key=lambda x: x.pid):  # one row per task
        goes_on = before is not None and all(before[c] == e.lo[c] for c in _KEYS)
        first = start if goes_on else e.pid << 40
        carried.append((e.pid, first, *(before[c] if before is not None else None for c in _PREV)))
        start = first if e.g == 0 else (e.pid << 40) + e.g
        before, groups = e.hi, groups + e.groups - goes_on
    fix = F.broadcast(spark.createDataFrame(carried, "pid int, first long, b_doc long, b_th long, b_seg int, b_pos int, b_h long"))
    rank = F.when(F.col("g") == 0, F.col("first")).otherwise(F.shiftleft(F.col("pid").cast("long"), 40) + F.col("g"))
    prev = [F.when(F.col("loc") == 0, F.col(f"b_{c}")).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in _PREV]
    return raw.join(fix, "pid").select(*_ROW, rank.alias("r"), "pid", "loc", *prev), raw, groups


Stair = list[tuple[int, tuple[int, int, int]]]


def above(lcp: list[int], order: list[int]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """For each suffix of a sorted list the longest prefix shared with one above it that stands
    earlier (0 if none), the earliest such one, and the staircase seen from below the list.

    lcp[i] is shared by i - 1 and i; order is where suffixes stand. The stack has a level and the
    earliest suffix reachable at it; higher levels have later ones, others can't be an answer.
    """
    stack: list[tuple[int, int]] = []
    length, source = [0] * len(order), [-1] * len(order)
    for i in range(len(order) + 1):
        if i:
            c, low = lcp[i] if i < len(order) else _NEVER, order[i - 1]
            while stack and stack[-1][0] >= c:
                low = min(low, stack.pop()[1])
            while stack and stack[-1][1] > low:
                stack.pop()
            if c > 0:
                stack.append((c, low))
            else:
                stack.clear()
        if i < len(order):
            for c, low in reversed(stack):
                if low < order[i]:
                    length[i], source[i] = c, low
                    break
    return length, source, stack


_SOLVED = "doc long, th long, seg int, pos int, at int, lone boolean, n int, s_doc long, s_th long, s_pos int, up int, down int, pid int, note string"


def _solve(t: pa.Table) -> pa.Table:
    """The runs of one sorted task by its own suffixes, and a note for its neighbours."""
    t = t.sort_by("loc")
    place = [t.column(c).to_numpy() for c in _PLACE]
    by = np.lexsort(place[::-1])
    order = np.empty(len(by), np.int64)
    order[by] = np.arange(len(by))
    lcp = t.column("lcp").to_numpy()
    named = lambda k: tuple(int(x[by[k]]) for x in place)
    n1, s1, below = above(lcp.tolist(), order.tolist())
    n2, s2, over = above([_NEVER, *lcp[:0:-1].tolist()], order[::-1].tolist())
    n1, s1, n2, s2 = np.array(n1), np.array(s1), np.array(n2)[::-1], np.array(s2)[::-1]
    n = np.maximum(n1, n2)
    s = np.where(n1 > n2, s1, np.where(n2 > n1, s2, np.minimum(s1, s2)))
    src = by[np.maximum(s, 0)]
    right = np.r_[np.minimum.accumulate(lcp[:0:-1])[::-1], _NEVER] if len(lcp) > 1 else np.array([_NEVER])
    pid = t.column("pid")[0].as_py()
    note = json.dumps({"first": int(lcp[0]), "low": int(lcp[1:].min(initial=_NEVER)), "below": [(c, named(k)) for c, k in below], "over": [(c, named(k)) for c, k in over]})
    none = n == 0
    columns = [
        *(t.column(c).combine_chunks() for c in ("doc", "th", "seg", "pos", "at", "lone")), pa.array(n, pa.int32()), *(pa.array(x[src], k, mask=none) for x, k in zip(place, (pa.int64(), pa.int64(), pa.int32()), strict=True)),
        pa.array(np.minimum.accumulate(lcp), pa.int32()), pa.array(right, pa.int32()), pa.array(np.full(len(n), pid), pa.int32()), pa.nulls(len(n), pa.string()),
    ]
    rows = pa.table(columns, [c.split()[0] for c in _SOLVED.split(", ")])
    last = pa.table({f.name: pa.array([{"pid": pid, "note": note}.get(f.name)], f.type) for f in rows.schema})
    return pa.concat_tables([rows, last])


def _clip(stair: Stair, level: int) -> Stair:
    """A staircase seen from beyond a place where only ``level`` lines are shared."""
    return _merge([(min(c, level), p) for c, p in stair])


def _merge(*stairs: Stair) -> Stair:
    out: Stair = []
    for c, p in sorted((x for s in stairs for x in s), key=lambda x: (-x[0], x[1])):
        if c > 0 and (not out or p < out[-1][1]):
            out.append((c, p))
    return out


def _neighbours(notes: dict[int, dict]) -> list[tuple]:
    """(pid, staircase from the tasks before, staircase from the tasks after) of each task."""
    read = lambda s: [(c, tuple(p)) for c, p in s]
    order, left, right = sorted(notes), {}, {}
    came: Stair = []
    for pid in order:
        x = notes[pid]
        left[pid] = came = _clip(came, x["first"])
        came = _merge(read(x["below"]), _clip(came, x["low"]))
    came = []
    for pid in reversed(order):
        x = notes[pid]
        right[pid] = came
        came = _clip(_merge(read(x["over"]), _clip(came, x["low"])), x["first"])
    flat = lambda s: [(c, *p) for c, p in s]
    return [(pid, flat(left[pid]), flat(right[pid])) for pid in order]


def _line_rows(docs: DataFrame, text: str, doc_id: str, lone_words: int) -> DataFrame:
    """(doc, th, pos, h, at, lone) of all lines with a word; th tells texts of one id apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
    told = F.transform(F.split(t, "\n"), lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("at"), words(x).alias("w")))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(t).alias("th"), F.posexplode(F.filter(told, lambda s: s["w"] > 0)).alias("pos", "x"))
    return rows.select("doc", "th", "pos", "x.h", "x.at", (F.col("x.w") >= lone_words).alias("lone"))


def _shared(x: Column, y: Column) -> Column:
    """How many elements two arrays share from their start."""
    differ = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, F.size(x)).otherwise(differ - 1).cast("int")


def _lcp(ranked: DataFrame, segments: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc, th, seg, pos, at, lone, pid, loc, lcp): lines shared with the preceding suffix."""
    by, own = Window.partitionBy("doc", "th", "seg").orderBy("pos"), ["doc", "th", "seg", "pos"]
    back = {c: F.lag(c).over(by) for c in ("p_doc", "p_th", "p_seg", "p_pos", "p_h", "h")}
    follows = (back["p_doc"] == F.col("p_doc")) & (back["p_th"] == F.col("p_th")) & (back["p_seg"] == F.col("p_seg")) & (back["p_pos"] + 1 == F.col("p_pos")) & (back["p_h"] == back["h"])
    known = shelf.put(ranked.withColumn("follows", F.coalesce(follows, F.lit(False))).drop("r"))
    heads = known.where("not follows and h = p_h").select(*own, "p_doc", "p_th", "p_seg", "p_pos", F.lit(0).alias("n"))
    x_side, y_side = segments.select("doc", "th", "seg", F.col("lines").alias("_x")), segments.select(*[F.col(c).alias(f"p_{c}") for c in ("doc", "th", "seg")], F.col("lines").alias("_y"))
    found = None
    for size in (SLICE, _NEVER):
        part = lambda c, p, s: F.slice(c, F.col(p) - F.col(s) + F.col("n") + 1, F.lit(size))  # noqa: B023, E731
        x = heads.join(x_side, ["doc", "th", "seg"]).select(*heads.columns, part("_x", "pos", "seg").alias("x"))
        both = x.join(y_side, ["p_doc", "p_th", "p_seg"]).select(*heads.columns, "x", part("_y", "p_pos", "p_seg").alias("y"))
        got = shelf.put(both.select(*heads.columns[:-1], (F.col("n") + _shared(F.col("x"), F.col("y"))).alias("n")))
        done = got.select(*own, "n") if size == _NEVER else got.where(F.col("n") < size).select(*own, "n")
        heads = got.where(F.col("n") >= size)
        found = done if found is None else found.union(done)
    full = known.join(found, own, "left")
    head = F.last(F.when(~F.col("follows"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("pos").alias("at"))), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    lcp = F.greatest(F.col("head.n") - (F.col("pos") - F.col("head.at")), F.lit(0)).cast("int")
    return full.withColumn("head", head).select(*own, "at", "lone", "pid", "loc", lcp.alias("lcp"))


def repeated_runs(docs: DataFrame, *, lone_words: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line that stands twice somewhere: doc, th, seg, pos, at, lone, n, s_doc and s_pos.

    pos counts the lines with a word of a document, at counts all; n is the most lines from pos on that stand in
    the same order at an earlier place, s_doc and s_pos the first such place (n = 0: none). Places
    are ordered by doc_id, hash of the text (th) and pos.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "lines")
    lines = shelf.put(_line_rows(docs, text, doc_id, lone_words))
    twice = shelf.put(lines.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))  # written, so that the join can split a common line
    met = lines.join(twice, "h", "left_semi").repartition("doc", "th").groupBy(*_PLACE).agg(F.min("h").alias("h"), F.min("at").alias("at"), F.first("lone").alias("lone"))
    seg = F.min("pos").over(Window.partitionBy("doc", "th", "island")).cast("int")
    islands = met.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("doc", "th").orderBy("pos")))
    start = shelf.put(islands.withColumn("seg", seg).select(*_ROW))
    shelf.drop(lines)
    longest = start.agg(F.max(F.col("pos") - F.col("seg") + 1)).first()[0]
    if longest is None:
        return spark.createDataFrame([], "doc long, th long, seg int, pos int, at int, lone boolean, n int, s_doc long, s_pos int")
    by, step, old, before = Window.partitionBy("doc", "th", "seg").orderBy("pos"), 1, None, 0
    rows = start.withColumn("r", F.col("h"))
    while True:
        leads = {f"r{j}": F.coalesce(F.lead("r", j * step).over(by), F.lit(-(2**63))) for j in (1, 2, 3)}
        ranked, raw, groups = _ranked(rows.select(*_ROW, "r").withColumns(leads), shelf)
        if old is not None:
            shelf.drop(old)
        if groups == before or 4 * step >= longest:
            break
        rows, step, old, before = ranked, 4 * step, raw, groups
    segments = shelf.put(start.groupBy("doc", "th", "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("lines")))
    order = _lcp(ranked, segments, shelf)
    solved = shelf.put(order.groupBy("pid").applyInArrow(_solve, _SOLVED))
    shelf.drop(raw, start, segments)
    notes = {r.pid: json.loads(r.note) for r in solved.where("note is not null").select("pid", "note").collect()}  # one row per task
    stair = "array<struct<c:int,doc:long,th:long,pos:int>>"
    beside = F.broadcast(spark.createDataFrame(_neighbours(notes), f"pid int, before {stair}, after {stair}"))
    turned = lambda n, d, t, p: F.struct(n.alias("n"), F.bitwise_not(d).alias("d"), F.bitwise_not(t).alias("t"), F.bitwise_not(p).alias("p"))
    mine = F.struct(*_PLACE)

    def seen(stairs: str, level: str) -> Column:
        earlier = F.filter(stairs, lambda e: F.struct(e["doc"].alias("doc"), e["th"].alias("th"), e["pos"].alias("pos")) < mine)
        return F.array_max(F.transform(earlier, lambda e: turned(F.least(e["c"], F.col(level)), e["doc"], e["th"], e["pos"])))

    own = F.when(F.col("n") > 0, turned(F.col("n"), F.col("s_doc"), F.col("s_th"), F.col("s_pos")))
    best = F.array_max(F.array_compact(F.array(own, seen("before", "up"), seen("after", "down"))))
    out = solved.where("note is null").join(beside, "pid").withColumn("b", best)
    some = F.coalesce(F.col("b.n"), F.lit(0)) > 0
    return out.select("doc", "th", "seg", "pos", "at", "lone", F.when(some, F.col("b.n")).otherwise(0).alias("n"), F.when(some, F.bitwise_not("b.d")).alias("s_doc"), F.when(some, F.bitwise_not("b.p")).alias("s_pos"))


def _covered(runs: DataFrame, min_lines: int) -> DataFrame:
    """Adds ``gone`` (the line is covered by a run that counts) and ``maximal`` (its own run
    counts and isn't part of the run of the line before)."""
    by = Window.partitionBy("doc", "th", "seg").orderBy("pos")
    reach = F.max(F.when(F.col("n") >= min_lines, F.col("pos") + F.col("n"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    alone = (F.col("n") > 0) & F.col("lone")
    within = F.coalesce(F.lag("n").over(by) > F.col("n"), F.lit(False))
    return runs.withColumns({"gone": F.coalesce(reach > F.col("pos"), F.lit(False)) | alone, "maximal": ((F.col("n") >= min_lines) & ~within) | ((F.col("n") < min_lines) & alone)})


def maximal_runs(docs: DataFrame, *, min_lines: int = 2, lone_words: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_lines, first_doc, first_start): maximal line runs that stand earlier too.

    start and first_start count lines with a word. See ``line_dedup`` for which runs count.
    """
    runs = _covered(repeated_runs(docs, lone_words=lone_words, text=text, doc_id=doc_id), min_lines).where("maximal")
    return runs.select(F.col("doc").alias("doc_id"), F.col("pos").alias("start"), F.col("n").alias("n_lines"), F.col("s_doc").alias("first_doc"), F.col("s_pos").alias("first_start"))


def line_dedup(docs: DataFrame, *, min_lines: int = 2, lone_words: int = 8, text: str = "text", doc_id: str = "doc_id", marks: str = "lines_gone") -> DataFrame:
    """The input's columns with later copies of repeated line runs cut from ``text``, and
    ``marks``, the places (from 0) of the lines that went (null if none).

    A line goes if a run of lines covers it of which an equal run starts at an earlier place, in
    (doc_id, place) order, whether in another document or the same one. A run counts if it has
    ``min_lines`` lines, or is one line of ``lone_words`` words or more; lines without a word are
    passed over. Rows that repeat an id and its text are treated alike; other texts of one id
    count as documents of their own, in the order of a hash. Rows with a null id, null or empty
    texts lose nothing; empty tables give empty results. An input column named like ``marks``
    gives way to it.
    """
    names = [c for c in docs.columns if c != marks]
    key, hashed, cut, of = (fresh(docs, c) for c in ("_doc", "_th", "_lines", "_hash"))
    runs = _covered(repeated_runs(docs, lone_words=lone_words, text=text, doc_id=doc_id), min_lines).where("gone")
    gone = runs.groupBy(F.col("doc").alias("_g_doc"), F.col("th").alias("_g_th")).agg(F.array_sort(F.collect_list("at")).alias("_g"))
    gone = gone.toDF(key, hashed, marks)
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # Split before the join, so that lines are looked up and not split again for each.
    parts = docs.select(*[F.col(c) for c in names if c != text], own.alias(of), F.split(F.col(text), "\n").alias(cut))
    out = parts.join(gone, (parts[doc_id] == gone[key]) & (parts[of] == gone[hashed]), "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(marks)), lambda i: F.get(cut, i))
    whole = F.array_join(F.when(F.col(marks).isNull(), F.col(cut)).otherwise(left), "\n")
    return out.withColumn(text, whole).select(*names, marks)
