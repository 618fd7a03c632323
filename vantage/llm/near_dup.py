"""MinHash near-duplicates: banded candidates, odd sketches, confirmation on full sets.

Texts with the same shingle set collapse to one representative first, so thousands of exact
copies are one node. Representatives that share a band are candidates. No bucket is expanded to
all pairs: members are tried against a few centres, components are formed, and only buckets
that still hold several components go on, minority members against the rest, so that no link
between different texts of a bucket is lost. Odd sketches (parity bitmaps of the MinHash
samples) discard most false candidates inside the join, and so does a parity bitmap of each whole
set: the bits in which two of those differ never outnumber the differing shingles, so it rejects
no link. What remains is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf
from .components import components

BANDS, ROWS, BITS, WHOLE_BITS = 32, 4, 512, 2048
SAMPLES = BANDS * ROWS
#: Ids of at most this many candidate documents are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _MUL)
    return (seeds[:SAMPLES] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), (seeds[SAMPLES:] >> np.uint64(32)).astype(np.uint32)[:, None]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``size``-word shingles, A-Z lower-cased.

    Texts with fewer words have their whole word sequence as one shingle; none without words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for j in range(min(size, len(h))):
        out = (out * _MUL) ^ h[j : j + n]
        out = mix(out)
    return np.unique(out)


def minhashes(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    x = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (a * x[i : i + 2048] + b).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of (position, sample) pairs as int64 words."""
    at = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def parity(items: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set as int64 words."""
    at = mix(items) % np.uint64(WHOLE_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=WHOLE_BITS) & 1).astype(np.uint8)).view(np.int64)


def odd_limit(similarity: float) -> int:
    """Most differing bits expected of two sketches with this similarity."""
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * 2 * SAMPLES * (1 - similarity) / BITS)))


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family()
        for b in batches:
            ns, sigs, bands, odds, whole = [], [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), size)
                ns.append(len(s))
                if not len(s):
                    sigs.append(None)
                    bands.append(None)
                    odds.append(None)
                    whole.append(None)
                    continue
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minhashes(s, family)
                key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL
                for r in range(ROWS):
                    key = mix(key ^ m[r::ROWS].astype(np.uint64)) * _MUL
                bands.append(key.view(np.int64))
                odds.append(odd_sketch(m))
                whole.append(parity(s))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, longs), pa.array(odds, longs), pa.array(whole, longs)], ["doc_id", "n", "sig", "bands", "odd", "whole"])

    return run


def _setter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())], ["id", "items"])

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def _differing(x: Column, y: Column, words: int) -> Column:
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, words)), F.bit_count(x[0].bitwiseXOR(y[0])))


def _alike(x: str, y: str, percent: int, floor: float) -> Column:
    """Whether facts x and y (structs of n, odd, whole) may be a link: sizes, then sketches."""
    col = lambda side, name: F.col(f"{side}.{name}")
    n1, n2 = col(x, "n"), col(y, "n")
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    odd = _differing(col(x, "odd"), col(y, "odd"), BITS // 64) <= odd_limit(floor)
    return sizes & odd & ((100 + percent) * _differing(col(x, "whole"), col(y, "whole"), WHOLE_BITS // 64) <= (100 - percent) * (n1 + n2))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, slack: float = 0.2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links have 100 * intersection >= percent * union of ``words``-word shingle sets. slack: how
    far below that an odd sketch may estimate a pair that is still confirmed (over four standard
    deviations). Null and empty texts are linked with nothing. Rows with a null id keep a null
    component and stay; rows that share an id belong together. Empty tables give empty results.
    """
    shelf = Shelf(docs.sparkSession, "near")
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = shelf.put(raw.mapInArrow(_sketcher(words), "doc_id long, n long, sig binary, bands array<long>, odd array<long>, whole array<long>"))
    reps = shelf.put(sketches.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")))
    own = sketches.where("doc_id is not null").join(reps, (sketches.sig == reps.sig) & (sketches.doc_id == reps.rep), "left_semi")
    nodes = shelf.put(own.select(F.col("doc_id").alias("rep"), F.struct("n", "odd", "whole").alias("f"), "bands"))
    floor = percent / 100 - slack
    buckets = nodes.select("rep", F.explode("bands").alias("band"))
    many = buckets.groupBy("band").agg(F.count("*").alias("k"), F.min("rep").alias("centre")).where("k > 1").drop("k")
    members = shelf.put(buckets.join(many, "band"))
    facts = nodes.select("rep", "f")

    def test(pairs: DataFrame, filtered: bool) -> DataFrame:
        """The links among distinct pairs (a, b)."""
        if not filtered:
            fa, fb = (facts.select(F.col("rep").alias(x), F.col("f").alias(f"f{x}")) for x in "ab")
            pairs = pairs.join(fa, "a").join(fb, "b").where(_alike("fa", "fb", percent, floor)).select("a", "b")
        pairs = shelf.put(pairs)
        ids = shelf.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = shelf.put(raw.join(ids, "doc_id", "left_semi").mapInArrow(_setter(words), "id long, items binary").dropDuplicates(["id"]))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        links = shelf.put(both.mapInArrow(_confirmer(percent), "a long, b long"))
        shelf.drop(sets)
        return links

    order = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    tried = shelf.put(members.where("rep <> centre").select(*order("centre", "rep")).distinct())
    links = test(tried, False)
    labels = components(links, shelf)
    for last in (False, True):
        known = members.join(labels, members.rep == labels.node, "left").select("band", "rep", F.coalesce("comp", "rep").alias("comp"))
        mixed = known.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
        open_ = shelf.put(known.join(mixed, "band"))
        if open_.isEmpty():
            break
        if not last:
            code = F.struct(F.xxhash64("rep", "band").alias("h"), "rep", "comp")
            ends = open_.groupBy("band").agg(F.array(F.min(code), F.max(code)).alias("ends"))
            pairs = open_.join(ends, "band").select("rep", "comp", F.explode("ends").alias("c")).where("comp <> c.comp").select(*order("rep", "c.rep")).distinct()
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
            tried = shelf.put(pairs)
            more = test(tried, False)
        else:
            shares = open_.groupBy("band", "comp").count()
            most = shares.groupBy("band").agg(F.max(F.struct("count", "comp")).alias("m")).select("band", F.col("m.comp").alias("most"))
            full = open_.join(facts, "rep").join(most, "band")
            few = full.where("comp <> most").select("band", F.col("rep").alias("p"), F.col("comp").alias("cp"), F.col("f").alias("fp"))
            rest = full.select("band", F.col("rep").alias("q"), F.col("comp").alias("cq"), F.col("f").alias("fq"), "most")
            cond = (few.band == rest.band) & ((rest.cq == rest.most) | (few.cp < rest.cq)) & (few.cp != rest.cq) & _alike("fp", "fq", percent, floor)
            more = test(few.join(rest, cond).select(*order("p", "q")).distinct(), True)
        links = shelf.put(links.union(more))
        labels = components(links, shelf)
    groups = reps.join(labels, reps.rep == labels.node, "left").select("sig", F.coalesce("comp", "rep").alias("comp"))
    out = sketches.select("doc_id", "n", "sig").join(groups, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
