"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences.

Documents are read as overlapping passages, weighted by TF-IDF over the benchmark's vocabulary. A
basis comes from a distributed randomised SVD of passages, the items among them: tasks sketch
their passages against a random matrix, once more against the orthonormal range found, and the
small rest is solved on the driver. Passages and items are compared by cosine in that basis. What
the basis leaves out of a passage and of an item bounds how far that cosine may be too low, so the
threshold of a pair is one that no pair with the common subsequence sought can miss, whatever the
rank. Candidates are confirmed by longest common subsequence of words and by a check that the
item's answer terms are there.

Benchmarks of any size are searched in rounds of a bounded number of characters, each one reading
of the documents; within a round, items are searched in parts, each with a basis of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, sampled

#: Words of a passage and of a step for items of up to PASSAGE - STEP words, which stand whole in
#: one; both double for longer items until that holds for them too.
PASSAGE, STEP = 128, 64
#: Items and words of items that a part holds, characters of items in a round (what is broadcast
#: follows from them: a basis has at most PART_WORDS x (PART_ITEMS + SPARE) numbers), cells of a
#: block of passages x terms.
PART_ITEMS, PART_WORDS, ROUND_CHARS, CELLS = 224, 8_192, 300_000, 2_000_000
#: Dimensions of the basis beyond the number of items, and documents that it is fitted on.
SPARE, FIT_DOCS = 32, 2_000
#: Weight of the items in the fit against the passages: so high that the basis holds nearly all of
#: each item, and few pairs become candidates for what it leaves out.
ITEM_SHARE = 1000.0
_EDGE = b".,;:!?\"'()[]{}<>|*#%&$"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _EDGE).split()


def lcs(item: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Longest common subsequence with an item of n words given as bit masks by word."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := item.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


@dataclass
class Part:
    """Items searched together by passages of ``factor`` times the least size.

    ids, words (as terms of the part) and answer terms per item; the vocabulary's id, weight and
    row in ``basis`` of each term; latent vectors, residual norms and least products of the items.
    """

    factor: int
    ids: list[int]
    words: list[list[int]]
    answers: list[set[int]]
    terms: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    rest: np.ndarray
    least: np.ndarray


def _doc_counts(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        counts = np.zeros(len(terms) + 1, np.int64)
        for b in batches:
            counts[-1] += b.num_rows
            for t in b.column("text"):
                for w in terms.keys() & set(tokens(t.as_py())):
                    counts[terms[w]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["term", "n"])

    return run


def factor_of(n: int) -> int:
    """By how much passages grow so that an item of n words stands whole in one: a power of two."""
    factor = 1
    while n > (PASSAGE - STEP) * factor:
        factor *= 2
    return factor


def split(items: list[tuple[int, list[int], set[int]]]) -> list[list[tuple[int, list[int], set[int]]]]:
    """Items in parts of one factor and a bounded size."""
    out: list[list] = []
    factor, held = 0, 0
    for item in sorted(items, key=lambda x: (factor_of(len(x[1])), x[0])):
        if not out or factor != factor_of(len(item[1])) or len(out[-1]) == PART_ITEMS or held + len(item[1]) > PART_WORDS:
            out.append([])
            factor, held = factor_of(len(item[1])), 0
        out[-1].append(item)
        held += len(item[1])
    return out


def passages_of(ids: np.ndarray, local: np.ndarray, factor: int) -> list[tuple[int, np.ndarray]]:
    """(start, terms of the part) of a text's passages that have any."""
    own, size, step, out = local[ids], PASSAGE * factor, STEP * factor, []
    for start in range(0, max(1, len(own) - size + step), step):
        some = own[start : start + size]
        some = some[some >= 0]
        if len(some):
            out.append((start, some))
    return out


def weighted(rows: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """TF-IDF rows of passages; a term counts once."""
    x = np.zeros((len(rows), len(weight)), np.float32)
    if rows:
        at = np.concatenate(rows)
        x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), at] = weight[at]
    return x


def _local(terms: np.ndarray, size: int) -> np.ndarray:
    """Place of each vocabulary id among ``terms``, -1 if none; the last is for unknown words."""
    out = np.full(size + 1, -1, np.int32)
    out[terms] = np.arange(len(terms))
    return out


def _ids(vocabulary: dict[bytes, int], text: str | None) -> np.ndarray:
    words = tokens(text)
    return np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))


def _sketch(shared):
    """Per part and term the sum over passages p of p * (p . probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, jobs = shared.value
        sums = [np.zeros(probe.shape, np.float32) for _, _, _, probe in jobs]
        lookups, held = [_local(terms, len(vocabulary)) for terms, _, _, _ in jobs], [[] for _ in jobs]

        def add(k: int) -> None:
            x, probe = weighted(held[k], jobs[k][1]), jobs[k][3]
            sums[k] += x.T @ (x @ probe)
            held[k] = []

        for b in batches:
            for t in b.column("text"):
                ids = _ids(vocabulary, t.as_py())
                for k, (_, weight, factor, _) in enumerate(jobs):
                    held[k] += [p for _, p in passages_of(ids, lookups[k], factor)]
                    if len(held[k]) * len(weight) >= CELLS:
                        add(k)
        for k in range(len(jobs)):
            add(k)
        for k, total in enumerate(sums):
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array([total[i].tobytes() for i in at], pa.binary())], ["part", "term", "v"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_buffer(), np.float32) for v in t.column("v")], axis=0, dtype=np.float64).astype(np.float32)
    return pa.table({"part": t.column("part")[:1], "term": t.column("term")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def _range(sample: DataFrame, vocabulary: dict[bytes, int], jobs: list[tuple]) -> list[np.ndarray]:
    """Of each job (terms, weight, factor, probe) the products of all passages with its probe."""
    shared = sample.sparkSession.sparkContext.broadcast((vocabulary, jobs))
    rows = sample.mapInArrow(_sketch(shared), "part int, term int, v binary").groupBy("part", "term").applyInArrow(_added, "part int, term int, v binary").collect()
    shared.destroy()
    out = [np.zeros(probe.shape) for _, _, _, probe in jobs]
    for r in rows:
        out[r.part][r.term] = np.frombuffer(r.v, np.float32)
    return out


def fitted(sample: DataFrame, vocabulary: dict[bytes, int], weight: np.ndarray, groups: list[list], needed: float) -> list[Part]:
    """Parts with their bases: a randomised SVD with one power step over passages and items."""
    jobs, vectors = [], []
    for k, items in enumerate(groups):
        terms = np.array(sorted({w for _, words, _ in items for w in words}))
        place = {w: i for i, w in enumerate(terms.tolist())}
        x = np.zeros((len(items), len(terms)))
        for i, (_, words, _) in enumerate(items):
            np.add.at(x[i], [place[w] for w in words], 1)
        own = weight[terms]
        vectors.append((place, x * own))
        rank = min(len(terms), len(items) + SPARE)
        jobs.append((terms, own.astype(np.float32), factor_of(len(items[0][1])), np.random.default_rng(k).standard_normal((len(terms), min(len(terms), rank + 8))).astype(np.float32)))

    def power(probes: list[np.ndarray]) -> list[np.ndarray]:
        """Products with the covariance of passages, the items weighing ITEM_SHARE times as much."""
        seen = _range(sample, vocabulary, [(*job[:3], q.astype(np.float32)) for job, q in zip(jobs, probes, strict=True)])
        out = []
        for y, q, (_, x) in zip(seen, probes, vectors, strict=True):
            own = x.T @ (x @ q)
            size = np.linalg.norm(y)
            out.append(y + own * (ITEM_SHARE * size / max(np.linalg.norm(own), 1e-9) if size else 1.0))
        return out

    first = [np.linalg.qr(y)[0] for y in power([job[3].astype(float) for job in jobs])]
    parts = []
    for q, y, (terms, own, factor, _), (place, x), items in zip(first, power(first), jobs, vectors, groups, strict=True):
        small = q.T @ y
        value, turn = np.linalg.eigh((small + small.T) / 2)
        basis = (q @ turn[:, np.argsort(-value)][:, : len(items) + SPARE]).astype(np.float32)
        latent = x @ basis
        rest = np.sqrt(np.maximum((x**2).sum(1) - (latent**2).sum(1), 0))
        words = [[place[w] for w in ws] for _, ws, _ in items]
        least = [np.sort(own[ws].astype(float) ** 2)[: int(np.ceil(needed * len(ws) - 1e-9))].sum() for ws in words]
        parts.append(Part(factor, [i for i, _, _ in items], words, [{place[w] for w in a} for _, _, a in items], terms, own, basis, latent.astype(np.float32), rest.astype(np.float32), np.array(least, np.float32)))
    return parts


class Searcher:
    """Finds the items of a part in passages given as terms of it."""

    def __init__(self, part: Part, sure: float, share: float, answer: float):
        self.part, self.sure, self.share, self.answer = part, sure, share, answer
        self.masks = [masks(words) for words in part.words]
        self.answers = [np.array(sorted(a)) for a in part.answers]
        self.square = part.weight**2
        self.norm = np.sqrt((part.latent.astype(float) ** 2).sum(1) + part.rest.astype(float) ** 2)
        self.block = max(1, CELLS // len(part.terms))

    def candidates(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (passage, item) whose cosine reaches the item's least product, allowing for what
        the basis leaves out of both and for rounding."""
        size = (x * x).sum(1)
        z = x @ self.part.basis
        rest = np.sqrt(np.maximum(size - (z * z).sum(1), 0))
        norms = np.sqrt(size)[:, None] * self.norm[None, :]
        cosine = (z @ self.part.latent.T + rest[:, None] * self.part.rest[None, :]) / norms
        return zip(*(k.tolist() for k in np.nonzero(cosine >= self.part.least[None, :] / norms - 1e-4)), strict=True)

    def find(self, passages: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, float]]:
        """(doc, start, item id, overlap) of the passages (doc, start, terms) that hold an item."""
        for i in range(0, len(passages), self.block):
            some = passages[i : i + self.block]
            x = weighted([own for _, _, own in some], self.part.weight)
            for r, k in self.candidates(x):
                doc, start, own = some[r]
                n = len(self.part.words[k])
                known = (x[r, self.answers[k]] > 0).sum() >= self.answer * len(self.answers[k])
                needed = min(self.share, self.sure) if known else self.sure
                shared = (x[r, self.part.words[k]] > 0).sum()  # bounds the common subsequence
                if shared / n >= needed - 1e-6 and (ratio := lcs(self.masks[k], n, own.tolist()) / n) >= needed:
                    yield doc, start, self.part.ids[k], ratio


def _search(shared, sure: float, share: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, parts = shared.value
        searchers = [(Searcher(p, sure, share, answer), _local(p.terms, len(vocabulary)), p.factor) for p in parts]
        for b in batches:
            out: list[tuple] = []
            for i in range(0, b.num_rows, 200):
                texts = [(d, _ids(vocabulary, t.as_py())) for d, t in zip(b.column("doc_id").slice(i, 200).to_pylist(), b.column("text").slice(i, 200), strict=True)]
                for s, local, factor in searchers:
                    out.extend(s.find([(d, start, own) for d, ids in texts for start, own in passages_of(ids, local, factor)]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], ["doc_id", "start", "item_id", "overlap"])

    return run


_FOUND = "doc_id long, start int, item_id long, overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, sure: float = 0.8, share: float = 0.6, answer: float = 0.6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, item_id, overlap): passages of documents that hold a benchmark item.

    overlap is the common subsequence over the item's length: enough alone from ``sure`` on,
    from ``share`` on if the item's answer terms (its five rarest) are there too. Every passage
    is searched for every item; passages are at least twice as long as the item. The basis is
    fitted on about FIT_DOCS documents; document counts are over all. Null and empty texts and
    items, and rows with a null id, match nothing. Repeated rows match alike.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "leaks")
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where("item_id is not null and text is not null").dropDuplicates()
    rounds = -(-(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // ROUND_CHARS)
    out, sample = spark.createDataFrame([], _FOUND), None
    for k in range(rounds):
        some = bench if rounds == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        items = sorted((r.item_id, w) for r in some.collect() if (w := tokens(r.text)))  # about ROUND_CHARS characters
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        if not items:
            continue
        shared = spark.sparkContext.broadcast(vocabulary)
        counts = dict(raw.mapInArrow(_doc_counts(shared), "term int, n long").groupBy("term").agg(F.sum("n")).collect())
        shared.destroy()
        n = counts.get(len(vocabulary), 0)
        df = np.array([counts.get(i, 0) for i in range(len(vocabulary))])
        if sample is None:
            sample = shelf.put(raw.where(sampled("doc_id", FIT_DOCS, n)).select("text"))
        # Terms that no document has can't tell a leak, so they come last.
        rarest = lambda words: set(sorted(set(words), key=lambda w: (df[w] == 0, df[w], w))[:5])  # noqa: B023, E731
        named = [(i, [vocabulary[w] for w in words]) for i, words in items]
        parts = fitted(sample, vocabulary, 1 + np.log((1 + n) / (1 + df)), split([(i, words, rarest(words)) for i, words in named]), min(sure, share))
        out = out.union(raw.mapInArrow(_search(spark.sparkContext.broadcast((vocabulary, parts)), sure, share, answer), _FOUND))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document that holds a benchmark item: doc_id, n_items, best_item, overlap."""
    best = F.max(F.struct("overlap", (-F.col("item_id")).alias("k"))).alias("m")
    found = find_leaks(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), best).select("doc_id", "n_items", (-F.col("m.k")).alias("best_item"), F.col("m.overlap").alias("overlap"))
