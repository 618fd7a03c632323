"""Substring deduplication: rolling hashes of every 13-word window, met in hash buckets.

Each task hashes all windows of a chunk of documents (Rabin-Karp polynomials over word hashes),
keeps one row per distinct window and chunk (the smallest document that has it) and notes the
others, which are already known to be later copies. Distinct windows go, eight bytes each, to
buckets named by a second polynomial; a bucket finds the smallest document of each window. A
window that a third of all documents share is thus one row per chunk. The number of buckets
follows the input, so that a bucket always fits a task. Later copies go on packed by groups of
documents, one row per bucket and group, and meet the texts of their group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import mix

#: Windows that a task hashes at once, and characters of text that a bucket stands for.
CHUNK, CHARS_PER_BUCKET = 2_000_000, 12_000_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(words: list[bytes], size: int, base: np.uint64 = _B1) -> np.ndarray:
    """Polynomial hashes of all ``size``-word windows, finalized."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return _rolled(h, n, size, base)


def _rolled(h: np.ndarray, n: int, size: int, base: np.uint64) -> np.ndarray:
    out = h[:n].copy()
    for j in range(1, size):
        out *= base
        out += h[j : j + n]
    return mix(out)


def groups_of(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document id; the same as crc32 of its decimal text in SQL."""
    return np.fromiter((zlib.crc32(b"%d" % d) % groups for d in docs), np.int64, len(docs))


def _scan(size: int, buckets: int):
    names = ["bucket", "doc_id", "hashes", "docs", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def chunk(ids: list[int], hs: list[np.ndarray], ks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids), kind="stable")
        doc = np.repeat(np.array(ids, np.int64)[order], [len(hs[i]) for i in order])
        h, k = (np.concatenate([x[i] for i in order]) for x in (hs, ks))
        by = np.argsort(h, kind="stable")
        h, k, doc = h[by], k[by], doc[by]
        new = np.r_[True, h[1:] != h[:-1]]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = (doc != least) & np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        rows: list[tuple] = []
        lh, ld = h[later], doc[later]
        by = np.argsort(ld, kind="stable")
        lh, ld = lh[by], ld[by]
        cut = np.flatnonzero(np.r_[True, ld[1:] != ld[:-1]]) if len(ld) else np.empty(0, np.int64)
        for s, e in zip(cut, np.r_[cut[1:], len(ld)], strict=True) if len(ld) else ():
            rows.append((-1 - zlib.crc32(b"%d" % ld[s]) % buckets, int(ld[s]), lh[s:e].tobytes(), None, None))
        h, k, doc = h[new], k[new].astype(np.int64), doc[new]
        by = np.lexsort((doc, k))
        h, k, doc = h[by], k[by], doc[by]
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(k)], strict=True):
            d, c = np.unique(doc[s:e], return_counts=True)
            rows.append((int(k[s]), None, h[s:e].tobytes(), d.tobytes(), c.astype(np.uint32).tobytes()))
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 2000]], t) for j, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hs, ks, n = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = split_words(t.as_py())
                if i is None or len(words) < size:
                    continue
                w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                m = len(w) - size + 1
                ids.append(i)
                hs.append(_rolled(w, m, size, _B1))
                ks.append((_rolled(w, m, size, _B2) % np.uint64(buckets)).astype(np.uint32))
                n += m
                if n >= CHUNK:
                    yield from chunk(ids, hs, ks)
                    ids, hs, ks, n = [], [], [], 0
        if ids:
            yield from chunk(ids, hs, ks)

    return run


def _packed(doc: np.ndarray, h: np.ndarray, groups: int) -> pa.Table:
    """Pairs of document and hash, one row per group of documents."""
    by = np.argsort(doc, kind="stable")
    doc, h = doc[by], h[by]
    ids, inverse = np.unique(doc, return_inverse=True)
    g = groups_of(ids, groups)[inverse] if len(ids) else np.empty(0, np.int64)
    by = np.argsort(g, kind="stable")
    doc, h, g = doc[by], h[by], g[by]
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    runs = list(zip(cut, np.r_[cut[1:], len(g)], strict=True)) if len(g) else []
    return pa.table({"team": pa.array(g[cut], pa.int64()), "docs": pa.array([doc[s:e].tobytes() for s, e in runs], pa.binary()), "hashes": pa.array([h[s:e].tobytes() for s, e in runs], pa.binary())})


def _meet(groups: int):
    """Later copies of a bucket's windows; what a chunk knew already passes through."""
    read = lambda t, c, d: np.concatenate([np.empty(0, d), *(np.frombuffer(x.as_buffer(), d) for x in t.column(c))])

    def run(t: pa.Table) -> pa.Table:
        known = t.filter(pc.is_valid(t.column("doc_id")))
        if known.num_rows:
            n = [len(x.as_buffer()) // 8 for x in known.column("hashes")]
            return _packed(np.repeat(known.column("doc_id").to_numpy(), n), read(known, "hashes", np.uint64), groups)
        h, doc = read(t, "hashes", np.uint64), np.repeat(read(t, "docs", np.int64), read(t, "counts", np.uint32))
        by = np.lexsort((doc, h))
        h, doc = h[by], doc[by]
        new = np.r_[True, h[1:] != h[:-1]]
        later = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        return _packed(doc[later], h[later], groups)

    return run


def _cut(size: int):
    """Texts of a group of documents without the words that its later copies cover."""

    def run(hits: pa.Table, docs: pa.Table) -> pa.Table:
        at: dict[int, list[np.ndarray]] = {}
        for d, h in zip(hits.column("docs"), hits.column("hashes"), strict=True):
            d, h = np.frombuffer(d.as_buffer(), np.int64), np.frombuffer(h.as_buffer(), np.uint64)
            cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            for s, e in zip(cut, np.r_[cut[1:], len(d)], strict=True):
                at.setdefault(int(d[s]), []).append(h[s:e])
        n, gone, kept, runs = [], [], [], []
        for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text"), strict=True):
            words = split_words(t.as_py())
            n.append(len(words))
            spans: list[dict] = []
            if i in at and len(words) >= size:
                bad = np.unique(np.concatenate(at[i]))
                h = window_hashes(words, size)
                where = np.flatnonzero(bad[np.minimum(np.searchsorted(bad, h), len(bad) - 1)] == h)
                if len(where):
                    breaks = np.flatnonzero(np.diff(where) > size)
                    spans = [{"s": int(s), "e": int(e) + size} for s, e in zip(np.r_[where[0], where[breaks + 1]], np.r_[where[breaks], where[-1]], strict=True)]
            for s in reversed(spans):
                del words[s["s"] : s["e"]]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            runs.append(spans)
        spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "spans": pa.array(runs, spans_type), "kept": pa.array(kept, pa.string())})

    return run


def substring_dedup(docs: DataFrame, *, window: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges, maximal) and kept text of each row.

    A word goes if a window covers it whose words also start in a document with a smaller id.
    Null and empty texts and those with fewer words than a window lose nothing. Rows with a null
    id take no part and stay whole; rows that share an id don't remove each other's words. Empty
    tables give empty results.
    """
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chars = raw.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, chars // CHARS_PER_BUCKET)
    seen = raw.mapInArrow(_scan(window, buckets), "bucket long, doc_id long, hashes binary, docs binary, counts binary")
    later = seen.groupBy("bucket").applyInArrow(_meet(buckets), "team long, docs binary, hashes binary")
    code = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.crc32(F.col("text").cast("binary")), F.lit(0))
    teams = raw.withColumn("team", (code % buckets).cast("long"))
    return later.groupBy("team").cogroup(teams.groupBy("team")).applyInArrow(_cut(window), "doc_id long, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept string")
