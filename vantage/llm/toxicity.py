"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features are densities of a fixed and a learnt lexicon, how near second-person words stand to
hits, capitals, punctuation and obfuscation. The learnt lexicon is counted in Spark; trees and
calibration are fitted on the driver from at most about ``sample`` labelled rows (a documented
bound); every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, isotonic
from .common import Shelf, sampled

#: Fixed word list: common insults in the four languages of the corpus.
LEXICON = """
arschloch asqueroso basura bastard clown connard crétin débile dégoûtant disgusting dumb dumm
ekelhaft escoria estúpido filth fool freak garbage hate idiot idiota idiote imbécil imbécile
inútil jerk kill loser minable moron nul nutzlos ordure pathetic patético payaso pendejo racaille
salaud scum shit stupid stupide trash trottel ugly vermin versager wertlos worthless abschaum
""".split()
#: Words that address a reader.
SECOND_PERSON = {w.encode() for w in "you your yours you're u ur du dich dir dein deine tu te toi ton ta tes vous votre usted tú ti tus".split()}
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!+", "oieastasit")
_ODD = re.compile(rb"[a-z][0-9@$!*+]+[a-z]|[0-9@$!]+[a-z]{2}|(?:[a-z][.\-_*]){3}")
_EDGE = b".,;:!?\"'()[]{}<>|*#%&$"
FEATURES = ["hits", "density", "learnt_hits", "learnt_weight", "learnt_density", "near_you", "you_rate", "capitals", "punctuation", "shouting", "obfuscation", "hidden_hits", "length"]


def forms(word: bytes) -> list[bytes]:
    """What a word is looked up by: itself and, if longer, its first five bytes as a stem."""
    return [word, b"^" + word[:5]] if len(word) > 5 else [word]


def features(text: str | None, lexicon: set[bytes], learnt: dict[bytes, float]) -> list[float]:
    """The feature vector of a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [w.strip(_EDGE) for w in raw.lower().split()]
    n, size = max(1, len(words)), max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    mine = [i for i, w in enumerate(words) if w in learnt or (b"^" + w[:5] in learnt and len(w) > 5)] if learnt else []
    own = [max(learnt.get(f, 0.0) for f in forms(words[i])) for i in mine]
    at = sorted({*hits, *mine})
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, j = 0, 0
    for i in at:
        while j < len(you) and you[j] < i - 5:
            j += 1
        near += j < len(you) and you[j] <= i + 5
    odd = hidden = 0
    for m in _ODD.finditer(raw.lower()):
        s, e = raw.rfind(b" ", 0, m.start()) + 1, raw.find(b" ", m.end())
        token = raw[max(s, m.start() - 40) : e if 0 <= e < m.end() + 40 else m.end() + 40].lower().strip(_EDGE)
        odd += 1
        plain = re.sub(rb"[^a-z]", b"", token.decode("utf-8", "replace").translate(LEET).encode())
        hidden += plain in lexicon or plain in learnt
    caps = len(re.findall(rb"[A-Z]", raw))
    marks = raw.count(b"!") + raw.count(b"?") + raw.count(b"*") + raw.count(b"#")
    return [np.log1p(len(hits)), len(hits) / n, np.log1p(len(own)), float(sum(own)), len(own) / n, np.log1p(near), len(you) / n, caps / size, marks / size, raw.count(b"!") / n, odd / n, np.log1p(hidden), np.log1p(len(words))]


class ToxicityModel:
    def __init__(self, learnt: dict[bytes, float], trees: BoostedTrees, knots: tuple[np.ndarray, np.ndarray]):
        self.learnt, self.trees, self.knots = learnt, trees, knots
        self.lexicon = {w.encode() for w in LEXICON}

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon, self.learnt) for t in texts]).reshape(-1, len(FEATURES))
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, *self.knots)
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-raw)), 0, 1)  # order holds inside a step


def held_out(doc_id: str = "doc_id"):
    """True for documents whose labels must not be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            words, label = [], []
            for t, y in zip(b.column("text").slice(i, 500), b.column("toxic").slice(i, 500), strict=True):
                own = sorted({w.strip(_EDGE) for w in (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()} - {b""})
                own = sorted({f for w in own for f in forms(w)})
                words += own
                label += [y.as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(label, pa.int32())], ["word", "toxic"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 30_000, lexicon_size: int = 400, least_docs: int = 4, least_z: float = 6.0, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """Fits a model from at most about ``sample`` labelled rows outside the held-out third.

    By crc32 of the id, one half of them gives the learnt lexicon: words and stems whose toxic
    share stands ``least_z`` standard deviations above the mean; a quarter grows the trees, a
    quarter calibrates. Null labels are left out. With one class only the score is constant.
    """
    shelf = Shelf(docs.sparkSession, "toxic")
    ids = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)").where(~held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    n = ids.count()
    rows = ids.where(sampled("_id", sample, n))
    code = F.crc32(F.col("_id").cast("string").cast("binary"))
    part = F.when(code % 3 == 0, 0).when(F.floor(code / 3) % 2 == 0, 1).otherwise(2)
    chosen = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(F.broadcast(rows), "_id")
    chosen = shelf.put(chosen.withColumn("part", part))
    half = chosen.where("part = 0")
    totals = dict(half.groupBy("toxic").count().collect())
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    base = pos / max(1, pos + neg)
    counts = half.select("text", "toxic").mapInArrow(_tokens, "word binary, toxic int")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("k")).where(F.col("t") >= least_docs)
    z = (F.col("t") - F.col("k") * base) / F.sqrt(F.col("k") * max(1e-9, base * (1 - base)))
    odds = F.log((F.col("t") + 0.5) / (pos + 1.0)) - F.log((F.col("k") - F.col("t") + 0.5) / (neg + 1.0))
    top = counts.select("word", odds.alias("w"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("w") > 1.5)).orderBy(F.desc("z"), "word").limit(lexicon_size).collect() if pos and neg else []
    learnt = {bytes(r.word): float(r.w) for r in top}
    lexicon = {w.encode() for w in LEXICON}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), lexicon, learnt) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "toxic", "part")), pa.array(x, pa.list_(pa.float64()))], ["_id", "toxic", "part", "x"])

    got = sorted(chosen.where("part > 0").mapInArrow(vectors, "_id long, toxic int, part int, x array<double>").collect(), key=lambda r: (r._id, r.x))
    shelf.drop(chosen)
    x, y = np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in got], float)
    fit = np.array([r.part == 1 for r in got], bool)
    trees = BoostedTrees().fit(x[fit], y[fit])
    return ToxicityModel(learnt, trees, isotonic(trees.raw(x[~fit]), y[~fit]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null texts count as empty.

    Only the text enters a score. Repeated rows and empty tables need nothing special.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([shared.value.score([t.as_py() for t in b.column(1).slice(i, 200)]) for i in range(0, b.num_rows, 200)]) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
