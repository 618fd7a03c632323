"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Every document becomes a vector of transformed statistics. Minimum-covariance-determinant
estimates are found for all documents, for each language, and for each language and source, by
concentration steps: the documents nearest by Mahalanobis distance, ``share`` of a group, give the
next mean and covariance. Each group has three starting estimates; after two steps the one with
the least determinant goes on until no determinant falls any more, and is reweighted once.
Languages are then drawn towards all documents and sources towards their language, as if the
wider group had given ``prior`` documents more, so that small groups need no rule of their own. A
document whose squared distance passes a far chi-square quantile is rejected.

A step is one pass over the small statistics table: sums of vectors and of products by group and
bin of log distance. The subset is the lowest bins; the last one counts with the weight that
makes it exactly ``share``, so documents of one bin (a sixteenth of an octave) weigh alike. No
group is ever sorted or collected: one with a third of all rows is pre-aggregated like any other.
Estimates are written to the shared folder after each step; a lost executor repeats one at most.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, words_of

#: Features with the smallest standard deviation that counts (also the covariance ridge).
FEATURES = {"x_word_len": 0.05, "x_symbols": 0.05, "x_dup_lines": 0.15, "x_repeats": 0.15, "x_capitals": 0.05}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Groups up to which their estimates (some 600 bytes each, three at first) are broadcast.
BROADCAST_GROUPS = 20_000
_P, _XS = len(FEATURES), list(FEATURES)
_PAIRS = [(j, i) for j in range(_P) for i in range(j, _P)]


def chi2_cdf(x: float, p: int) -> float:
    if x <= 0:
        return 0.0
    k, f = (1, math.erf(math.sqrt(x / 2))) if p % 2 else (2, 1 - math.exp(-x / 2))
    while k < p:
        f -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return f


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the base statistics of each whole text, plus n_lines and n_capitals.

    Null and empty texts have zeros throughout. Repeated three-word windows are told apart by
    64-bit hashes within one text; only texts that have a repeat sort their windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*keep, t.alias("_t"), words_of(F.col(text)).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    h = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    b = a.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        lines.alias("_l"), h.alias("_h"),
    )
    c = b.select(
        *keep, *BASE[:3], "n_capitals", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"),
    )
    same = lambda j, k: F.coalesce(F.get("_s", j)["h"] == F.get("_s", k)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    d = c.select(*keep, *BASE[:3], "n_capitals", "n_lines", "n_dup_lines", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get("_s", k)["i"]))).alias("_p"))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_p") - 1), F.lit(3), lambda n, k: n + F.least(F.lit(3), F.get("_p", k) - F.get("_p", k - 1)))
    return d.select(*keep, *BASE[:4], F.coalesce(F.when(F.size("_p") > 1, covered), F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def _features() -> dict[str, Column]:
    chars, share = F.greatest(F.col("word_chars"), F.lit(1)), lambda n, of: F.sqrt(F.col(n) / F.greatest(F.col(of), F.lit(1)))
    return {
        "x_word_len": F.log(chars / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": share("n_symbols", "word_chars"),
        "x_dup_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
        "x_capitals": share("n_capitals", "word_chars"),
    }


_SUMS = ["n", *[f"s_{i}" for i in range(_P)], *[f"q_{j}_{i}" for j, i in _PAIRS]]
_MEANS = [f"m_{i}" for i in range(_P)]


def _sums(weight: str | None = None) -> list[Column]:
    """Sums of vectors and products by group, or weighted sums of such sums."""
    if weight is not None:
        return [F.expr(f"sum({weight} * {c}) as {c}") for c in _SUMS]
    return [F.expr("cast(count(*) as double) as n"), *[F.expr(f"sum({x}) as s_{i}") for i, x in enumerate(_XS)], *[F.expr(f"sum({_XS[j]} * {_XS[i]}) as q_{j}_{i}") for j, i in _PAIRS]]


def _moments(sums: DataFrame, keep: list[str], factor: float) -> DataFrame:
    """keep, n, means m_i and covariances c_j_i times ``factor``, with the ridge."""
    floor = list(FEATURES.values())
    cov = {(j, i): f"(q_{j}_{i} / n - s_{j} / n * (s_{i} / n))" for j, i in _PAIRS}
    own = [f"greatest({c}, 0d) * {factor!r}d + {floor[i] ** 2!r}d as c_{j}_{i}" if i == j else f"{c} * {factor!r}d as c_{j}_{i}" for (j, i), c in cov.items()]
    return sums.selectExpr(*keep, "n", *[f"s_{i} / n as m_{i}" for i in range(_P)], *own)


def _inverted(moments: DataFrame, keep: list[str]) -> DataFrame:
    """keep, means m_i, the inverse covariance v_j_i and the log determinant, by five sweeps."""
    out, at = moments.selectExpr(*keep, *_MEANS, *[f"c_{j}_{i} as v_{j}_{i}" for j, i in _PAIRS], "0d as logdet"), lambda i, j: f"v_{min(i, j)}_{max(i, j)}"
    for k in range(_P):
        pivot = f"greatest(v_{k}_{k}, 1e-9d)"

        def swept(j: int, i: int) -> str:
            if j == i == k:
                return f"-1 / {pivot}"  # noqa: B023
            return f"{at(j, i)} / {pivot}" if k in (i, j) else f"{at(j, i)} - {at(j, k)} * {at(k, i)} / {pivot}"  # noqa: B023

        out = out.selectExpr(*keep, *_MEANS, *[f"{swept(j, i)} as v_{j}_{i}" for j, i in _PAIRS], f"logdet + ln({pivot}) as logdet")
    return out.selectExpr(*keep, *_MEANS, *[f"-v_{j}_{i} as v_{j}_{i}" for j, i in _PAIRS], "logdet")


def _distance(df: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """Adds d2, the squared Mahalanobis distance; null where a group has no estimate."""
    off = [f"({x} - m_{i})" for i, x in enumerate(_XS)]
    d2 = " + ".join(f"{1 if i == j else 2} * v_{j}_{i} * {off[j]} * {off[i]}" for j, i in _PAIRS)
    return df.join(params, "gk", how).selectExpr(*df.columns, *[c for c in ("start", "logdet") if c in params.columns], f"{d2} as d2")


def _starts(fit: DataFrame, shelf: Shelf) -> tuple[DataFrame, bool]:
    """Three starting estimates per group: medians with quartile ranges, the same with the
    covariance of spatial signs, and the plain mean and covariance; whether groups are few."""
    plain = shelf.put(fit.groupBy("gk").agg(*_sums(), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"r_{i}") for i, x in enumerate(_XS)]))
    floor = list(FEATURES.values())
    spread = [f"sqrt(pow((r_{i}[2] - r_{i}[0]) / 1.349d, 2) + {floor[i] ** 2!r}d) as d_{i}" for i in range(_P)]
    robust = shelf.put(plain.selectExpr("gk", *[f"r_{i}[1] as m_{i}" for i in range(_P)], *spread))
    few = plain.count() <= BROADCAST_GROUPS
    scaled = fit.join(F.broadcast(robust) if few else robust, "gk").selectExpr("gk", *[f"({x} - m_{i}) / d_{i} as z_{i}" for i, x in enumerate(_XS)])
    size = f"greatest({' + '.join(f'z_{i} * z_{i}' for i in range(_P))}, 1e-12d)"
    signs = scaled.groupBy("gk").agg(*[F.expr(f"avg(z_{j} * z_{i} / {size}) as g_{j}_{i}") for j, i in _PAIRS]).join(robust, "gk")
    parts = [
        robust.selectExpr("gk", "0 as start", *_MEANS, *[f"{f'd_{i} * d_{i}' if i == j else '0d'} as c_{j}_{i}" for j, i in _PAIRS]),
        signs.selectExpr("gk", "1 as start", *_MEANS, *[f"d_{i} * d_{j} * ({_P} * g_{j}_{i} + {0.01 if i == j else 0.0}d) as c_{j}_{i}" for j, i in _PAIRS]),
        _moments(plain, ["gk"], 1.0).selectExpr("gk", "2 as start", *_MEANS, *[f"c_{j}_{i}" for j, i in _PAIRS]),
    ]
    return _inverted(parts[0].union(parts[1]).union(parts[2]), ["gk", "start"]), few


def _concentrated(fit: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One concentration step; ``was`` is the log determinant before it."""
    bin_ = F.floor(F.log2(F.least(F.greatest(F.col("d2"), F.lit(2.0**-10)), F.lit(2.0**20))) * 16).cast("int")
    bins = _distance(fit, params).groupBy("gk", "start", bin_.alias("bin")).agg(*_sums(), F.max("logdet").alias("was"))
    by = Window.partitionBy("gk", "start")
    before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.least(F.greatest((share * F.col("all") - F.col("before")) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    some = bins.withColumns({"all": F.sum("n").over(by), "before": before}).withColumn("w", weight).where("w > 0")
    sums = some.groupBy("gk", "start").agg(*_sums("w"), F.max("was").alias("was"))
    return _inverted(_moments(sums, ["gk", "start", "was"], share / chi2_cdf(chi2_quantile(share, _P), _P + 2)), ["gk", "start", "was"])


def _drawn(own: DataFrame, prior: float, keep: list[str]) -> DataFrame:
    """Estimates of groups with those of the wider groups beside them (w_*) as ``prior`` documents."""
    gap = [f"(m_{i} - w_m_{i})" for i in range(_P)]
    mean = [f"(n * m_{i} + {prior}d * w_m_{i}) / (n + {prior}d) as m_{i}" for i in range(_P)]
    cov = [f"(n * c_{j}_{i} + {prior}d * w_c_{j}_{i} + n * {prior}d / (n + {prior}d) * {gap[j]} * {gap[i]}) / (n + {prior}d) as c_{j}_{i}" for j, i in _PAIRS]
    return own.selectExpr(*keep, "n", *mean, *cov)


def _wider(moments: DataFrame, key: str) -> DataFrame:
    return moments.select(F.col("gk").alias(key), *[F.col(c).alias(f"w_{c}") for c in moments.columns if c[:2] in ("m_", "c_")])


def quality_rules(docs: DataFrame, *, share: float = 0.75, most_steps: int = 12, settled: float = 0.01, prior: float = 60.0, reject_p: float = 1e-7, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and d2, one row per input row.

    share: part of a group that an estimate concentrates on. Steps end when no log determinant
    falls by ``settled`` or more, at the latest after ``most_steps``. prior: documents that a
    wider group counts for. Estimates are of documents that pass the base rules. Null languages
    and sources are groups of their own. Empty tables give empty results; repeated rows are
    judged one by one; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "quality")
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("_text"))
    stats = text_statistics(raw, ["doc_id", "lang", "source"], "_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keys = [F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))).alias("gk"), F.concat(F.lit("1"), F.to_json(F.struct("lang"))).alias("_lang")]
    stats = shelf.put(stats.select("doc_id", *BASE, failed.alias("base_failed"), *[c.alias(k) for k, c in _features().items()], *keys))
    fit = stats.where("not base_failed").select(F.explode(F.array("gk", "_lang", F.lit("0"))).alias("gk"), *_XS)
    start, few = _starts(fit, shelf)
    sent = F.broadcast if few else lambda x: x
    params = held = shelf.put(start)
    for k in range(most_steps):
        then = _concentrated(fit, sent(params), share)
        if k == 1:
            then = then.withColumn("_k", F.row_number().over(Window.partitionBy("gk").orderBy("logdet", "start"))).where("_k = 1").drop("_k")
        then = shelf.put(then)
        shelf.drop(held)
        params, held = then.drop("was"), then
        if k > 1 and (then.agg(F.max(F.col("was") - F.col("logdet"))).first()[0] or 0.0) < settled:
            break
    inner = chi2_quantile(0.975, _P)
    sums = _distance(fit, sent(params)).where(F.col("d2") <= inner).groupBy("gk").agg(*_sums())
    found = shelf.put(_moments(sums, ["gk"], 0.975 / chi2_cdf(inner, _P + 2)))
    whole = _wider(found.where("gk = '0'"), "_all")
    langs = _drawn(found.where("gk like '1%'").crossJoin(F.broadcast(whole)), prior, ["gk"])  # one row
    parents = stats.select("gk", "_lang").distinct()
    own = found.join(parents, "gk").join(_wider(langs, "_lang"), "_lang")
    final = shelf.put(_inverted(_drawn(own, prior, ["gk"]), ["gk"]).drop("logdet"))
    out = _distance(stats, sent(final), "left")
    fine = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(1 - reject_p, _P), F.lit(True))
    return out.select("doc_id", *BASE, "base_failed", fine.alias("kept"), "d2")
