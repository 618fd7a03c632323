"""One query per operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, line_dedup, mixing, near_dup, pii, quality, substring, toxicity, urls
from .common import table

#: Rules of the URL query: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.line_dedup(docs.select("doc_id", "text"))
    removed = F.coalesce(F.size("lines_gone"), F.lit(0)).cast("long")
    return out.select("doc_id", removed.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents"), ["doc_id"]))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item", "overlap", F.col("best_item").isNotNull().alias("contaminated"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.filter_urls(table(spark, sf_dir, "pages"), [(v, h, p) for v, h, p in URL_RULES])
    return pages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_pii, op4_near_dup, op5_toxicity, op6_licenses, op7_mixing, op8_substring_dedup, op9_decontaminate, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return {
        "op2_line_dedup": r"""
            WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
            lines AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM raw),
            worded AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
            blocks AS (SELECT doc_id, pos, x, lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM worded),
            later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, pos) AS k FROM blocks WHERE y IS NOT NULL) WHERE k > 1),
            lone AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) AS k FROM blocks) WHERE k > 1 AND w >= 8),
            gone AS (SELECT w.doc_id, w.i FROM worded w JOIN later b ON w.doc_id = b.doc_id AND w.pos IN (b.pos, b.pos + 1) UNION SELECT w.doc_id, w.i FROM worded w JOIN lone b ON w.doc_id = b.doc_id AND w.pos = b.pos),
            kept AS (SELECT l.doc_id, count(g.i) AS n_removed, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
            SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept""",
        "op8_substring_dedup": f"""
            WITH docs AS (SELECT doc_id, {words} AS w FROM documents),
            tokens AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM docs),
            windows AS (SELECT doc_id, unnest(range(len(w) - 12)) AS i, w FROM docs WHERE len(w) >= 13),
            hashed AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 13], ' ')) AS h FROM windows),
            least AS (SELECT h, min(doc_id) AS d FROM hashed GROUP BY h),
            hits AS (SELECT doc_id, i FROM hashed JOIN least USING (h) WHERE doc_id > d),
            gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM hits),
            kept AS (SELECT t.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(t.x, ' ' ORDER BY t.i) FILTER (g.i IS NULL), '') AS t FROM tokens t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
            SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
        "op10_url_filter": rf"""
            WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
            cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            fit AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k FROM parts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
            SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fit f ON p.page_id = f.page_id AND f.k = 1""",
    }
