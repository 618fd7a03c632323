"""Shared pieces: word splitting, column hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shelf import Shelf, shared_dir  # noqa: F401

#: ASCII whitespace, the word separator of every contract in this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII whitespace; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def sampled(key: str, size: int, of: int) -> Column:
    """True for about ``size`` of ``of`` rows, by hash of the key; the same rows on every run."""
    share = min(1.0, size / max(1, of))
    return F.lit(True) if share == 1.0 else F.xxhash64(F.col(key), F.lit("sample")) < int(2.0**64 * share) - 2**63


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it if the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
