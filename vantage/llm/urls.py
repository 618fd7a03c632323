"""URL filters: a broadcast trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of rules is broadcast, so its size is checked.
MAX_RULES = 5_000_000


class UrlTrie:
    """Rules (verdict, host, path) under their reversed host labels, then their path segments.

    A path rule covers every path that starts with it, so its last segment may be a part of one:
    complete segments are edges, the rest is kept at the node where they end.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, part = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("parts", {})[part] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        node, segments = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            at = node
            for i, segment in enumerate(segments):
                parts = at.get("parts")
                if parts:
                    rest = "/".join(segments[i:])
                    for part, (rule, verdict) in parts.items():
                        if rest.startswith(part) and (best[0] is None or len(rule) > len(best[0])):
                            best = (rule, verdict)
                at = at.get("segments", {}).get(segment)
                if at is None:
                    break
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of every row.

    Host and path are empty where the url is null or has no ``://``. Urls that no rule fits get
    ``default``. Of two rules with the same host and path the later one holds. Rows are judged
    one by one; repeated rows, empty tables and other columns need nothing special.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = parts.schema[0].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trie.value.find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [b.column(0), b.column(1).cast(pa.string()), b.column(2).cast(pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
