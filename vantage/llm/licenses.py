"""Licence scans: exact phrases, and short notices found with bounded errors.

A notice that may differ in k characters is split into k + 1 pieces; wherever it occurs, one
piece stands unchanged (pigeonhole). An Aho-Corasick automaton finds the pieces, and the regex
library's bounded-error matching verifies a window around each and gives the edits.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, as words, and their labels; words in capitals tell a notice from its siblings
#: and must stand unchanged.
NOTICES = {
    "released under the MIT license": "mit",
    "licensed under the MIT license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the APACHE license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu GENERAL public license version 3": "gpl",
    "this work is licensed under the gnu GENERAL public license version 2": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu GENERAL public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu LESSER general public license": "lgpl",
    "under the terms of the gnu LESSER general public license": "lgpl",
    "under the terms of the gnu AFFERO general public license": "agpl",
    "you can redistribute it and or modify it under the terms of the gnu AFFERO general public license": "agpl",
    "licensed under cc BY 4 0": "cc-by",
    "licensed under cc BY SA 4 0": "cc-by-sa",
    "licensed under cc BY ND 4 0": "cc-by-nd",
    "licensed under cc BY NC 4 0": "cc-by-nc",
    "licensed under cc BY NC SA 4 0": "cc-by-nc-sa",
    "licensed under cc BY NC ND 4 0": "cc-by-nc-nd",
    "licensed under a creative commons ATTRIBUTION 4 0 international license": "cc-by",
    "licensed under a creative commons attribution SHAREALIKE 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution NODERIVATIVES 4 0 international license": "cc-by-nd",
    "licensed under a creative commons attribution NONCOMMERCIAL 4 0 international license": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the MOZILLA public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "distributed under the BOOST software license version 1 0": "boost",
    "made available under the terms of the ECLIPSE public license": "epl",
}
_LOWER = {i: i + 32 for i in range(65, 91)}
_GAPS = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: One edit for each so many characters.
CHARS_PER_EDIT = 12


class NoticeFinder:
    def __init__(self, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices, self.auto = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (told, label) in enumerate((NOTICES if notices is None else notices).items()):
            text, fixed = told.lower(), tuple(f" {w.lower()} " for w in told.split() if w.isupper())
            k = len(text) // chars_per_edit
            self.notices.append((text, label, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}"), fixed))
            cuts = [j * len(text) // (k + 1) for j in range(k + 2)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[s:e], []).append((i, s))
        for piece, uses in pieces.items():
            self.auto.add_word(piece, (len(piece), uses))
        self.auto.make_automaton()

    def find(self, norm: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of the notices in normalised text, by start.

        Seeds that put a notice at about the same place share one window, a little longer than
        the notice; of spans of one notice that overlap the one with the fewest edits counts, and
        a span gives way to an overlapping one of another label with fewer edits.
        """
        starts: dict[int, list[int]] = {}
        for end, (n, uses) in self.auto.iter(norm):
            for i, offset in uses:
                starts.setdefault(i, []).append(end - n + 1 - offset)
        found = []
        for i, seeds in starts.items():
            text, label, k, pattern, fixed = self.notices[i]
            seeds.sort()
            mine, j = set(), 0
            while j < len(seeds):
                first = last = seeds[j]
                while j < len(seeds) and seeds[j] <= first + 2 * k:
                    last, j = seeds[j], j + 1
                m = pattern.search(norm, max(0, first - k), max(0, min(len(norm), last + len(text) + k)))
                if m and m.end() > m.start() and all(w in f" {norm[m.start() : m.end()]} " for w in fixed):
                    mine.add((sum(m.fuzzy_counts), m.start(), m.end()))
            found += [(s, e, label, edits, 1 - edits / len(text)) for edits, s, e in _apart(mine)]
        found.sort()
        reach = [0]  # the furthest end so far, to know where spans that overlap may begin
        for s in found:
            reach.append(max(reach[-1], s[1]))
        out = []
        for j, (s, e, label, edits, similarity) in enumerate(found):
            lo, hi = j, j
            while lo > 0 and reach[lo] > s:
                lo -= 1
            while hi + 1 < len(found) and found[hi + 1][0] < e:
                hi += 1
            if not any(o[3] < edits and o[2] != label and o[0] < e and s < o[1] for o in found[lo : hi + 1]):
                out.append((s, e, label, edits, similarity))
        return out


def _apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (edits, start, end) that don't overlap, those with few edits first."""
    kept: list[tuple[int, int]] = []
    out = []
    for edits, s, e in sorted(spans):
        at = bisect.bisect(kept, (s, e))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            kept.insert(at, (s, e))
            out.append((edits, s, e))
    return out


def scan_text(text: str | None, finder: NoticeFinder, phrases: dict[str, str]) -> tuple:
    words = [w for w in _GAPS.split((text or "").translate(_LOWER)) if w]
    norm = " ".join(words)
    base: list[tuple[int, str]] = []
    padded = f" {norm} "
    for phrase, label in phrases.items():
        at, word, done = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, done = word + padded.count(" ", done, at), at
            base.append((word, label))
            at = padded.find(f" {phrase} ", at + 1)
    spans = finder.find(norm)
    starts = sorted(w for w, _ in base)
    own, labels = {x for _, x in base}, {s[2] for s in spans}
    where, word, done = [], 0, 0
    for s, e, label, edits, _ in spans:
        word, done = word + norm.count(" ", done, s), s
        where.append(f"{label}:{word}:{word + norm.count(' ', s, e)}:{edits}")
    score = 1.0 if base else max((s[4] for s in spans), default=0.0)
    return len(words), len(base), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(own)), ",".join(sorted(own | labels)), score, ",".join(where)


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    spans lists each notice as label:first word:last word:edits. score is 1 where a base phrase
    stands, else the best notice's similarity, 0 without one. Null and empty texts have none.
    Rows are judged one by one; repeated rows and empty tables need nothing special.
    """
    phrases = PHRASES if phrases is None else phrases
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(notices)
        for b in batches:
            rows = [scan_text(t.as_py(), finder, phrases) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
