"""License scan: fuzzy search for short notices.

A notice of which at most k letters are wrong, missing or added still holds one of its k + 1 pieces unchanged, so an automaton
over all pieces finds every place where it can stand; there the regex library's bounded-error matching decides, counts the
errors and gives the span. Each place is decided alone, and of spans of one notice that overlap the one with the fewest errors stays, so
every occurrence overlaps a span that is reported. Fixed phrases are looked up besides, word by word, as the base; a notice that is one of
them is reported only where it has errors.

Null and empty texts have no words, no labels and score 0. Spans are in code points of the text (end exclusive). Repeated rows
give equal results; only the text is read, whole, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, steps, word_ranges

# Phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices, lower-cased, with the method's own labels and the errors allowed.
NOTICES = (
    ("licensed under the apache license", "apache", 4),
    ("permission is hereby granted, free of charge", "mit", 5),
    ("permission to use, copy, modify, and/or distribute this software", "isc", 6),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("this software is provided 'as-is', without any express or implied", "zlib", 6),
    ("boost software license - version 1.0", "boost", 4),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("eclipse public license", "epl", 2),
    ("european union public licence", "eupl", 3),
    ("this is free and unencumbered software", "unlicense", 4),
    ("the artistic license", "artistic", 2),
    ("gnu general public license", "gnu-gpl", 2),
    ("gnu lesser general public license", "gnu-lgpl", 3),
    ("gnu affero general public license", "gnu-agpl", 3),
    ("gnu free documentation license", "gnu-fdl", 3),
    ("either version 2 of the license, or (at your option) any later version", "or-later", 6),
    ("either version 3 of the license, or (at your option) any later version", "or-later", 6),
    ("creative commons attribution", "creative-commons", 3),
    ("attribution-sharealike", "cc-by-sa", 2),
    ("attribution-noncommercial", "cc-by-nc", 2),
    ("attribution-noderivs", "cc-by-nd", 2),
    ("cc0 1.0 universal", "cc0", 1),
    ("dedicated to the public domain", "public-domain", 3),
    ("spdx-license-identifier", "spdx", 2),
    ("no part of this publication may be reproduced", "no-copying", 5),
    ("all rights reserved", "reserved-like", 2),
)

_WORD = rb"0-9a-z\x80-\xff"


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, text) of errors + 1 pieces that cover the notice."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def _tools(notices: tuple):
    machine = ahocorasick.Automaton()
    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, (text, _, errors) in enumerate(notices):
        for at, piece in pieces(text, errors):
            seeds.setdefault(piece, []).append((n, at))
    for piece, uses in seeds.items():
        machine.add_word(piece, (len(piece), uses))
    machine.make_automaton()
    return machine, [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={errors}}}") for text, _, errors in notices]


def fuzzy(low: str, notices: tuple = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, begin, end, errors) of the notices in a lower-cased text, in order of begin; spans of one notice don't overlap."""
    machine, patterns = _tools(notices)
    windows: dict[int, set[int]] = {}
    for last, (size, uses) in machine.iter(low):
        for n, at in uses:
            windows.setdefault(n, set()).add(last - size + 1 - at)
    found = []
    for n, begins in windows.items():
        text, label, errors = notices[n]
        open_, taken = [], SortedSpans()

        def look(lo: int, hi: int, n=n, least=len(text) - errors, open_=open_) -> None:
            m = patterns[n].search(low, lo, hi) if hi - lo >= least else None
            if m:
                heappush(open_, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

        for begin in begins:
            look(max(0, begin - errors), min(len(low), begin + len(text) + errors))
        while open_:
            e, start, end, lo, hi = heappop(open_)
            # What a span that stays leaves of a window may hold another.
            a, b = taken.overlapping(start, end) or taken.add(start, end)
            if (a, b) == (start, end) and (e or text not in PHRASES):
                found.append((label, a, b, e))
            look(lo, a)
            look(b, hi)
    return sorted(set(found), key=lambda x: (x[1], x[0], x[2]))


class SortedSpans:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []

    def overlapping(self, a: int, b: int) -> tuple[int, int] | None:
        """A span that overlaps this one."""
        i = bisect_right(self.begins, a)
        if i and self.ends[i - 1] > a:
            return self.begins[i - 1], self.ends[i - 1]
        return (self.begins[i], self.ends[i]) if i < len(self.begins) and self.begins[i] < b else None

    def add(self, a: int, b: int) -> tuple[int, int]:
        i = bisect_right(self.begins, a)
        self.begins.insert(i, a)
        self.ends.insert(i, b)
        return a, b


@cache
def _base():
    out = []
    for phrase, label in PHRASES.items():
        words = [w.encode() for w in phrase.split()]
        gap = b"[^" + _WORD + b"]+"
        out.append((max(words, key=len), re.compile(b"(?<![" + _WORD + b"])" + gap.join(words) + b"(?![" + _WORD + b"])"), label))
    return out


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), notices: tuple = NOTICES) -> DataFrame:
    """``keep`` columns, word counts, base places, labels, score and fuzzy spans (label:begin:end:errors) for every row."""
    kept = df.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            n_words, n_base, firsts, lasts, bases, labels, scores, spans = ([] for _ in range(8))
            for first, last, data, at in steps(batch.column("__text")):
                low = LOWER[data]
                begin, _, owner = word_ranges(ALNUM[low], at)
                count = np.bincount(owner, minlength=last - first)
                before = np.concatenate([[0], np.cumsum(count)])
                whole = low.tobytes()
                for i in range(last - first):
                    own = whole[at[i] : at[i + 1]]
                    places, named = [], set()
                    for needle, pattern, label in _base():
                        if needle in own:
                            hits = [m.start() for m in pattern.finditer(own)]
                            places += hits
                            if hits:
                                named.add(label)
                    near = fuzzy(own.decode(), notices)
                    which = np.searchsorted(begin, np.array(places, np.int64) + at[i]) - before[i] if places else []
                    n_words.append(int(count[i]))
                    n_base.append(len(places))
                    firsts.append(int(min(which)) if places else None)
                    lasts.append(int(max(which)) if places else None)
                    bases.append(",".join(sorted(named)))
                    labels.append(",".join(sorted(named | {x[0] for x in near})))
                    allowed = {label: errors for _, label, errors in notices}
                    scores.append(1.0 if places else max((1 - x[3] / (2 * allowed[x[0]] + 1) for x in near), default=0.0))
                    spans.append(",".join(f"{x[0]}:{x[1]}:{x[2]}:{x[3]}" for x in near))
            made = [pa.array(x, t) for x, t in ((n_words, pa.int64()), (n_base, pa.int64()), (firsts, pa.int64()), (lasts, pa.int64()), (bases, pa.string()), (labels, pa.string()), (scores, pa.float64()), (spans, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "fuzzy_spans"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name in keep)
    return kept.mapInArrow(run, f"{types}n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, fuzzy_spans string")


def op10_license(spark, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=("doc_id",))
