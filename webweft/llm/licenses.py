"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised alike: lower case, words of letters and digits,
``licence`` spelt ``license``, years left out.  A template is a bag of word bigrams.  In
a document, bigrams that occur in a template are its hits, and every stretch from one
hit to another is a candidate passage.  The size bound of the Dice coefficient prunes
templates and passages: with threshold t and a template of m bigrams, a passage of n
bigrams can only match if t / (2 - t) * m <= n <= (2 - t) / t * m, and a template needs
t / (2 - t) * m hits in the document.  For what is left the coefficient
2 |A & B| / (|A| + |B|) of the two bags decides.  A passage that begins or ends beside
a hit scores less than the one between hits, so no match is lost.

Of matches that overlap the heaviest stays: the common bigrams less those that only one
of both bags holds.  So a whole licence stays before a notice or an opening in it, and of
siblings the one that differs least.  Ties go to the earlier, then to the first template
by name, then to the shorter passage.

Defined results: null, empty and blank texts, and texts without a match, have an empty
list and score 0.  Repeated rows are scanned alike.  An empty table gives an empty
result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import islice
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import short_batches, table

THRESHOLD = 0.8
# Starts at most so many bigrams apart are neighbours (see ``Starts.best``); a count is walked to in so many steps.
NEAR, STEPS = 2, 64

# Whole licences, in ``license_texts``.
WHOLE = ("0BSD", "AGPL-3.0-text", "Apache-2.0-text", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "CC0-1.0-text",
         "GPL-1.0-text", "GPL-2.0-text", "GPL-3.0-text", "ISC", "JSON", "LGPL-2.0-text", "LGPL-2.1-text",
         "LGPL-3.0-text", "MIT", "MIT-0", "MPL-1.1-text", "MPL-2.0-text", "NCSA", "Unlicense", "X11")
# The usual statements of public licences, whole.
NOTICES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "Affero General Public License as published by the Free Software Foundation, either version 3 of the"
                " License, or (at your option) any later version.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the"
                     " GNU Affero General Public License version 3 as published by the Free Software Foundation.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                         "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
                         "for the specific language governing permissions and limitations under the License.",
    "BSD-2-line": "Licensed under the BSD 2-Clause License.",
    "BSD-line": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                           "International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-"
                              "NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike "
                              "4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
                           "International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                           "License.",
    "CC-BY-line": "Licensed under CC BY 4.0.",
    "CC-BY-name": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-ND-name": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "CC-BY-NC-name": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-NC-SA-name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "CC-BY-NC-ND-name": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring "
               "rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation; either version 2 of the "
               "License, or (at your option) any later version.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the "
                    "GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, either version 3 of the "
               "License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the "
                    "GNU General Public License version 3 as published by the Free Software Foundation.",
    "LGPL-2.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "Library General Public License as published by the Free Software Foundation; either version 2 of "
                "the License, or (at your option) any later version.",
    "LGPL-2.0-line": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                "the License, or (at your option) any later version.",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "Lesser General Public License as published by the Free Software Foundation, either version 3 of the"
                " License, or (at your option) any later version.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
               "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# Openings of licences; the one of BSD is shared by its kinds.
OPENINGS = {
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                   "provided that the following conditions are met:",
    "ISC-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
                   " fee is hereby granted, provided that the above copyright notice and this permission notice "
                   "appear in all copies.",
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                   "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain.",
}
TEXTS = {name: get_data(__package__, f"license_texts/{name}.txt").decode() for name in WHOLE}
TEMPLATES = TEXTS | NOTICES | OPENINGS
# Other spellings, and the years of copyright lines.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
YEARS = frozenset(map(str, range(1900, 2100)))
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [SPELLINGS.get(w, w) for w in map(str.lower, WORD.findall(text)) if w not in YEARS]


def places_of(text: str) -> list[tuple[int, int]]:
    """Where the words of ``words_of`` stand (code points, end exclusive)."""
    return [m.span() for m in WORD.finditer(text) if m[0] not in YEARS]


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


@dataclass
class Match:
    name: str
    start: int
    end: int
    score: float


class Scanner:
    """Templates as bags, and the templates of every bigram."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        bags = {name: Counter(bigrams(words_of(t))) for name, t in sorted(templates.items())}
        self.bags = {name: bag for name, bag in bags.items() if bag}
        self.holders: dict[tuple[str, str], list[tuple[float, str]]] = {}  # least sizes first
        for least, name in sorted((self.bounds(name)[0], name) for name in self.bags):
            for pair in self.bags[name]:
                self.holders.setdefault(pair, []).append((least, name))

    def bounds(self, name: str) -> tuple[float, float]:
        """Least and greatest number of bigrams that can reach the threshold."""
        m, t = self.bags[name].total(), self.threshold
        return t / (2 - t) * m - 1e-9, (2 - t) / t * m + 1e-9

    def starts(self, name: str, hits: list[tuple[int, tuple[str, str]]]) -> "Starts":
        return Starts(hits, self.bags[name], *self.bounds(name), self.threshold)

    def passages(self, name: str, hits: list[tuple[int, tuple[str, str]]]) -> Iterator[tuple[int, int, float]]:
        """Stretches between hits (first bigram, last bigram, Dice) that reach the threshold."""
        starts = self.starts(name, hits)
        for i in starts.hopeful():
            last, _, score = starts.ends(i)
            yield from ((int(starts.at[i]), int(a), float(s)) for a, s in zip(last, score))

    def scan(self, text: str | None) -> list[Match]:
        """Matches of a whole text, by place.

        Of every start only its best passage waits; one that runs into a match is cut there.  A start
        right behind a match loses the neighbour that its passages were left to, and is looked at again."""
        hits: dict[str, list[tuple[int, tuple[str, str]]]] = {}
        words, holders = words_of(text or ""), self.holders
        size = len(words) - 1
        for i, pair in enumerate(zip(words, islice(words, 1, None))):
            for least, name in holders.get(pair, ()):
                if least > size:
                    break
                hits.setdefault(name, []).append((i, pair))
        starts, waiting = {}, []

        def wait(name: str, i: int, limit: int | None = None, alone: bool = False) -> None:
            if best := starts[name].best(i, limit, alone):
                heappush(waiting, (-best[1], int(starts[name].at[i]), name, best[0], i, alone, best[2]))

        for name, own in hits.items():
            if len(own) >= self.bounds(name)[0]:
                starts[name] = self.starts(name, own)
                for i in starts[name].hopeful(own=True).tolist():
                    wait(name, i)
        taken: list[tuple[int, int]] = []  # disjoint and in order
        kept = []
        while waiting:
            _, first, name, last, i, alone, score = heappop(waiting)
            at = bisect(taken, (first, size))
            if at and taken[at - 1][1] >= first:
                continue
            if at < len(taken) and taken[at][0] <= last:
                wait(name, i, taken[at][0] - 1, alone)
                continue
            taken.insert(at, (first, last))
            kept.append((first, last, name, score))
            for other, own in starts.items():
                i = own.behind(last)
                if i is not None:
                    wait(other, i, alone=True)
        if not kept:
            return []
        places = places_of(text)
        return [Match(name, places[first][0], places[last + 1][1], score) for first, last, name, score in sorted(kept)]


class Starts:
    """The hits of one template in a text, as starts of passages."""

    def __init__(self, hits: list[tuple[int, tuple[str, str]]], bag: Counter, least: float, most: float, threshold: float):
        self.least, self.most, self.threshold, self.total = least, most, threshold, bag.total()
        self.at = np.array([i for i, _ in hits], dtype=np.int64)
        # a hit is common to both bags if the one as many before as the bag holds lies before the start
        before: dict[tuple[str, str], list[int]] = {}
        self.back = np.full(len(hits), -1, dtype=np.int64)
        for k, (_, pair) in enumerate(hits):
            own = before.setdefault(pair, [])
            if len(own) >= bag[pair]:
                self.back[k] = own[-bag[pair]]
            own.append(k)
        self.stop = np.searchsorted(self.at, self.at + int(most), "left")
        # the hit whose presence makes a start's own hit one too many, if it has one
        self.ahead = np.full(len(hits), len(hits), dtype=np.int64)
        later = self.back >= 0
        self.ahead[self.back[later]] = np.nonzero(later)[0]
        # a start this near behind another leaves it the passages to which that one's hit is common
        self.near = np.diff(self.at, prepend=-NEAR - 1) <= NEAR
        self._seen = (0, -1, 0)
        self._lists = (self.at.tolist(), self.back.tolist(), self.ahead.tolist(), self.stop.tolist())

    def hopeful(self, own: bool = False) -> np.ndarray:
        """Starts with enough common bigrams ahead; ``own``: and passages of their own (see ``best``)."""
        n, starts = len(self.at), np.arange(len(self.at))
        # one window slides over the hits: common bigrams of the longest passage from each start
        common, to, most = 0, 0, np.empty(n, dtype=np.int64)
        _, back, ahead, stops = self._lists
        for i, stop in enumerate(stops):
            while to < stop:
                common += back[to] < i
                to += 1
            most[i] = common
            common -= ahead[i] >= to
        low = np.where(self.near, np.maximum(starts, np.roll(self.ahead, 1)), starts)
        return np.nonzero((most >= self.least) & ((low < np.minimum(self.stop, self.ahead)) | (not own)))[0]

    def ends(self, i: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last bigram, weight and Dice of the passages from a start that reach the threshold and end by ``limit``."""
        stop = self.stop[i] if limit is None else min(self.stop[i], np.searchsorted(self.at, limit, "right"))
        return self._ends(i, i, stop, 1)

    def _ends(self, i: int, low: int, stop: int, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ends`` among the hits from ``low`` to before ``stop``; ``common`` bigrams to the first of them."""
        last = self.at[low:stop]
        counts = common + np.cumsum(self.back[low:stop] < i) - (self.back[low] < i)
        both = last - self.at[i] + 1 + self.total
        good = (both - self.total >= self.least) & (2 * counts >= self.threshold * both - 1e-9)
        last, counts, both = last[good], counts[good], both[good]
        return last, 3 * counts - both, 2 * counts / both

    def behind(self, last: int) -> int | None:
        """The first start behind a bigram, if it leaves passages to one that is not."""
        i = int(np.searchsorted(self.at, last, "right"))
        return i if 0 < i < len(self.at) and self.near[i] else None

    def common(self, i: int, end: int) -> int:
        """Common bigrams of the passage from hit ``i`` to hit ``end``.

        Walks from the passage asked for before, if that is near, else counts."""
        at, to, n = self._seen
        if i < at or i - at + abs(end - to) > STEPS or to < i - 1:
            n = int(np.count_nonzero(self.back[i:end + 1] < i))
        else:
            _, back, ahead, _ = self._lists
            while to < end:
                to += 1
                n += back[to] < at
            while to > end:
                n -= back[to] < at
                to -= 1
            while at < i:
                n -= ahead[at] > to
                at += 1
        self._seen = (i, end, n)
        return n

    def best(self, i: int, limit: int | None = None, alone: bool = False) -> tuple[int, int, float] | None:
        """The heaviest passage from a start (last bigram, weight, Dice) that is not lighter than the same one
        from a neighbouring start, of which every heaviest passage is one.

        To the ends from ``ahead[i]`` on, hit i is one too many: without it the passage is heavier.  To the
        ends before ``ahead[i - 1]`` the hit before is common: with it the passage is heavier, if at most
        ``NEAR`` bigrams are added, and still reaches the threshold (one common bigram outweighs t / 2 times
        the bigrams added) and keeps the size bound (a passage at the bound holds the whole template, so
        no hit before it is common).  ``alone``: the hit before is not to be had."""
        at, back, ahead, stops = self._lists
        stop = stops[i] if limit is None else min(stops[i], int(np.searchsorted(self.at, limit, "right")))
        stop = min(stop, ahead[i])
        low = max(i, ahead[i - 1]) if not alone and self.near[i] else i
        if low >= stop:
            return None
        common, base = self.common(i, low), self.total + 1 - at[i]
        if 2 * (common + stop - 1 - low) < self.threshold * (at[low] + base) - 1e-9:
            return None
        if stop - low > STEPS:
            last, weight, score = self._ends(i, low, stop, common)
            if not len(last):
                return None
            k = int(weight.argmax())
            return int(last[k]), int(weight[k]), float(score[k])
        best = None
        for k in range(low, stop):
            common += k > low and back[k] < i
            both = at[k] + base
            if both - self.total >= self.least and 2 * common >= self.threshold * both - 1e-9 and (
                    best is None or 3 * common - both > best[1]):
                best = at[k], 3 * common - both, 2 * common / both
        return best


SPANS = "array<struct<license:string,start:bigint,end:bigint,score:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, matches) of every row; ``matches`` by place, with code points, end exclusive."""
    short_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [[{"license": m.name, "start": m.start, "end": m.end, "score": m.score} for m in scanner.scan(t)]
                     for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, matches {SPANS}")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return out.select("doc_id", F.array_distinct(F.transform("matches", lambda m: m["license"])).alias("licenses"),
                      best.alias("score"), "matches")


QUERIES = {"op7_licenses": op7_licenses}
