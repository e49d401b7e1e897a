"""License scans by patience alignment.

Words that occur once in the text and once in the template are anchors; the longest increasing run of them is kept, and
the gaps between anchors are aligned in the same way, with common ends matched first. Coverage is the share of a
template's words that are matched within a stretch of text not much longer than the template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, views
from .tokens import ALNUM

#: License texts and standard notices (``.notice.txt``), one file each, without copyright lines.
TEXTS = Path(__file__).with_name("license_texts")

#: Short notices by which texts refer to well-known licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
_CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

#: Names by which one line refers to a license.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "mit": ("MIT License", "MIT Licence"),
    "bsd": ("BSD License",),
    "bsd-2-clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "isc": ("ISC License",),
    "zlib": ("zlib License",),
    "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "mpl-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL-1.1"),
    "mpl-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "epl-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "cc0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    **{k: (name,) for k, name in _GNU.items()},
    **{
        f"{k}-{v}": (f"{name}, version {short}", f"{name} version {v}", f"{name} v{short}", f"{name} v{v}", f"GNU {k} version {short}", f"GNU {k}v{short}", f"{k}v{short}", f"{k}-{v}")
        for k, v in (("gpl", "2.0"), ("gpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "3.0"), ("agpl", "3.0"))
        for name, short in [(_GNU[k], v.removesuffix(".0"))]
    },
    **{
        f"cc-{k}-{v}": (f"CC {k} {v}", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported'} License")
        for (k, name), v in product(_CREATIVE.items(), ("4.0", "3.0"))
    },
}
_BEFORE = [f"{verb} {article}" for verb, article in product(("licensed under", "released under", "distributed under", "available under", "this work is licensed under"), ("", "the ", "a "))]


def known() -> dict[str, tuple[str, ...]]:
    """All templates of each license: the short notices, one-line references, and whole texts."""
    out = {k: [t] for k, t in TEMPLATES.items()}
    for k, names in NAMES.items():
        out.setdefault(k, []).extend(before + name for before, name in product(("", *_BEFORE), names))
    for path in sorted(TEXTS.glob("*.txt")):
        out.setdefault(path.name.removesuffix(".txt").removesuffix(".notice"), []).append(path.read_text())
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two word sequences, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = _rising(sorted((i, once_b[w]) for w, i in once_a.items() if w in once_b))
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _once(words: list[int], start: int, end: int) -> dict[int, int]:
    """Words that occur once in a range, and where."""
    seen: dict[int, int] = {}
    for i in range(start, end):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose second rises too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            at.append(i)
        else:
            tops[pile], at[pile] = j, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


#: A reference of fewer words leaves room for one foreign word in four: spread wider, such words are no reference.
SHORT = 8


class Scanner:
    """Finds templates in texts. Any hit of the least coverage has one of the template's rarest words, so only the
    surroundings of those are aligned. Where templates match one stretch, the one with the most
    matched words, less the foreign ones between them, is kept."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], least: float):
        self.least = least
        plain = [(k, t) for k, several in templates.items() for t in ([several] if isinstance(several, str) else several)]
        hashed = [(k, ALNUM.hashes(np.frombuffer(t.encode(), np.uint8)).tolist()) for k, t in plain]
        self.templates = list({(k, tuple(words)): (k, words) for k, words in hashed if words}.values())
        self.vocabulary = np.unique(np.array([w for _, t in self.templates for w in t], np.uint64))
        # the distinct words of all templates after each other, and how often a template has each
        distinct = [np.unique(np.searchsorted(self.vocabulary, np.array(t, np.uint64)), return_counts=True) for _, t in self.templates]
        self.slots = np.concatenate([x for x, _ in distinct]) if distinct else np.empty(0, np.int64)
        self.times = np.concatenate([x for _, x in distinct]) if distinct else np.empty(0, np.int64)
        self.first = np.cumsum([0, *(len(x) for x, _ in distinct)])[:-1]
        self.needed = self.least * np.array([len(t) for _, t in self.templates])

    def scan(self, text: np.ndarray) -> tuple[int, list[tuple[str, float, int, int]]]:
        """Number of words, and hits (license, coverage, first word, end), the best one of each stretch."""
        h = ALNUM.hashes(text)
        if not len(h) or not len(self.vocabulary):
            return len(h), []
        slot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[slot] == h
        present = np.zeros(len(self.vocabulary), bool)
        present[slot[known]] = True
        may = np.flatnonzero(np.add.reduceat(np.where(present[self.slots], self.times, 0), self.first) >= self.needed)
        if not len(may):
            return len(h), []
        places: dict[int, list[int]] = {}
        for i in np.flatnonzero(known).tolist():
            places.setdefault(int(h[i]), []).append(i)
        found = []
        for t in may.tolist():
            name, words = self.templates[t]
            found += [(end - start - 2 * round(c * len(words)), -c, start, name, end) for name, c, start, end in self._hits(name, words, h, places)]
        taken = np.zeros(len(h), bool)
        out = []
        for _, c, start, name, end in sorted(found):
            if 2 * int(taken[start:end].sum()) <= end - start:
                taken[start:end] = True
                out.append((name, -c, start, end))
        return len(h), sorted(out, key=lambda x: (x[2], x[0]))

    def _hits(self, name: str, words: list[int], h: np.ndarray, places: dict[int, list[int]]) -> Iterator[tuple[str, float, int, int]]:
        m = len(words)
        slack = m // 2 + 2 if m >= SHORT else m // 4
        distinct = sorted(dict.fromkeys(words), key=lambda w: len(places.get(w, ())))
        missing = int((1 - self.least) * m + 1e-9)
        seeds = sorted((i, words.index(w)) for w in distinct[: missing + 1] for i in places.get(w, ()))
        spans: list[list[int]] = []
        for i, _ in seeds:
            start, end = max(0, i - m - slack), min(len(h), i + m + slack)
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        for start, end in spans:
            at = start
            while at < end:
                # one stretch after the other: repeated notices must not make each other's words ambiguous
                first = next((i for i, _ in seeds if i >= at), None)
                if first is None or first >= end:
                    break
                a, z = max(at, first - m - slack), min(end, first + m + slack)
                best = self._densest(patience(h[a:z].tolist(), words), m + slack)
                if len(best) < self.least * m or a + best[0][0] > first:
                    # equal notices side by side leave no unique words, or only the later one is met: narrower windows
                    # from where this one may start
                    for k in (k for k, w in enumerate(words) if w == h[first]):
                        for b, y in product((max(at, first - k),), (first - k + m, first - k + m + slack)):
                            found = self._densest(patience(h[b : min(end, y)].tolist(), words), m + slack)
                            if len(found) >= self.least * m and (len(best) < self.least * m or b + found[0][0] < a + best[0][0]):
                                a, best = b, found
                if len(best) >= self.least * m:
                    yield name, len(best) / m, a + best[0][0], a + best[-1][0] + 1
                    at = a + best[-1][0] + 1
                else:
                    at = first + 1

    @staticmethod
    def _densest(matched: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
        """The most matches within a stretch of the text of this width."""
        best, left = (0, 0), 0
        for right in range(len(matched)):
            while matched[right][0] - matched[left][0] >= width:
                left += 1
            if right + 1 - left > best[1] - best[0]:
                best = left, right + 1
        return matched[best[0] : best[1]]


HIT = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MADE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT))])


def scan_licenses(df: DataFrame, text: str = "text", templates: Mapping[str, str | Sequence[str]] | None = None, least: float = 0.9, carry: bool = True) -> DataFrame:
    """Adds n_words and hits (license, coverage, start, end: words, end exclusive) of at least ``least`` coverage.

    Words are letters, digits and what is beyond ASCII, with A-Z lowered. A null or empty text has no hits; templates
    without words are never found. A license has one template or several, by default all of ``known()``; of templates that
    match mostly the same words the one with the most matched words, less foreign ones, is reported. One pass, no shuffle. Made columns replace input columns of their names;
    ``carry=False`` leaves the text out of the result.
    """
    plain = known() if templates is None else dict(templates)

    def rows(batches):
        scanner = Scanner(plain, least)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            got = [scanner.scan(v if v is not None else np.empty(0, np.uint8)) for v in views(batch.column(0))]
            yield [pa.array([n for n, _ in got], pa.int64()), pa.array([[dict(zip(("license", "coverage", "start", "end"), x, strict=True)) for x in hits] for _, hits in got], kind)]

    return add_columns(df, text, MADE, rows, without=() if carry else (text,))
