"""Licence scan: sparse TF-IDF cosine to licence statements, then inheritance from the nearest ancestor directory.

Every line of a text, every block of lines between blank ones, every sentence, and every run of words as long as some
template (wherever it begins, over line ends, too) is a candidate statement.  Its vector holds the words that some
template has, by idf over the templates, and all other words at the greatest idf.  A file's own licence is the template of
the greatest cosine of at least ``THRESHOLD``; ties go to the name that sorts first.

Statements stand in prose, where "mit" may be German and "all rights to" no notice.  So a word counts in the product no
oftener than the template has it, and a candidate must share ``SENTENCE_WORDS`` or ``RUN_WORDS`` different words with it
(all, if it has fewer).

Nothing that could reach the threshold is passed over.  A cosine is at most the norm of the template's weights of the
words shared, so a text whose words as a whole have too little of every template is not read further.  Runs are bounded
from above, all at once, and scored only where the bound reaches the threshold and the best so far.

A file named like a licence file and with a licence of its own speaks for its directory.  Directories find their nearest
ancestor that is spoken for (a join on paths, one row per directory and ancestor), and files without a licence of
their own join their directory's answer, so a directory with very many files is one row on one side and a key that
Spark can split on the other.

Defined results: null or empty texts have no licence of their own and may inherit; a null path is in no directory;
equal scores in one directory go to the licence that sorts first; repeated rows are answered alike; a long text is read in
one task; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, slices

THRESHOLD = 0.55
SENTENCE_WORDS, RUN_WORDS = 2, 3
#: Words whose runs are bounded at one time.
RUN_STEP = 20_000
#: How licences are stated in headers and notices, by SPDX identifier or a class of our own.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work: CC0 1.0 Universal public domain dedication."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MIT", "The MIT License (MIT)"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_LICENSE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|copyright|notice)([.-][^/]*)?$"


class Templates:
    """TF-IDF vectors of the templates, by word."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        bags = [Counter(_WORD.findall(t.lower())) for _, t in templates]
        df = Counter(w for b in bags for w in b)
        self.names = [n for n, _ in templates]
        self.idf = {w: math.log(1 + len(bags) / c) for w, c in df.items()}
        self.unknown = math.log(1 + len(bags))
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            norm = math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in bag.items()))
            for w, c in bag.items():
                self.by_word.setdefault(w, []).append((k, c * self.idf[w] / norm))
        self.bags = bags
        self.least = np.array([min(RUN_WORDS, len(b)) for b in bags])
        self.lengths = sorted({b.total() for b in bags})
        known = list(self.by_word)
        self.number = {w: k for k, w in enumerate(known)}
        self.square = np.array([self.idf.get(w, self.unknown) ** 2 for w in [*known, ""]])
        self.share = np.zeros((len(known) + 1, len(bags)))
        for w, own in self.by_word.items():
            for k, t in own:
                self.share[self.number[w], k] = t * t
        self.part = np.zeros((len(known) + 1, len(bags)))
        for w, own in self.by_word.items():
            for k, t in own:
                self.part[self.number[w], k] = self.idf[w] * t

    def hopeful(self, words: set[str]) -> np.ndarray:
        """The templates that have enough of their weight in these words."""
        own = [self.number[w] for w in words if w in self.number]
        return np.flatnonzero(self.share[own].sum(axis=0) >= self.threshold**2 - 1e-9) if own else np.empty(0, dtype=np.int64)

    def best_in_prose(self, words: Sequence[str], least: int) -> tuple[float, str]:
        """(cosine, name) of the nearest template that shares ``least`` different words; repeats beyond its own do not add."""
        bag = Counter(words)
        dots: dict[int, float] = {}
        shared: Counter = Counter()
        norm = 0.0
        for w, c in bag.items():
            idf = self.idf.get(w, self.unknown)
            norm += (c * idf) ** 2
            for k, t in self.by_word.get(w, ()):
                dots[k] = dots.get(k, 0.0) + min(c, self.bags[k][w]) * idf * t
                shared[k] += 1
        score, name = min(((-d, self.names[k]) for k, d in dots.items() if shared[k] >= min(least, len(self.bags[k]))), default=(0.0, ""))
        return (-score / math.sqrt(norm), name) if name else (0.0, "")

    def best_run(self, words: list[str], own: np.ndarray, best: tuple[float, str]) -> tuple[float, str]:
        """The least of ``best`` and (-cosine, name) of all runs of a template's length that reach the threshold; ``own``: the hopeful templates."""
        n = len(words)
        ids = self.ids(words)
        longest = min(n, self.lengths[-1])
        share = _sums(self.share[ids][:, own])
        # A run lies in a window of the greatest length, and what it has of a template the window has too.
        if not ((share[longest:] - share[:-longest]).max(axis=1) >= self.threshold**2 - 1e-9).any():
            return best
        dot, square, held = (_sums(x) for x in (self.part[ids][:, own], self.square[ids][:, None], self.part[ids][:, own] > 0))
        square = square[:, 0]
        bounds, starts, ends = [], [], []
        for length in sorted({min(n, x) for x in self.lengths}):
            # repeats add more to a norm than their squares and count as words held, so this is never below the cosine
            bound = np.where(held[length:] - held[:-length] >= self.least[own], dot[length:] - dot[:-length], 0.0).max(axis=1) / np.sqrt(square[length:] - square[:-length])
            at = np.flatnonzero(bound >= max(-best[0], self.threshold) - 1e-6)
            bounds.append(bound[at])
            starts.append(at)
            ends.append(at + length)
        bound, start, end = (np.concatenate(x) for x in (bounds, starts, ends))
        seen: set[tuple[str, ...]] = set()
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < -best[0] - 1e-9:
                break
            run = tuple(words[start[k] : end[k]])
            if run not in seen:
                seen.add(run)
                best = min(best, _flip(self.best_in_prose(run, RUN_WORDS)))
        return best

    def ids(self, words: Sequence[str]) -> np.ndarray:
        """Numbers of words; one number for all that no template has."""
        none = len(self.number)
        return np.fromiter((self.number.get(w, none) for w in words), dtype=np.int64, count=len(words))

    def bounds(self, ids: np.ndarray, ranges: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of each range of words a bound of its cosine with any of the templates ``own``: repeats only raise it."""
        edges, at = np.unique(ranges, return_inverse=True)
        sums = np.zeros((len(edges), len(own) + 1))
        carry = np.zeros(len(own) + 1)
        for a in range(0, len(ids), RUN_STEP):
            part = ids[a : a + RUN_STEP]
            here = _sums(np.column_stack((self.part[part][:, own], self.square[part])))
            inside = np.flatnonzero((edges >= a) & (edges <= a + len(part)))
            sums[inside] = carry + here[edges[inside] - a]
            carry = carry + here[-1]
        gain = sums[at.reshape(ranges.shape)[:, 1]] - sums[at.reshape(ranges.shape)[:, 0]]
        return gain[:, :-1].max(axis=1) / np.sqrt(gain[:, -1])

    def of_text(self, text: str | None) -> tuple[str | None, float]:
        """(licence, cosine) of a whole text; (None, 0) below the threshold."""
        low = text.lower() if text else ""
        lines = [_WORD.findall(line) for line in low.split("\n")]
        words = [w for line in lines for w in line]
        own = self.hopeful(set(words))
        if not len(own):
            return None, 0.0
        edge = np.cumsum([0, *map(len, lines)]).tolist()
        ranges = set(zip(edge[:-1], edge[1:]))
        start = 0
        for end in range(len(lines) + 1):
            if end == len(lines) or not lines[end]:
                if end - start > 1:
                    ranges.add((edge[start], edge[end]))
                start = end + 1
        edge = np.cumsum([0, *(len(_WORD.findall(s)) for s in _SENTENCE_END.split(low))]).tolist()
        ranges = np.array(sorted({r for r in ranges.union(zip(edge[:-1], edge[1:])) if r[0] < r[1]}), dtype=np.int64)
        bound = self.bounds(self.ids(words), ranges, own)
        best = (0.0, "")
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < max(-best[0], self.threshold) - 1e-6:
                break
            best = min(best, _flip(self.best_in_prose(words[ranges[k, 0] : ranges[k, 1]], SENTENCE_WORDS)))
        longest = self.lengths[-1]
        for a in range(0, max(1, len(words) - longest + 1), RUN_STEP):
            best = self.best_run(words[a : a + RUN_STEP + longest - 1], own, best)
        score = round(-best[0], 6)
        return (best[1], score) if score >= self.threshold else (None, 0.0)


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... rows."""
    return np.concatenate((np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)))


def _flip(found: tuple[float, str]) -> tuple[float, str]:
    return -found[0], found[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates()
    for batch in slices(batches):
        found = [templates.of_text(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["file", "path", "own_license", "own_score"])


def own_licenses(files: DataFrame, file: str, path: str, text: str = "text") -> DataFrame:
    """(file, path, own_license, own_score) for every row."""
    rows = files.select(F.col(f"`{file}`").cast("bigint").alias("file"), F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_scan, "file bigint, path string, own_license string, own_score double")


def scan(files: DataFrame, file: str = "file", path: str = "path", text: str = "text") -> DataFrame:
    """(file, path, own_license, own_score, license, license_from): own, inherited (with the directory) or none."""
    own = materialise(own_licenses(files, file, path, text).withColumn("dir", F.expr("CASE WHEN path IS NULL THEN NULL WHEN instr(path, '/') = 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END")), "license-own")
    speaks = own.where(F.col("own_license").isNotNull() & F.col("path").rlike(_LICENSE_FILE))
    spoken = speaks.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.l").alias("dir_license"))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    climbs = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("ancestor", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/"))
    answers = climbs.join(spoken, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_license"), "depth").alias("answer"))
    out = own.join(answers, "dir", "left")
    return out.select(
        "file", "path", "own_license", "own_score", F.coalesce("own_license", "answer.dir_license").alias("license"),
        F.expr("CASE WHEN own_license IS NOT NULL THEN 'own' WHEN answer IS NOT NULL THEN concat('dir:', answer.ancestor) ELSE 'none' END").alias("license_from"),
    )
