"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are short notices, whole licence texts (the files in ``licences/``) and the openings of these. A whole text is
compared as a file with the whole licences; and every line (a header may stand anywhere), every run of up to RUN
neighbouring lines and every window of a template's own number of words, across and within lines, with the
notices, the licences of at most LONG words and the openings, so wrapping and the rest of a long line do not decide.
All are sparse TF-IDF vectors. Document
frequencies of all terms are counted over all lines of the corpus. A term weighs by the share of lines that
hold it; shares under LEAST_SHARE weigh like LEAST_SHARE, so that the weight of rare words does not grow with
the corpus, and only the terms above it, a bounded number, are sent. Templates that a text cannot reach are
skipped exactly: by Cauchy-Schwarz its distinct terms must hold enough of the template's mass, and a line or window
an anchor term, one of those without which the remaining mass is below the threshold.

A match with a licence's own text or notice counts before one with an opening or a sentence that several licences share, and
"All rights reserved" only where nothing else matches. Variants of a licence differ in a word or a version (``MARKS``). A match
whose text and template do not agree on these is in doubt: a template that agrees counts before it, and if there is none the
licence is UNKNOWN, not the nearest name.

A file without a licence of its own takes that of the licence file in its nearest ancestor directory,
found by joining directories' ancestor paths to directories with licence files. Directories, not files,
are walked, and both joins broadcast their hot keys (a bounded number), such as a root with a licence.

Defined results: null or empty texts have no licence of their own; a null path is a file without
directory, which inherits nothing; ties go to the higher cosine, then the template's name, and among
licence files of a directory to the smallest path; repeated rows are files each; no templates or an
empty table give no licences; whole texts of any length are searched; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, join_hot, materialize

RUN = 3  #: neighbouring lines that may make one header
LEAST_COSINE = 0.7
LEAST_LONG = 0.9  #: for whole files, and for templates of over SHORT words
SHORT, LONG = 60, 300  #: words of an opening; most words of a whole licence that is searched for within texts
OWN, SHARED, LAST = 0, 1, 2  #: what a template says: its licence, one of several, or that rights are reserved
LEAST_SHARE = 1e-4  #: share of lines under which all terms weigh alike
FLUSH_TERMS = 500_000
#: Short public notices of common licences, as they stand in file headers.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "Proprietary": ["All rights reserved."],
}

#: Words and versions that tell variants of a licence apart.
NUMBERS = frozenset({"1", "1.1", "1.2", "1.3", "2", "2.1", "2.5", "3", "4", "5"})
MARKS = NUMBERS | {"affero", "lesser", "library", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "noderivs"}
UNKNOWN = "unknown variant"
TITLE = 12  #: words of a whole licence that name it
LEAST_EXACT = 0.95  #: for templates of so few words that another sentence may hold most of them
#: Notices that do not name one licence.
RANK = {"BSD": SHARED, "Proprietary": LAST}
SPDX = "SPDX-License-Identifier: "
FOLDER = Path(__file__).with_name("licences")

_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def whole_licences(folder: Path = FOLDER) -> dict[str, str]:
    """Name and text of each licence file."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(folder.glob("*.txt"))}


def with_spdx(templates: dict[str, list[str]], whole: dict[str, str]) -> dict[str, list[str]]:
    """``templates`` and the identifier lines of their names and of the whole licences' names."""
    out = {name: list(texts) for name, texts in templates.items()}
    for name in [n for n in {**templates, **whole} if n not in RANK]:
        forms = [name, f"{name}-only", f"{name}-or-later"] if re.search("GPL|GFDL", name) else [name]
        out.setdefault(name, []).extend(SPDX + x for x in forms)
    return out


def _marks(words) -> set[str]:
    """The MARKS among words and their parts; 'v2.0', '2.0' and '2' are one."""
    return MARKS & {re.sub(r"^v(?=\d)|\.0$", "", p) for w in set(words) for p in w.split("-")}


def _vocabulary(templates: dict[str, list[str]], whole: dict[str, str] | None = None) -> list[str]:
    texts = [x for xs in templates.values() for x in xs] + list((whole or {}).values())
    return sorted({t for x in texts for t in terms(x)})


@dataclass
class Template:
    name: str
    rank: int
    vector: dict[str, float]
    size: int  #: words
    least: float
    anchors: set[str]  #: without one of these the cosine is below ``least``
    marks: set[str]
    notice: bool  #: its text must hold all of its marks; that of openings and files none that they lack

    def doubts(self, words: list[str]) -> bool:
        held = _marks(words)
        if self.notice:
            return held - (set() if self.marks & NUMBERS else NUMBERS) != self.marks
        return bool(held - self.marks - NUMBERS)


class Templates:
    """TF-IDF vectors of the templates, weights of other terms, and the anchors of a threshold."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], lines: int, least: float, whole: dict[str, str] | None = None):
        whole = whole or {}
        weight = lambda n: 1 - math.log(max((n + 1) / (lines + 1), LEAST_SHARE))
        self.idf = {t: weight(df.get(t, 0)) for t in df.keys() | set(_vocabulary(templates, whole))}
        self.foreign = weight(0)
        short = lambda x: max(least, LEAST_EXACT) if x.startswith(SPDX) or x in TEMPLATES["Proprietary"] else least
        self.notices = self._made(((name, RANK.get(name, OWN), terms(x), short(x)) for name in sorted(templates) for x in templates[name]), True)
        self.files = self._made((name, OWN, terms(x), max(least, LEAST_LONG)) for name, x in sorted(whole.items()))
        for t in self.files:
            t.marks = _marks(terms(whole[t.name])[:TITLE])
        inside = [(name, OWN, w, max(least, LEAST_LONG)) for name, x in sorted(whole.items()) if len(w := terms(x)) <= LONG]
        inside += [(name, SHARED, terms(x)[:SHORT], least) for name, x in sorted(whole.items())]
        self.inside = self.notices + self._made(inside)
        # squared weights by term and template: what of a template a text can hold at most, by its distinct terms
        self.every = self.files + self.inside
        self.row = {t: i for i, t in enumerate(sorted(set().union(*(t.vector for t in self.every))))} if self.every else {}
        self.mass = np.zeros((len(self.row), len(self.every)))
        for k, t in enumerate(self.every):
            for w, x in t.vector.items():
                self.mass[self.row[w], k] = x * x
        self.enough = np.array([t.least * t.least * 0.999 for t in self.every])
        anchors = set().union(*(t.anchors for t in self.notices)) if self.notices else set()
        self.anchor = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(anchors, key=lambda a: (-len(a), a)))) + r")(?![a-z0-9])") if anchors else None

    def _made(self, rows, notice: bool = False) -> list[Template]:
        out = []
        for name, rank, words, least in rows:
            v, norm = self._vector(words)
            if not norm:
                continue
            v = {t: x / norm for t, x in v.items()}
            own: set[str] = set()
            mass = 1.0
            for t in sorted(v, key=lambda t: (-v[t], t)):
                if mass < least * least * 0.999:
                    break
                own.add(t)
                mass -= v[t] ** 2
            out.append(Template(name, rank, v, len(words), least, own, _marks(words), notice))
        return out

    def _vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        v = {t: n * self.idf.get(t, self.foreign) for t, n in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def best(self, words: list[str]) -> tuple[int, float, str] | None:
        """(rank, cosine, name) of the best notice for all of the words."""
        got = self._best(words, self.notices)
        return got and (got[0], *got[2:])

    def _best(self, words: list[str], among: list[Template], title: int | None = None) -> tuple[int, bool, float, str] | None:
        """(rank, doubt, cosine, name) of the best of ``among`` for all of the words; doubt is of the first ``title`` of them."""
        weight, norm = self._vector(words)
        found = []
        for t in among:
            cosine = sum(x * weight[w] for w, x in t.vector.items() if w in weight) / norm
            if cosine >= t.least:
                found.append((t.rank, t.doubts(words[:title]), cosine, t.name))
        return min(found, key=lambda f: (*f[:2], -f[2], f[3]), default=None)

    def find(self, text: str) -> tuple[float, str, int] | None:
        """(cosine, template, line) of the best match in a whole text."""
        low = text.lower()
        rows = [self.row[w] for w in set(_TERM.findall(low)) if w in self.row]
        open_ = np.flatnonzero(self.mass[rows].sum(axis=0) >= self.enough) if rows else ()  # Cauchy-Schwarz
        if not len(open_):
            return None
        n = len(self.files)
        file = self._best(terms(low), [self.files[k] for k in open_ if k < n], TITLE) if open_[0] < n else None
        if file and not file[1]:
            return file[2], file[3], 0
        inside = [self.inside[k - n] for k in open_ if k >= n]
        notices = [self.inside[k - n] for k in open_ if n <= k < n + len(self.notices)]
        top = None
        if notices:
            lines = low.split("\n")
            hit = [i for i, x in enumerate(lines) if self.anchor.search(x)]
            for i in sorted({max(0, i - k) for i in hit for k in range(RUN)}):
                words: list[str] = []
                for j in range(i, min(len(lines), i + RUN)):
                    words = words + terms(lines[j])
                    if words and (got := self._best(words, notices)) and self._better(got, top):
                        top = (*got, i)
        top = self._windows(low, inside, top) or (file and (*file, 0))
        return top and (top[2], UNKNOWN if top[1] else top[3], top[4])

    @staticmethod
    def _better(got: tuple, top: tuple | None) -> bool:
        return top is None or got[:2] < top[:2] or (got[:2] == top[:2] and got[2] > top[2] + 1e-12)

    def _windows(self, low: str, among: list[Template], top: tuple[int, bool, float, str, int] | None) -> tuple[int, bool, float, str, int] | None:
        """The better of ``top`` and the best window of a template's own length that holds one of its anchors."""
        found = list(_TERM.finditer(low))
        words = [m[0] for m in found]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.idf:
                places.setdefault(w, []).append(i)
        for t in among:
            if top is not None and t.rank > top[0]:
                continue
            v, size, enough = t.vector, t.size, t.least * t.least * 0.999
            spans: list[list[int]] = []
            for p in sorted(p for w in t.anchors for p in places.get(w, ())):
                if spans and p - size + 1 <= spans[-1][1]:
                    spans[-1][1] = p + size
                else:
                    spans.append([max(0, p - size + 1), p + size])
            for start, end in spans:
                part = words[start:end]
                held = set(part)
                if sum(x * x for w, x in v.items() if w in held) < enough:
                    continue
                cosine, first = self._slide(part, v, size)
                got = (t.rank, cosine >= t.least and t.doubts(part[first : first + size]), cosine)
                if cosine >= t.least and self._better(got, top):
                    top = (*got, t.name, low.count("\n", 0, found[start + first].start()))
        return top

    def _slide(self, words: list[str], v: dict[str, float], size: int) -> tuple[float, int]:
        """(cosine, first word) of the best window of ``size`` words; sums are carried from window to window."""
        count: Counter = Counter()
        dot = square = 0.0
        best = (0.0, 0)
        for j, w in enumerate(words):
            x = self.idf.get(w, self.foreign)
            square += x * x * (2 * count[w] + 1)
            count[w] += 1
            dot += x * v.get(w, 0.0)
            if j >= size:
                out = words[j - size]
                x = self.idf.get(out, self.foreign)
                count[out] -= 1
                square -= x * x * (2 * count[out] + 1)
                dot -= x * v.get(out, 0.0)
            if j >= size - 1 or j == len(words) - 1:
                cosine = dot / math.sqrt(square)
                if cosine > best[0] + 1e-12:
                    best = (cosine, max(0, j - size + 1))
        return best


def _term_lines(batches):
    """Lines in all, under the empty term, and lines that hold each term."""
    count: Counter = Counter()
    for batch in batches:
        for text in column(batch, "text"):
            lines = (text.as_py() or "").lower().split("\n")
            count[""] += len(lines)
            for x in lines:
                count.update(set(_TERM.findall(x)))
            if len(count) > FLUSH_TERMS:
                yield _counted(count)
                count.clear()
    yield _counted(count)


def _counted(count: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])


def matches(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_COSINE, whole: dict[str, str] | None = None) -> DataFrame:
    """files(doc_id, path, text) -> (doc_id, path, words, own_license, cosine, line)."""
    if templates is None:
        whole = whole_licences() if whole is None else whole
        templates = with_spdx(TEMPLATES, whole)
    counts = materialize(files.select("text").mapInArrow(_term_lines, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    lines = (counts.where("term = ''").first() or {"n": 0})["n"]
    # at most the terms of a mean line over LEAST_SHARE rows, whatever the corpus
    df = {r["term"]: r["n"] for r in counts.where((F.col("term") != "") & (F.col("n") + 1 >= LEAST_SHARE * (lines + 1))).collect()}
    model = files.sparkSession.sparkContext.broadcast(Templates(templates, df, lines, least, whole))

    def run(batches):
        for batch in batches:
            found = [(t.as_py() or "") for t in column(batch, "text")]
            words = [len(t.split()) for t in found]
            found = [model.value.find(t) for t in found]
            own = pa.array([f and f[1] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "path"), pa.array(words, pa.int64()), own, pa.array([f and f[0] for f in found], pa.float64()), pa.array([f and f[2] for f in found], pa.int64())], names=["doc_id", "path", "words", "own_license", "cosine", "line"])

    return files.select("doc_id", "path", "text").mapInArrow(run, "doc_id long, path string, words long, own_license string, cosine double, line long")


def scan(docs: DataFrame, path: Column, licence_file: Column | None = None, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST_COSINE, whole: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, path, own_license, cosine, license, inherited_from) of every row.

    ``templates``: notices by name, by default TEMPLATES and identifier lines, with the texts of ``whole_licences``; ``whole``: texts by name.
    ``licence_file``: which files speak for their directory, over doc_id, path, words and own_license;
    by default those named LICENSE, LICENCE, COPYING or NOTICE.
    """
    if licence_file is None:
        licence_file = F.lower(F.regexp_extract("path", "[^/]*$", 0)).rlike("^(licen[cs]e|copying|notice)(\\.[a-z]+)?$")
    files = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    found = matches(files, templates, least, whole).withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), "")))
    found = materialize(found, "licences")
    given = found.where(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & licence_file).groupBy("dir").agg(F.min(F.struct("path", "own_license")).alias("f"))
    given = given.select(F.col("dir").alias("up"), F.col("f.own_license").alias("license"), F.col("f.path").alias("inherited_from"))
    dirs = found.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    ups = dirs.select("dir", "files", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice(parts, 1, k)).alias("up")))).alias("u")).select("dir", "files", "u.*").dropDuplicates(["dir", "up"])
    ups = materialize(ups, "ancestors")
    below = ups.groupBy("up").agg(F.count("*").alias("n"))
    given = materialize(given.join(below, "up"), "given")  # a root with a licence has every directory below it
    nearest = join_hot(ups, given, ["up"], "n", ups.count()).where("license is not null")
    nearest = nearest.groupBy("dir", "files").agg(F.max_by(F.struct("license", "inherited_from"), "depth").alias("g"))
    nearest = materialize(dirs.join(nearest.select("dir", "g.license", "g.inherited_from"), "dir", "left"), "nearest")
    out = join_hot(found, nearest, ["dir"], "files", found.count())
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "license").alias("license"), F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"))
