"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

A template is the wording of a notice, or the words of a whole licence. Texts are compared with templates in the space of the templates' words, weighted
by counts of documents over the whole corpus; a word of no template weighs as the templates' average. Every line of a
text, every sentence of a line or of a paragraph, every run of lines that could each belong to a notice, and every window
of up to ``LONGEST`` lines with words is compared with the notices, and the text as a whole with the licences too. The words of little weight are no sign of a notice: as long as they alone can't bring any template over the threshold, lines without
another template word can be passed over, which loses nothing.

Files without a licence of their own take that of the nearest directory above them that holds a licence file. The
directories, not the files, are joined with their ancestors, so the join is as large as the tree of directories.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.llm.common import map_arrow, quoted, text_chunks, written
from tracewarp.llm.license_words import WHOLE_TEXTS

THRESHOLD = 0.6
#: Cosine from which a text is a notice and nothing else.
WHOLE = 0.9
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
#: Base names of licence files.
LICENSE_FILE = r"(?i)^(un)?licen[cs]e([-_.].*)?$|^copying([-_.].*)?$|^notice([-_.].*)?$"

TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words(t))
#: Words that are counted over the corpus: those of the notices and of the whole licences.
COUNTED = VOCABULARY.union(*WHOLE_TEXTS.values())
#: Words of the longest template, and so the most lines with words that it can be wrapped into.
LONGEST = max(len(words(t)) for _, t in TEMPLATES)
#: Windows by their first lines that are bounded at a time.
STARTS = 256


class Model:
    """Weights of the words, and the templates as unit vectors."""

    def __init__(self, documents: int, df: dict[str, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.idf = {w: log((1 + documents) / (1 + df.get(w, 0))) + 1 for w in sorted(VOCABULARY)}
        self.other = sum(self.idf.values()) / len(self.idf)
        self.templates = []
        for name, t in TEMPLATES:
            v = {w: n * self.idf[w] for w, n in Counter(words(t)).items()}
            length = sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, {w: x / length for w, x in v.items()}))
        # Whole licences, in their own words and those of the notices.
        self.all_idf = {w: log((1 + documents) / (1 + df.get(w, 0))) + 1 for w in sorted(COUNTED)}
        self.all_other = sum(self.all_idf.values()) / len(self.all_idf)
        self.place = {w: i for i, w in enumerate(self.all_idf)}
        self.all_weights = np.array(list(self.all_idf.values()))
        self.names = sorted(WHOLE_TEXTS)
        self.licenses = np.array([[WHOLE_TEXTS[name].get(w, 0) for w in self.all_idf] for name in self.names]).T * self.all_weights[:, None]
        self.licenses /= np.sqrt((self.licenses**2).sum(0))
        # As below, for the licences: a text without any of the others is none of them.
        order = np.argsort(self.all_weights, kind="stable")
        mass = (self.licenses[order] ** 2).cumsum(0).max(1)
        words_ = list(self.all_idf)
        self.license_signs = frozenset(words_[i] for i in order[np.searchsorted(mass, WHOLE * WHOLE * 0.999) :])
        # Words of little weight, as many as together stay below the threshold in every template.
        left, weak = [threshold * threshold * 0.999] * len(self.templates), set()
        for w in sorted(self.idf, key=lambda w: (self.idf[w], w)):
            took = [x - t.get(w, 0.0) ** 2 for x, (_, t) in zip(left, self.templates)]
            if min(took) <= 0:
                break
            left, weak = took, weak | {w}
        self.signs = VOCABULARY - weak
        self.column = {w: i for i, w in enumerate(self.idf)}
        self.weights = np.array(list(self.idf.values()))
        self.matrix = np.array([[t.get(w, 0.0) for w in self.idf] for _, t in self.templates]).T

    def cosine(self, text: str) -> tuple[float, str]:
        """The largest cosine of the text with a template, and the template's licence; of equal ones the first by name."""
        counts = Counter(words(text))
        known = [(self.column[w], n) for w, n in counts.items() if w in self.column]
        if not known:
            return 0.0, ""
        at, n = (np.array(x) for x in zip(*known))
        v = n * self.weights[at]
        rest = sum(n * n for w, n in counts.items() if w not in self.column) * self.other**2
        found = np.round(v @ self.matrix[at] / np.sqrt((v * v).sum() + rest), 9)
        best = found.max()
        return float(best), min(self.templates[i][0] for i in np.flatnonzero(found == best))

    def header(self, text: str | None) -> tuple[float, str] | None:
        """The best licence of a line, sentence, run or window of lines that reaches the threshold."""
        if not text or self.signs.isdisjoint(words(text)):
            return None
        units, run, paragraph, found = set(), [], [], []
        for line in [*text.split("\n"), ""]:
            in_line = words(line)
            if in_line:
                paragraph.append(line)
                found.append(in_line)
            else:
                if len(paragraph) > 1:
                    units.update(s for s in SENTENCE.split(" ".join(paragraph)) if not self.signs.isdisjoint(words(s)))
                paragraph = []
            if self.signs.isdisjoint(in_line):
                if len(run) > 1:
                    units.add("\n".join(run))
                run = []
                continue
            run.append(line)
            units.add(line)
            units.update(s for s in SENTENCE.split(line) if not self.signs.isdisjoint(words(s)))
        return self._best([*(self.cosine(u) for u in units), *self._windows(found)])

    def _windows(self, lines: list[list[str]]) -> list[tuple[float, str]]:
        """The best cosines of windows of 2 to ``LONGEST`` of the lines (words of each) with a sign: those bounded below them are left out.

        A window's length is at least that of its words as if no word outside the vocabulary came twice. Windows that
        end in a line without a template word are worse than without it.
        """
        n = len(lines)
        sign = np.concatenate([[0], np.cumsum([not self.signs.isdisjoint(x) for x in lines])])
        some = np.array([not VOCABULARY.isdisjoint(x) for x in lines], bool)
        first = np.arange(n)
        starts = first[some & (sign[np.minimum(first + LONGEST, n)] > sign[:-1])]
        found, best = [], self.threshold
        breaks = np.flatnonzero(np.diff(starts) > LONGEST) + 1
        for near in np.split(starts, breaks):
            for at in range(0, len(near), STARTS):
                part = near[at : at + STARTS]
                low, high = int(part[0]), min(n, int(part[-1]) + LONGEST)
                count = np.zeros((high - low + 1, len(self.weights) + 1))
                for i, x in enumerate(lines[low:high], 1):
                    for w in x:
                        count[i, self.column.get(w, -1)] += 1
                count = count.cumsum(0)
                bounds = []
                for size in range(2, LONGEST + 1):
                    a = part[part + size <= n]
                    a = a[some[a + size - 1] & (sign[a + size] > sign[a])]
                    if len(a):
                        c = count[a + size - low] - count[a - low]
                        x = c[:, :-1] * self.weights
                        bound = (x @ self.matrix).max(1) / np.sqrt((x * x).sum(1) + c[:, -1] * self.other**2) + 1e-8
                        bounds += [(b, i, i + size) for b, i in zip(bound.tolist(), a.tolist()) if b >= best]
                for b, i, j in sorted(bounds, reverse=True):
                    if b < best:
                        break
                    found.append(self.cosine(" ".join(w for x in lines[i:j] for w in x)))
                    best = max(best, found[-1][0])
        return found

    def licence(self, text: str) -> tuple[float, str]:
        """The largest cosine of the text as a whole with a whole licence, and its name; of equal ones the first by name."""
        counts = Counter(words(text))
        known = [(self.place[w], n) for w, n in counts.items() if w in self.place]
        if not known:
            return 0.0, ""
        at, n = (np.array(x) for x in zip(*known))
        v = n * self.all_weights[at]
        rest = sum(n * n for w, n in counts.items() if w not in self.place) * self.all_other**2
        found = np.round(v @ self.licenses[at] / np.sqrt((v * v).sum() + rest), 9)
        best = int(found.argmax())
        return float(found[best]), self.names[best]

    def of(self, text: str | None) -> tuple[tuple[float, str] | None, bool]:
        """The text's licence with its score, and whether the text is a licence or notice and nothing else.

        A text that is as a whole a licence, to ``WHOLE``, is that, whatever notices it quotes.
        """
        if not text:
            return None, False
        has = set(words(text))
        if not self.license_signs.isdisjoint(has):
            full = self.licence(text)
            if full[0] >= WHOLE:
                return full, True
        if self.signs.isdisjoint(has):
            return None, False
        found = self.header(text)
        return found, bool(found) and self.whole(text)

    def whole(self, text: str | None) -> bool:
        return bool(text) and self.cosine(text)[0] >= WHOLE

    def _best(self, found) -> tuple[float, str] | None:
        fine = [f for f in found if f[0] >= self.threshold]
        return min(fine, key=lambda f: (-f[0], f[1])) if fine else None


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents that have a text, and in how many of them each template word occurs: one pass over all."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for b in it:
            for _, texts in text_chunks(b, 0, 2_000_000):
                for t in texts:
                    df[""] += 1
                    df.update(COUNTED.intersection(words(t)))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(df), pa.string()), "n": pa.array(list(df.values()), pa.int64())})

    src = docs.select(quoted(text_col).cast("string").alias("t")).where("t is not null")
    got = {r.w: r.n for r in map_arrow(src, run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


def own_licenses(files: DataFrame, model: Model, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """(id, path, license, score, whole): each file's licence by its lines, and whether its whole text is a notice."""
    src = files.select(quoted(id_col).cast("long").alias("id"), quoted(path_col).cast("string").alias("path"), quoted(text_col).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, texts in text_chunks(b, 2, 2_000_000):
                found, whole = zip(*(model.of(t) for t in texts))
                part = b.slice(at, len(texts))
                cols = [pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[0] for f in found], pa.float64()), pa.array(whole, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *cols], ["id", "path", "license", "score", "whole"])

    return map_arrow(src, run, "id long, path string, license string, score double, whole boolean")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, origin, inherited_from), a row for each file.

    ``origin`` is ``header`` or ``file`` for a licence found in the file itself (``file``: a licence file, by its base
    name or because its whole text is a notice), ``inherited`` for that of the nearest ancestor directory, named in
    ``inherited_from``, and ``none``. A directory with licence files of several licences passes on the one with the
    highest score, of equal ones the first by name. A file's own directory is its nearest; the root is "". Empty and
    null texts have no licence of their own; a null path has no ancestors. Slashes at the ends of a path, and double
    ones, don't count. Rows that repeat stay repeated. An empty table gives none. Other columns are left out.
    """
    model = Model(*document_frequencies(files, text_col), threshold)
    own = written(own_licenses(files, model, id_col, path_col, text_col), "licenses")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    own = own.withColumns({"base": base, "folder": F.when(F.col("path").isNotNull(), folder)})
    is_file = F.col("license").isNotNull() & (F.col("whole") | F.col("base").rlike(LICENSE_FILE))
    # Struct order: highest score first, then first name.
    given = own.where(is_file & F.col("folder").isNotNull()).groupBy(F.col("folder").alias("above")).agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    given = given.select("above", F.col("best.license").alias("passed"), (-F.col("best.col1")).alias("passed_score"))
    folders = own.where("license is null and folder is not null").select("folder").distinct()
    steps = F.filter(F.split("folder", "/"), lambda x: x != "")
    climbs = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))).alias("a"))
    nearest = climbs.select("folder", "a.depth", "a.above").join(given, "above").groupBy("folder").agg(F.max_by(F.struct("above", "passed", "passed_score"), "depth").alias("near"))
    out = own.join(nearest, "folder", "left")
    has, inherits = F.col("license").isNotNull(), F.col("license").isNull() & F.col("near").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        "path",
        F.coalesce("license", F.col("near.passed")).alias("license"),
        F.coalesce("score", F.col("near.passed_score")).alias("score"),
        F.when(has & is_file, "file").when(has, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("near.above")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) of documents as files of a folder for each source and, in it, language."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.col("doc_id").cast("string")).alias("path"), "text")
