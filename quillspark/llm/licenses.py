"""Licence scan: TF-IDF cosine of lines and whole texts to notices, then inheritance by path.

Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Their inverse
frequencies come from the lines of all texts. Each line and each window of a notice's length (a
header) and each whole text (a licence file) is held against every notice, a whole text against
the full licence texts of ``license_texts`` too; only terms of the notices can add to a product, so
vectors stay sparse. A document without a licence of its own takes that of the nearest
directory, from its own upwards, that holds a licence file.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .textkit import ALNUM, Words, slices, windows

THRESHOLD = 0.6
#: A text is a licence file if it is that much like a notice as a whole.
FILE_THRESHOLD = 0.5
#: Or that much like a full licence text, which shares its many common words with any long text.
TEXT_THRESHOLD = 0.8

# Customary short notices of well-known licences.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}


def full_texts() -> dict[str, list[str]]:
    """Full licence texts by name, without names of their holders."""
    return {p.stem: [p.read_text("utf-8")] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


class Templates:
    """Notices as vectors over their own terms; ``lines`` and ``counts`` are the corpus figures."""

    def __init__(self, notices: dict[str, list[str]], lines: int = 0, counts: dict[int, int] | None = None):
        self.names = [name for name, texts in sorted(notices.items()) for _ in texts]
        words = Words(pa.array([t for _, texts in sorted(notices.items()) for t in texts]), ALNUM)
        self.terms = np.unique(words.hash)
        held = np.array([(counts or {}).get(int(h), 0) for h in self.terms.view(np.int64)])
        self.rare = np.log(lines + 1.0) + 1
        self.idf = np.log((lines + 1) / (held + 1)) + 1
        self.sizes = np.diff(words.first).tolist()
        self.matrix = np.zeros((len(self.names), len(self.terms)))
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            np.add.at(self.matrix[k], np.searchsorted(self.terms, words.hash[a:b]), 1.0)
        self.matrix *= self.idf
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of those in the vocabulary, and their terms."""
        at = np.minimum(np.searchsorted(self.terms, words.hash), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words.hash)
        return hit, at[hit]

    def best(self, words: Words, group: np.ndarray, groups: int, threshold: float) -> list[tuple[int, str, float]]:
        """Groups of words (ascending ``group``) that are like a notice: group, name, cosine."""
        hit, term = self.find(words)
        weight = np.full(len(words.hash), self.rare)
        weight[hit] = self.idf[term]
        # With repeats a vector is longer than this, so its cosine is no larger than the bound.
        length = np.sqrt(np.maximum(np.bincount(group, weight**2, groups), 1e-12))
        bound = np.zeros(groups)
        for row in self.matrix:
            np.maximum(bound, np.bincount(group[hit], self.idf[term] * row[term], groups), out=bound)
        out = []
        first = np.searchsorted(group, np.arange(groups + 1))
        for g in np.flatnonzero(bound >= threshold * length).tolist():
            names, times = np.unique(words.hash[first[g] : first[g + 1]], return_counts=True)
            at = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
            known = self.terms[at] == names
            vector = times * np.where(known, self.idf[at], self.rare)
            cosine = (self.matrix[:, at[known]] @ vector[known]) / np.linalg.norm(vector)
            top = int(np.argmax(np.round(cosine, 9)))
            if cosine[top] >= threshold:
                out.append((g, self.names[top], float(min(cosine[top], 1.0))))
        return out


    def headers(self, words: Words, threshold: float) -> list[tuple[int, str, float]]:
        """Windows of words in one row, each as long as a notice, that are like it: first word, name,
        cosine. Lines don't bound them."""
        n = len(words.hash)
        row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        hit, term = self.find(words)
        weight = np.full(n, self.rare)
        weight[hit] = self.idf[term]
        length = np.concatenate([[0], np.cumsum(weight**2)])
        out = []
        for k, size in enumerate(self.sizes):
            if n < size or not size:
                continue
            product = np.zeros(n)
            product[hit] = self.idf[term] * self.matrix[k, term]
            total = np.concatenate([[0], np.cumsum(product)])
            like = total[size:] - total[:-size] >= threshold * np.sqrt(np.maximum(length[size:] - length[:-size], 0)) - 1e-6
            at = np.flatnonzero(like & (row[size - 1 :] == row[: n - size + 1]))
            if not len(at):
                continue
            known: dict[int, float] = {}
            for a, name in zip(at.tolist(), windows(words.hash, size)[at].tolist()):
                if name not in known:
                    _, first, times = np.unique(words.hash[a : a + size], return_index=True, return_counts=True)
                    known[name] = float(product[a : a + size].sum() / np.linalg.norm(times * weight[a : a + size][first]))
                if known[name] >= threshold:
                    out.append((a, self.names[k], min(known[name], 1.0)))
        return sorted(out)


def _lines(words: Words) -> tuple[np.ndarray, int, np.ndarray]:
    """Line number of each word (rows begin new lines), number of lines, row of each line."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    breaks = np.cumsum(words.buf == 0x0A)
    line = breaks[words.start] + row if len(row) else np.zeros(0, np.int64)
    names, at = np.unique(line, return_inverse=True)
    rows = np.zeros(len(names), np.int64)
    rows[at] = row
    return at, len(names), rows


def scan(docs: DataFrame, text_col: str = "text", notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with ``own_license``, ``own_score`` (null where no line and not the whole is like
    a notice), ``own_line`` (the text's best line or the first of its best window, counted from 0
    among lines with words; null for a whole; a full licence text goes before its lines) and ``is_license_file``. Null and empty texts have none. Ties go to the earlier
    line, then to the name that sorts first."""
    notices = notices or NOTICES
    texts_of = full_texts()
    vocabulary = Templates({"": [t for ts in (*notices.values(), *texts_of.values()) for t in ts]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, held = 0, np.zeros(len(vocabulary.terms), np.int64)
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), ALNUM)
            at, n, _ = _lines(words)
            lines += n
            hit, term = vocabulary.find(words)
            pairs = np.unique(at[hit] * len(vocabulary.terms) + term)
            held += np.bincount(pairs % len(vocabulary.terms), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(vocabulary.terms.view(np.int64), 0)), pa.array(np.append(held, lines))], ["term", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    lines = counts.pop(0, 0)
    sent = docs.sparkSession.sparkContext.broadcast((Templates(notices, lines, counts), Templates(texts_of, lines, counts)))
    fresh = ("own_license", "own_score", "own_line", "is_license_file")
    kept = [c for c in docs.columns if c not in fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, full = sent.value
        for batch in slices(batches, text_col):
            words = Words(batch.column(text_col), ALNUM)
            at, n, rows = _lines(words)
            base = np.searchsorted(rows, np.arange(batch.num_rows))
            best: list[tuple] = [(None, None, None)] * batch.num_rows
            for line, name, cosine in templates.best(words, at, n, THRESHOLD):
                row = int(rows[line])
                if best[row][1] is None or round(cosine, 9) > round(best[row][1], 9):
                    best[row] = (name, cosine, int(line - base[row]))
            whole = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            for first, name, cosine in templates.headers(words, THRESHOLD):
                row = int(whole[first])
                if best[row][1] is None or round(cosine, 9) > round(best[row][1], 9):
                    best[row] = (name, cosine, int(at[first] - base[row]))
            file = [False] * batch.num_rows
            for row, name, cosine in templates.best(words, whole, batch.num_rows, FILE_THRESHOLD):
                file[row] = True
                if best[row][1] is None:
                    best[row] = (name, cosine, None)
            for row, name, cosine in full.best(words, whole, batch.num_rows, TEXT_THRESHOLD):
                file[row], best[row] = True, (name, cosine, None)
            columns = [pa.array([b[k] for b in best], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns, pa.array(file)], [*kept, *fresh])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, f"{fields}, own_license string, own_score double, own_line long, is_license_file boolean")


#: Directories up to this many (of paths and names, some hundred bytes each) are sent to all tasks.
BROADCAST_DIRS = 20_000
SALTS = 32


def _looked_up(rows: DataFrame, nearest: DataFrame) -> DataFrame:
    """``rows`` beside ``nearest`` of their directory. One directory may hold most rows, so these are
    not dealt by directory: a small table is sent out, a larger one is joined in SALTS copies."""
    nearest = written(nearest, "licenses-nearest")
    if nearest.count() <= BROADCAST_DIRS:
        return rows.join(F.broadcast(nearest), "dir", "left")
    copies = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["dir", "salt"], "left").drop("salt")


def licensed(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, path, own_license, own_score, own_line, is_license_file, license, license_dir,
    license_up)`` of each row: the licence of its own or of the nearest directory with a
    licence file, that directory and how many levels up it is (0: its own directory; both null
    for an own licence).

    Of several licence files in a directory the one most like a notice counts, ties by name. A
    null path is the top directory "". Paths are joined by directory, each distinct one once.
    Repeated rows and ids are rows like any others; null and empty texts have no licence of their
    own; an empty table gives no rows. Other columns are not read.
    """
    found = written(scan(docs.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text")), "text").drop("text"), "licenses")
    rows = found.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))
    files = rows.where("is_license_file").groupBy("dir").agg(F.min(F.struct((-F.round("own_score", 9)).alias("s"), "own_license")).alias("f")).select(F.col("dir").alias("at"), F.col("f.own_license").alias("held"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    ups = F.explode(F.sequence(F.lit(0), depth)).alias("up")
    dirs = rows.select("dir").distinct().select("dir", depth.alias("depth"), ups).withColumn("at", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth") - F.col("up")), "/"))
    nearest = dirs.join(files, "at").groupBy("dir").agg(F.min(F.struct("up", "at", "held")).alias("n"))
    own = F.col("own_license").isNotNull()
    out = _looked_up(rows, nearest).select(
        F.col("id").alias(id_col), "path", "own_license", "own_score", "own_line", "is_license_file",
        F.coalesce("own_license", "n.held").alias("license"), F.when(~own, F.col("n.at")).alias("license_dir"), F.when(~own, F.col("n.up").cast("long")).alias("license_up"),
    )
    return out
