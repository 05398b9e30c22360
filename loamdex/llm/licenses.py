"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Units of a text are its lines, windows of its very long lines, and runs of neighbouring licence-like lines (a
wrapped header, or a whole licence file). A unit is licence-like if enough of its words are template terms.
Weights are tf * idf with document frequencies counted over all texts; words outside the templates weigh as
the rarest. A text takes the template with the highest cosine of any unit. A text without one inherits from
the licence file of its nearest ancestor directory, found by joins of directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.session import stored

WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9]+)*")
LEAST_COSINE, LIKE, LONG_LINE, WINDOW = 0.6, 0.5, 60, 32
#: Share of a text's words in licence-like units from which it is a licence file whatever its name.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)([.-].*)?$"

# Notices of common licences, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words_of(t))


class Matcher:
    """Cosines of units to the templates, under given document frequencies."""

    def __init__(self, frequency: dict[str, int], documents: int, templates: list[tuple[str, str]] = TEMPLATES):
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for w in VOCABULARY}
        self.rarest = math.log(1 + documents) + 1
        self.templates = []
        for name, text in templates:
            v = {w: n * self.idf.get(w, self.rarest) for w, n in Counter(words_of(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, {w: x / norm for w, x in v.items()}))

    def best(self, unit: list[str]) -> tuple[float, str | None]:
        v = {w: n * self.idf.get(w, self.rarest) for w, n in Counter(unit).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        found = [(sum(x * t.get(w, 0.0) for w, x in v.items()) / norm, name) for name, t in self.templates] if norm else []
        return max(found, key=lambda f: (f[0], f[1]), default=(0.0, None))

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """Best licence, its cosine, and the share of the text's words in licence-like units."""
        units, run, held, whole = [], [], 0, 0

        def close() -> None:
            if len(run) > 1:
                units.append([w for line in run for w in line])
            run.clear()

        for line in (text or "").split("\n"):
            words = words_of(line)
            whole += len(words)
            if len(words) > LONG_LINE:
                close()
                for at in range(0, len(words), WINDOW // 2):
                    part = words[at : at + WINDOW]
                    if sum(map(VOCABULARY.__contains__, part)) >= LIKE * len(part):
                        units.append(part)
                        held += min(WINDOW // 2, len(part))
            elif words and sum(map(VOCABULARY.__contains__, words)) >= LIKE * len(words):
                units.append(words)
                run.append(words)
                held += len(words)
            elif words:
                close()
        close()
        score, name = max((self.best(u) for u in units), default=(0.0, None), key=lambda f: f[0])
        share = held / whole if whole else 0.0
        return (name, score, share) if score >= LEAST_COSINE else (None, score, share)


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each template term stands, and the number of texts: a row a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts[""] += 1
                counts.update(VOCABULARY.intersection(words_of(t.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, own (SPDX name or null), score (best cosine), share of every row. Null texts are empty."""
    frequency, documents = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(frequency, documents)
        for b in batches:
            found = [matcher.scan(t.as_py()) for t in b.column(2)]
            name, score, share = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=["doc_id", "path", "own", "score", "share"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, path string, own string, score double, share double")


def directory(path: str) -> Column:
    """The directory of a path; "" for a path without one."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license, kind (licence_file, header, inherited or null) and inherited_from (a path).

    A licence file is named like one or is mostly licence text. The nearest directory wins, its own before
    those above; of several licence files in a directory, the one with the smallest path. Null paths inherit
    nothing. Directories are joined as distinct rows, so files of one directory cost the same as one.
    """
    is_file = F.col("own").isNotNull() & (F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAME), F.lit(False)) | (F.col("share") >= FILE_SHARE))
    marked = stored(scanned.withColumns({"dir": directory("path"), "is_file": is_file}), "licences")  # read three times below
    owners = marked.where("is_file and path is not null").groupBy("dir").agg(F.min(F.struct("path", "own")).alias("owner"))
    dirs = marked.where("own is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>")))).alias("ancestor"))
    nearest = (
        above.join(owners.select(F.col("dir").alias("ancestor"), "owner"), "ancestor")
        .groupBy("dir").agg(F.max_by("owner", F.struct(F.length("ancestor"), "ancestor")).alias("from_owner"))
    )
    out = marked.join(nearest, "dir", "left")
    heir = F.col("own").isNull() & F.col("from_owner").isNotNull()
    kind = F.when(F.col("is_file"), "licence_file").when(F.col("own").isNotNull(), "header").when(heir, "inherited")
    return out.select("doc_id", "path", F.coalesce("own", F.when(heir, F.col("from_owner.own"))).alias("license"), kind.alias("kind"), "score", F.when(heir, F.col("from_owner.path")).alias("inherited_from"))
