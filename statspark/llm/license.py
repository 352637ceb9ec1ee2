"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A licence file (by name) is first compared, whole, with the real licence texts in
``license_texts`` as sparse TF-IDF vectors of words; at or above ``FILE_LEAST`` the
best text is its licence. Texts of one family differ by a clause, so ``FAMILIES``
settles the member. Otherwise SPDX identifiers are read as they are, then
overlapping runs of lines (one to three), the places where licence headers stand,
are compared with the header templates; a run takes part if it holds a trigger word
and has the words its licence cannot do without (``MARKS``). Document frequencies are
those of the templates. The best template at or above ``least`` is the file's own
licence. A licence file's licence also holds for its directory; a file without its own
takes that of the nearest ancestor directory that has one, by an equi-join on the
ancestors of its path.

Defined cases: a null path is in no directory; a null or empty text has no licence
of its own; of several SPDX identifiers the first known one counts, and an unknown one
gives none; of several licences of one directory the best score wins, then the
name; repeated rows are judged each; an empty table gives an empty result; an
existing column of a result's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, with_arrow_columns

LEAST = 0.6
#: Least cosine of a whole file to a licence text.
FILE_LEAST = 0.8

# Short licence headers by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License",
    "BSD-2-Clause": "Released under the BSD 2-Clause License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Released under the ISC License",
    "Unlicense": "This is free and unencumbered software released into the public domain. Unlicense",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
}
_NOTICE = "can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
#: Titles of licence files and the notices the GNU licences ask for.
HEADERS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "MIT": ["The MIT License (MIT)"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _NOTICE.format("General Public License", "3")],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _NOTICE.format("General Public License", "2")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _NOTICE.format("Lesser General Public License", "3")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _NOTICE.format("Lesser General Public License", "2.1")],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _NOTICE.format("Affero General Public License", "3")],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
}
#: Words a header must (first) and must not (second) hold to be of a licence whose kin read alike.
MARKS = {
    "GPL-3.0": (r"(?i)\bv?3(\.0)?\b", r"(?i)\b(lesser|library|affero)\b"),
    "GPL-2.0": (r"(?i)\bv?2(\.0)?\b(?!\.)", r"(?i)\b(lesser|library|affero)\b"),
    "LGPL-3.0": (r"(?i)\blesser\b[\s\S]*\bv?3(\.0)?\b", r"(?i)\baffero\b"),
    "LGPL-2.1": (r"(?i)\blesser\b[\s\S]*\bv?2\.1\b", r"(?i)\baffero\b"),
    "AGPL-3.0": (r"(?i)\baffero\b[\s\S]*\bv?3(\.0)?\b", r"(?i)\blesser\b"),
    "Apache-2.0": (r"", r"(?i)version 1\."),
    "MPL-2.0": (r"2(\.0)?\b", r"(?!)"),
    "CC-BY-4.0": (r"4\.0", r"(?i)share\s?-?alike|non-?commercial|no-?deriv|\bby-"),
    "CC-BY-SA-4.0": (r"(?i)share\s?-?alike|\bby-sa\b", r"(?i)non-?commercial|\bby-nc"),
    "CC-BY-NC-4.0": (r"(?i)non-?commercial|\bby-nc\b", r"(?i)share\s?-?alike|no-?deriv|\bby-nc-"),
}
#: Members of a family by a pattern of the text, where the best text is the family's; the first that is found counts, None is no licence known here.
FAMILIES: dict[str, list[tuple[str, str | None]]] = {
    "GPL-3.0": [(r"remote network interaction|\A\s*gnu affero general public license", "AGPL-3.0")],
    "MIT": [(r"(above )?copyright notice and this permission notice", "MIT"), (r"", None)],
    "ISC": [(r"provided that the above copyright notice", "ISC"), (r"", None)],
    "BSD-3-Clause": [(r"advertising materials mentioning", None), (r"neither the names?\b|endorse or promote", "BSD-3-Clause"), (r"", "BSD-2-Clause")],
    "CC-BY-SA-4.0": [(r"noderiv", None), (r"sharealike[\s\S]*noncommercial|noncommercial[\s\S]*sharealike", None), (r"noncommercial", "CC-BY-NC-4.0"), (r"sharealike", "CC-BY-SA-4.0"), (r"", "CC-BY-4.0")],
}
SPDX = re.compile(r"(?i)SPDX-License-Identifier:\s*([^\n]*)")
TRIGGERS = r"(?i)licen[sc]e|licen[sc]ed|copyright|public domain|spdx|creative commons|redistribution"
LICENCE_FILE = r"(?i)(^|/)((?:un)?licen[sc]e|copying|notice)([._-][^/]*)?$"
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_TRIGGER = re.compile(TRIGGERS)
_HOLDER = re.compile(r"(?i)\s*(copyright\b|\(c\)|\u00a9).{0,200}$")


class Templates:
    """TF-IDF vectors of the templates, one or more a licence; unseen words weigh as the rarest do."""

    def __init__(self, templates: dict[str, str | list[str]]) -> None:
        flat = [(n, t) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]
        self.names = [n for n, _ in flat]
        words = [Counter(_WORD.findall(t.lower())) for _, t in flat]
        seen = Counter(w for c in words for w in c)
        total = len(words)
        self.idf = {w: np.log((1 + total) / (1 + n)) + 1 for w, n in seen.items()}
        self.unseen = float(np.log(1 + total) + 1)
        self.vectors: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(words):
            length = np.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items())) or 1.0
            for w, n in c.items():
                self.vectors.setdefault(w, []).append((k, n * self.idf[w] / length))

    def best(self, text: str, marks: dict[str, tuple[str, str]] | None = None) -> tuple[str | None, float]:
        """The nearest template's name whose marks the text has, and the cosine."""
        found = Counter(_WORD.findall(text.lower()))
        if not found or not self.names:
            return None, 0.0
        sums = np.zeros(len(self.names))
        square = 0.0
        for w, n in found.items():
            weight = n * self.idf.get(w, self.unseen)
            square += weight * weight
            for k, v in self.vectors.get(w, ()):
                sums[k] += weight * v
        for k in np.argsort(-sums, kind="stable"):
            must, never = (marks or {}).get(self.names[k], ("", "(?!)"))
            if re.search(must, text) and not re.search(never, text):
                return self.names[k], float(sums[k] / np.sqrt(square))
        return None, 0.0


def license_texts() -> dict[str, str]:
    """The licence texts by name."""
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}


@cache
def texts() -> Templates:
    return Templates(license_texts())


@cache
def headers() -> Templates:
    return Templates({n: [t, *HEADERS.get(n, [])] for n, t in TEMPLATES.items()} | {n: t for n, t in HEADERS.items() if n not in TEMPLATES})


def whole_text(texts: Templates, text: str) -> tuple[str | None, float]:
    """Licence and score of a licence file by its whole text, without the lines of the holders."""
    body = "\n".join(line for line in text.split("\n") if not _HOLDER.match(line))
    name, score = texts.best(body)
    if name is None or score < FILE_LEAST:
        return None, score
    for pattern, member in FAMILIES.get(name, ()):
        if re.search(pattern, re.sub(r"\s+", " ", text.lower())):
            return member, score
    return name, score


def spdx(text: str, names: set[str]) -> str | None:
    """The first known licence of the SPDX identifiers of a text; ``-only``, ``-or-later`` and ``+`` are left out."""
    known = {n.lower(): n for n in names}
    for found in SPDX.finditer(text):
        for word in re.findall(r"[A-Za-z0-9.+-]+", found.group(1)):
            name = known.get(re.sub(r"(-only|-or-later|\+)$", "", word.lower()).rstrip("."))
            if name:
                return name
    return None


def runs_of_lines(text: str) -> list[str]:
    """Runs of up to three lines whose first or last holds a trigger; the text around is left out."""
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if _TRIGGER.search(line)]
    runs = []
    for i in hits:
        for a in range(max(0, i - 1), i + 1):
            for b in range(i + 1, min(len(lines), i + 2) + 1):
                runs.append("\n".join(lines[a:b]))
        runs.extend(part for part in re.split(r"(?<=[.!?;])\s+", lines[i]) if _TRIGGER.search(part))
    return runs


def judge_text(templates: Templates, text: str | None, whole: bool, least: float = LEAST, texts: Templates | None = None) -> tuple[str | None, float, str]:
    """Licence, score and place (file, header or none) of one text."""
    if not text or not _TRIGGER.search(text):
        return None, 0.0, "none"
    if whole and texts is not None:
        name, score = whole_text(texts, text)
        if name is not None:
            return name, score, "file"
    if "spdx" in text.lower():
        name = spdx(text, {*templates.names, *(texts.names if texts is not None else ())})
        if name is not None:
            return name, 1.0, "header"
        text = SPDX.sub("", text)
    best: tuple[str | None, float, str] = (None, 0.0, "none")
    for run in runs_of_lines(text):
        name, score = templates.best(run, MARKS)
        if score > best[1]:
            best = name, score, "header"
    if whole:
        name, score = templates.best(text, MARKS)
        if score >= best[1]:
            best = name, score, "file"
    return best if best[1] >= least else (None, round(best[1], 6), "none")


def own_licences(spark: SparkSession, files: DataFrame, text: str = "text", path: str = "path", templates: dict[str, str | list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """``files`` with ``license``, ``license_score`` and ``found_in`` from each file's own text; ``templates`` given replace all headers and texts."""
    shared = spark.sparkContext.broadcast((headers(), texts()) if templates is None else (Templates(templates), None))
    named = re.compile(LICENCE_FILE)

    def make(batch: pa.RecordBatch) -> list:
        own, whole = shared.value
        paths = batch.column(path).to_pylist()
        found = [judge_text(own, t, bool(p and named.search(p)), least, whole) for t, p in zip(batch.column(text).to_pylist(), paths, strict=True)]
        return [list(x) for x in zip(*found, strict=True)] if found else [[], [], []]

    fields = [T.StructField("license", T.StringType()), T.StructField("license_score", T.DoubleType()), T.StructField("found_in", T.StringType())]
    return with_arrow_columns(files, text, fields, make)


def directory_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors_of(path: Column) -> Column:
    """The directories above a path, the nearest first, up to the root (an empty name)."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    return F.when(path.isNotNull(), F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(parts, 1, depth - i), "/")))


def inherit(judged: DataFrame, path: str = "path") -> DataFrame:
    """Fill a missing licence from the nearest ancestor directory with a licence file; ``found_in`` is then ``inherited``."""
    judged = settled(judged.withColumn("__row", F.monotonically_increasing_id()))
    rows = judged
    of_directory = judged.where(F.col("license").isNotNull() & F.col(path).rlike(LICENCE_FILE)).groupBy(directory_of(F.col(path)).alias("__dir"))
    of_directory = of_directory.agg(F.max(F.struct("license_score", "license")).alias("__of"))
    wanted = rows.where(F.col("license").isNull() & F.col(path).isNotNull()).select("__row", F.posexplode(ancestors_of(F.col(path))).alias("__far", "__dir"))
    nearest = wanted.join(of_directory, "__dir").groupBy("__row").agg(F.min_by("__of", "__far").alias("__of"))
    joined = rows.join(nearest, "__row", "left")
    own = F.col("license").isNotNull()
    return joined.withColumns({
        "found_in": F.when(own, F.col("found_in")).when(F.col("__of").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")),
        "license_score": F.when(own | F.col("__of").isNull(), F.col("license_score")).otherwise(F.col("__of.license_score")),
        "license": F.coalesce("license", "__of.license"),
    }).drop("__row", "__of")
