"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Each line of a file, each run of two to four lines and the whole file are compared
with the statements of ``TEMPLATES``, and the whole file with the full licence texts
in ``licenses/``, by the cosine of their sparse TF-IDF vectors; the document
frequencies are counted over all files. What is compared holds an anchor, a template
term that is no everyday word; how many files hold the term does not matter. A file
that is a licence text has that licence; else the best statement counts, and
``Proprietary`` only if no other does. A file whose licence words make up a given
share of it (all, if it is a licence text) speaks for its directory; a file without a
licence of its own takes that of its nearest ancestor directory, by joins on paths.

Defined results: a null or empty text has no licence of its own; a null path has no
directory and inherits nothing; ties go to the template that is named first, and
among files of a directory to the best score, then the least path; repeated rows
are judged alike; files of any length are read whole; an empty table gives an empty
table; other columns pass through, and columns that have a result's name (``own``,
``license``, ``inherited_from``, ``inherited_depth``) give way to it.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Statements by which files name their licence, under the licences' public identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0 ": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT ": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 ": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2.",
    "GPL-2.0 ": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 ": "Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "Proprietary": "Copyright. All rights reserved.",
}

_TERM = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")

FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType())])


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


#: Lines that a statement may run over.
LINES = 4


def full_texts() -> dict[str, str]:
    """The full texts of licences, under their public identifiers."""
    names = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]
    return {n: pkgutil.get_data("lodestone.llm", f"licenses/{n}.txt").decode() for n in names}


def telling(templates: dict[str, str]) -> dict[str, str]:
    """The templates without everyday words."""
    return {n: b" ".join(t for t in terms(x.encode()) if t not in EVERYDAY).decode() for n, x in templates.items()}


#: Words and figures that tell no licence by themselves.
EVERYDAY = frozenset("a all any are as be by except file for from in is it may not obtaining of on or other person program software subject terms that the this to under use version with without work you your".encode().split()) | frozenset(
    b"and can copy copyright deal form forms free into international license licensed licenses released source universal domain v".split()
)

#: Further words of statements that are common in prose, so that no line is compared for their sake alone.
COMMON = frozenset(b"at either foundation later library modify option published redistribute".split())


class Matcher:
    """Templates as unit vectors in an inverted index."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], files: int, rare: float = 0.1):
        # rare once bounded how many files may hold an anchor; callers may still give it
        counted = [Counter(terms(t.encode())) for t in templates.values()]
        vocabulary = sorted(set().union(*counted))
        self.names = [n.strip() for n in templates]
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
        self.unknown = math.log(1 + files) + 1
        self.anchors = {t for t in vocabulary if t not in EVERYDAY and t not in COMMON and not re.fullmatch(rb"[0-9.-]+", t)}
        self.anchors |= {t for c in counted if self.anchors.isdisjoint(c) for t in c}
        self.index: dict[bytes, list[tuple[int, float]]] = {t: [] for t in vocabulary}
        for i, counts in enumerate(counted):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in counts.items()))
            for t, n in counts.items():
                self.index[t].append((i, n * self.idf[t] / norm))

    def best(self, words: list[bytes]) -> tuple[float, int] | None:
        counts = Counter(words)
        if self.anchors.isdisjoint(counts):
            return None
        dots = [0.0] * len(self.names)
        square = 0.0
        for t, n in counts.items():
            weight = n * self.idf.get(t, self.unknown)
            square += weight * weight
            for i, w in self.index.get(t, ()):
                dots[i] += weight * w
        top = max(range(len(dots)), key=lambda i: (dots[i], -i))
        return (dots[top] / math.sqrt(square), -top) if dots[top] > 0 else None

    def scan(self, text: bytes, threshold: float, texts: Matcher | None = None, whole_threshold: float = 0.75) -> tuple[str | None, float | None, float | None]:
        lines = [x for x in map(terms, text.split(b"\n")) if x]
        whole = [t for x in lines for t in x]
        # by other than everyday words, which any two long texts share
        match = texts.best([t for t in whole if t not in EVERYDAY]) if texts else None
        if match and match[0] >= whole_threshold:
            return texts.names[-match[1]], match[0], 1.0
        found: dict[bool, tuple[float, int, int]] = {}

        def take(words: list[bytes]) -> None:
            match = self.best(words)
            if match and match[0] >= threshold:
                named = self.names[-match[1]] != "Proprietary"
                if named not in found or match > found[named][:2]:
                    found[named] = (*match, len(words))

        told = [not self.anchors.isdisjoint(x) for x in lines]
        for at in range(len(lines)):
            if told[at]:
                take(lines[at])
            for n in range(2, min(LINES, len(lines) - at) + 1):
                if any(told[at : at + n]):
                    take([t for x in lines[at : at + n] for t in x])
        if any(told) and len(lines) > LINES:
            take(whole)
        best = found.get(True) or found.get(False)
        return (self.names[-best[1]], best[0], best[2] / len(whole)) if best else (None, None, None)


def own_licenses(files: DataFrame, text: str, templates: dict[str, str] = TEMPLATES, threshold: float = 0.6, rare: float = 0.1, out: str = "own") -> DataFrame:
    """files with one struct column more, named out: license, score and share of the words; nulls if none."""
    common.small_batches(files.sparkSession)
    whole = telling(full_texts())
    vocabulary = {t for x in [*templates.values(), *whole.values()] for t in terms(x.encode())}
    body = common.as_bytes(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            for value in common.binaries(batch.column(0)):
                counts.update(vocabulary.intersection(terms(value)))
        rows = [(b"", seen), *counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["term", "n"])

    # at most one row for each term of the templates comes to the driver
    found = {bytes(r["term"]): r["n"] for r in files.select(body.alias("t")).mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(b"", 0)
    matchers = files.sparkSession.sparkContext.broadcast((Matcher(templates, found, n, rare), Matcher(whole, found, n, rare)))
    kind = pa.struct([("license", pa.string()), ("score", pa.float64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lines, whole = matchers.value
            rows = [lines.scan(x, threshold, whole) for x in common.binaries(texts)]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    return files.withColumn(out, F.arrow_udf(run, FOUND)(body))


def inherit(files: DataFrame, path: str, own: str = "own", speaks: float = 0.15) -> DataFrame:
    """files with three columns more: license (own or inherited), inherited_from (a directory or null) and its depth.

    Directories, not files, meet the ancestors, so a directory that a third of all
    files share is one row in the ascent; the way back is a join that splits it.
    """
    folder, above = common.fresh(files, stem="__folder"), common.fresh(files, stem="__above")
    split = F.split(F.col(path), "/")
    placed = files.withColumn(folder, F.array_join(F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0))), "/"))
    spoken = placed.where(F.col(f"{own}.share") >= speaks).where(F.col(path).isNotNull())
    ruled = spoken.groupBy(F.col(folder).alias("above")).agg(F.min(F.struct((-F.col(f"{own}.score")).alias("s"), F.col(path).alias("p"), F.col(f"{own}.license").alias("l"))).alias("best"))
    ruled = ruled.select("above", F.col("best.l").alias("theirs"))
    folders = placed.where(F.col(path).isNotNull()).select(folder).distinct()
    parts = F.split(F.col(folder), "/")
    ascent = folders.select(folder, F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))).alias("x"))
    ascent = ascent.select(folder, "x.depth", "x.above").distinct()
    nearest = ascent.join(ruled, "above").groupBy(folder).agg(F.max(F.struct("depth", "above", "theirs")).alias(above))
    mine = F.col(f"{own}.license")
    joined = placed.join(nearest, folder, "left")
    return joined.withColumns({
        "license": F.coalesce(mine, F.col(f"{above}.theirs")),
        "inherited_from": F.when(mine.isNull(), F.col(f"{above}.above")),
        "inherited_depth": F.when(mine.isNull(), F.col(f"{above}.depth")).cast("long"),
    }).drop(folder, above)
