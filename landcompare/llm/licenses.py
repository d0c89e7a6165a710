"""License scan: TF-IDF cosine to templates, then nearest-ancestor inheritance, in DataFrame operations only.

Every line of a file (a header can stand anywhere), its whole text, and its runs of
neighbouring sentences, which end at line ends too, are compared with license templates:
so a notice may be wrapped, or stand among others on a line. Runs are as long as a text
near the longest template can be, and are built only where the whole text holds enough of
a template for any part of it to be near; they begin and end with a word of such a one. A text is the set of its words, each weighing its inverse document
frequency among the templates; words in no template weigh most, so prose that merely
shares common words stays far from every template. All of that is within a row, without
a shuffle; the templates are a short list.

A file that is a license as a whole, or is named like one, licenses its directory. A
file without a license of its own inherits that of the nearest directory above it: the
distinct directories are unfolded to their ancestors and joined by path, then the files
with their directories, so a directory with a third of all files is joined once.

Rows: null text counts as empty and has no license, a null path has no directory, null
ids stay, repeated rows each get their result, an empty table gives an empty result,
other columns are ignored. Of several templates near a file the one that shares most of its
weight with it counts, so a notice or title with its version goes before a short line, and
``LAST`` only where nothing else is near. Ties: the higher cosine, then the earlier line (the
whole text last), then the smaller name; a run counts as its first line; of several license files in a directory the smallest path.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import lower_ascii, stored, table

THRESHOLD = 0.75
LICENSE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"

# Notices and titles by which licenses are named in files, and telling parts of short licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License. Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    *[
        (f"GPL-{version}.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        f" the Free Software Foundation; either version {version} of the License, or (at your option) any later version.")
        for version in (1, 2, 3)
    ],
    ("GPL-1.0", "GNU General Public License. Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License. Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License. Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License. Version 2, June 1991"),
    (
        "LGPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by"
        " the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.1", "GNU Lesser General Public License. Version 2.1, February 1999"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by"
        " the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "GNU Lesser General Public License. Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License. Version 3, 19 November 2007"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    (
        "MPL-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in"
        " compliance with the License.",
    ),
    ("CC0-1.0", "Creative Commons Legal Code. CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved."),
]
LAST = "Proprietary"  # only where no license is near: its words stand in most license files


def words_in(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", text.lower())))


def weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """(inverse document frequency of the templates' words, that of any other word)."""
    n, df = len(templates), {}
    for _, text in templates:
        for word in words_in(text):
            df[word] = df.get(word, 0) + 1
    return {w: math.log((1 + n) / (1 + d)) + 1 for w, d in sorted(df.items())}, math.log(1 + n) + 1


SENTENCE_END = r"(?<=[.!?;:])[\x09\x0B-\x0D\x20]+"


def _words(text: Column) -> Column:
    """Distinct runs of a-z and 0-9, after lower-casing A-Z."""
    plain = F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "))
    return F.array_remove(F.array_distinct(F.split(plain, " ")), "")


def matches(rows: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """``rows`` with best and whole in place of text: structs (score, license, line) or null.

    ``best`` is of the best line, the text as a whole being line -1, ``whole`` of the whole text. Each step is a
    column of its own, so that nothing is computed twice.
    """
    idf, other = weights(templates)
    vocabulary = F.array(*map(F.lit, idf))
    squares = F.create_map(*[F.lit(x) for w, v in idf.items() for x in (w, v * v)])
    kinds = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, words_in(t))).alias("words"), F.lit(math.sqrt(sum(idf[w] ** 2 for w in words_in(t)))).alias("length"))
            for name, t in templates
        ]
    )
    end = 1 << 30  # the whole text's place among the lines

    def mass(words: Column) -> Column:
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + squares[w])

    def possible(words: Column) -> Column:
        # A part's cosine is at most the square root of the share of a template's mass that the text holds.
        return F.filter(kinds, lambda k: mass(F.array_intersect(words, k["words"])) >= ((threshold - 1e-6) * k["length"]) ** 2)

    longest = math.ceil(max((len(re.findall("[a-z0-9]+", t.lower())) for _, t in templates), default=0) / threshold**2)

    def sentences(text: Column, wanted: Column) -> Column:
        def of_line(line: Column, k: Column) -> Column:
            parts = F.transform(F.split(line, SENTENCE_END), _words)
            return F.transform(parts, lambda w: F.struct(w.alias("words"), F.arrays_overlap(w, wanted).alias("holds"), k.alias("line")))

        return F.filter(F.flatten(F.transform(F.split(text, "\n"), of_line)), lambda x: F.size(x["words"]) > 0)

    def runs(parts: Column, before: Column) -> Column:
        def from_(start: Column) -> Column:
            ends = F.sequence(start, F.least(start + longest, F.size(parts)))
            ends = F.filter(ends, lambda end: parts[end - 1]["holds"] & ((end == start) | (before[end] - before[start - 1] <= longest)))
            # Sliced before its words are taken: else all of the text's sentences are gone through at each end.
            return F.transform(ends, lambda end: known(F.array_distinct(F.flatten(F.slice(parts, start, end - start + 1)["words"])), parts[start - 1]["line"]))

        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda start: parts[start - 1]["holds"])
        return F.when(F.size(parts) > 0, F.flatten(F.transform(starts, from_)))

    def known(words: Column, line: Column) -> Column:
        return F.struct(F.array_intersect(words, vocabulary).alias("known"), F.size(words).alias("n"), line.alias("line"))

    def weighed(u: Column) -> Column:
        return F.struct(u["known"].alias("known"), mass(u["known"]).alias("mass"), ((u["n"] - F.size(u["known"])) * other**2).alias("rest"), u["line"].alias("line"))

    # A cosine is at most the square root of the share of known words' mass: what is below is left out unscored.
    def near(u: Column) -> Column:
        return u["mass"] >= (threshold - 1e-6) ** 2 * (u["mass"] + u["rest"])

    def scored(u: Column) -> Column:
        def one(k: Column) -> Column:
            shared = mass(F.array_intersect(u["known"], k["words"]))
            score = F.round(shared / (F.sqrt(u["mass"] + u["rest"]) * k["length"]), 6)
            last = (k["license"] == LAST).alias("last")
            return F.struct(last, (-F.round(shared, 6)).alias("less"), (-score).alias("lower"), u["line"].alias("line"), k["license"].alias("license"))

        return F.filter(F.transform(kinds, one), lambda s: s["lower"] <= -threshold)

    kept = [c for c in rows.columns if c != "text"]
    rows = rows.select(*kept, "text", F.transform(F.split("text", "\n"), _words).alias("words"))
    rows = rows.select(*kept, "text", "words", F.array_distinct(F.flatten("words")).alias("all_words"))
    rows = rows.select(*kept, "text", "words", "all_words", F.array_distinct(F.flatten(possible(F.col("all_words"))["words"])).alias("wanted"))
    parts = F.when(F.size("wanted") > 0, sentences(F.col("text"), F.col("wanted")))
    rows = rows.select(*kept, "words", "all_words", parts.alias("parts"))
    before = _sums_before(F.col("parts"), lambda x: F.size(x["words"]))
    rows = rows.select(*kept, "words", "all_words", "parts", before.alias("before"))
    rows = rows.select(*kept, "words", "all_words", runs(F.col("parts"), F.col("before")).alias("runs"))
    units = F.concat(F.transform("words", known), F.array(known(F.col("all_words"), F.lit(end))), F.coalesce("runs", F.array()))
    rows = rows.select(*kept, F.filter(units, lambda u: F.size(u["known"]) > 0).alias("units"))
    rows = rows.select(*kept, F.filter(F.transform("units", weighed), near).alias("units"))
    rows = rows.select(*kept, F.flatten(F.transform("units", scored)).alias("found"))
    rows = rows.select(*kept, "found", F.filter("found", lambda s: s["line"] == end).alias("of_whole"))
    return rows.select(*kept, _first("found", end).alias("best"), _first("of_whole", end).alias("whole"))


def _sums_before(parts: Column, size, chunk: int = 256) -> Column:
    """0, then the running sums of the parts' sizes; in chunks, as every step of a fold copies the array it grows."""

    def sums(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    places = F.sequence(F.lit(0), F.floor(F.size(parts) / chunk).cast("int"))
    chunks = F.transform(places, lambda k: sums(F.transform(F.slice(parts, k * chunk + 1, chunk), size)))
    starts = F.slice(sums(F.transform(chunks, lambda c: F.element_at(c, -1))), F.lit(1), F.size(places))
    # All but a full chunk's last sum, which is the next one's first.
    return F.flatten(F.zip_with(chunks, starts, lambda c, s: F.transform(F.slice(c, 1, chunk), lambda n: n + s)))


def _first(found: str, end: int) -> Column:
    """Most shared weight, then highest score, earliest line and smallest name."""
    best = F.array_min(found)
    line = F.when(best["line"] == end, -1).otherwise(best["line"])
    return F.when(F.size(found) > 0, F.struct((-best["lower"]).alias("score"), best["license"].alias("license"), line.alias("line")))


def folder_of(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, line, license_file, inherited, inherited_from, effective) of every (doc_id, path, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path"), text.alias("text"))
    rows = matches(rows, templates, threshold)
    named = F.coalesce(F.col("path").rlike(LICENSE_NAMES), F.lit(False))
    rows = rows.select(
        "doc_id",
        "path",
        F.col("best.license").alias("license"),
        F.col("best.score").alias("score"),
        F.col("best.line").alias("line"),
        (F.col("whole").isNotNull() | (named & F.col("best").isNotNull())).alias("license_file"),
        folder_of(F.col("path")).alias("folder"),
    )
    rows = stored(rows, "licenses")
    owners = rows.where("license_file AND folder IS NOT NULL").groupBy("folder").agg(F.min(F.struct("path", "license")).alias("owner"))
    owners = owners.select(F.col("folder").alias("ancestor"), F.col("owner.path").alias("inherited_from"), F.col("owner.license").alias("inherited"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.array_distinct(above))
    folders = rows.select("folder").where("folder IS NOT NULL").distinct().select("folder", F.explode(above).alias("ancestor"))
    nearest = folders.join(owners, "ancestor").groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "inherited", "inherited_from")).alias("up"))
    nearest = nearest.select("folder", F.col("up.inherited").alias("from_above"), F.col("up.inherited_from").alias("file_above"))
    nearest = stored(nearest, "license-folders")  # read plainly, so that Spark may split the join where a folder is hot
    own = F.col("license").isNotNull()
    found = rows.join(nearest, "folder", "left").withColumns({"inherited": F.when(~own, F.col("from_above")), "inherited_from": F.when(~own, F.col("file_above"))})
    return found.select("doc_id", "path", "license", "score", "line", "license_file", "inherited", "inherited_from", F.coalesce("license", "inherited").alias("effective"))


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: their source and language are the directories."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang", "doc_id")]
    return docs.select("doc_id", F.concat_ws("/", *part).alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(files_of(table(spark, sf_dir, "documents")))


def _in_sql() -> str:
    idf, other = weights(TEMPLATES)
    terms = ", ".join(f"('{w}', {v!r})" for w, v in idf.items())
    kinds = ", ".join(f"({k}, '{name}', {math.sqrt(sum(idf[w] ** 2 for w in words_in(t)))!r})" for k, (name, t) in enumerate(TEMPLATES))
    holds = ", ".join(f"({k}, '{w}')" for k, (_, t) in enumerate(TEMPLATES) for w in words_in(t))
    low = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "list_distinct(string_split(trim(regexp_replace(" + low + ", '[^a-z0-9]+', ' ', 'g')), ' '))"
    return f"""
WITH idf(word, idf) AS (VALUES {terms}), kinds(kind, license, length) AS (VALUES {kinds}), holds(kind, word) AS (VALUES {holds}),
files AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS folder,
  coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS path FROM documents),
units AS (
  SELECT r, k - 1 AS line, lines[k] AS t FROM (SELECT r, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM files)
  UNION ALL SELECT r, {1 << 30}, text FROM files),
words AS (SELECT r, line, unnest({words.format(t="t")}) AS word FROM units),
lengths AS (SELECT r, line, sqrt(sum(power(coalesce(idf, {other!r}), 2))) AS length FROM words LEFT JOIN idf USING (word) GROUP BY r, line),
dots AS (SELECT r, line, kind, sum(idf * idf) AS dot FROM words JOIN idf USING (word) JOIN holds USING (word) GROUP BY r, line, kind),
scores AS (SELECT r, line, license, round(dot, 6) AS shared, round(dot / (l.length * k.length), 6) AS score FROM dots JOIN lengths l USING (r, line) JOIN kinds k USING (kind)),
good AS (SELECT * FROM scores WHERE score >= {THRESHOLD}),
best AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY r ORDER BY license = '{LAST}', shared DESC, score DESC, line, license) = 1),
owners AS (SELECT folder, min(path) AS inherited_from, arg_min(license, path) AS inherited
  FROM files JOIN best USING (r) WHERE r IN (SELECT r FROM good WHERE line = {1 << 30}) GROUP BY folder),
above AS (SELECT folder, arg_max(inherited, length(o.folder)) AS inherited, arg_max(inherited_from, length(o.folder)) AS inherited_from
  FROM (SELECT DISTINCT folder FROM files) f JOIN (SELECT folder AS upper, inherited, inherited_from FROM owners) o ON f.folder = o.upper OR starts_with(f.folder, o.upper || '/') GROUP BY folder)
SELECT doc_id, path, b.license, score, CAST(CASE WHEN line = {1 << 30} THEN -1 ELSE line END AS INTEGER) AS line,
  r IN (SELECT r FROM good WHERE line = {1 << 30}) AS license_file,
  CASE WHEN b.license IS NULL THEN a.inherited END AS inherited, CASE WHEN b.license IS NULL THEN a.inherited_from END AS inherited_from,
  coalesce(b.license, a.inherited) AS effective
FROM files LEFT JOIN best b USING (r) LEFT JOIN above a USING (folder)"""


SQL = _in_sql().replace("length(o.folder)", "length(o.upper)")
