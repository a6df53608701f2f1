"""Licences of files: what a file states itself, or else what its directories state.

Passages that speak of a licence are compared with templates by the cosine of
their TF-IDF vectors. Beside whole lines, passages are windows that lie about a
hint as a template lies about its own and have as many words, so the words around
a notice do not weigh against it. An SPDX tag is taken as it stands. A file without a statement of its own inherits from the
nearest directory above it that has a licence file. Directories are joined, not
files, and paths are joined by equality with each of their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from argloom.session import materialize

# How licences are named in notices, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("ISC", "Released under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Released under the Creative Commons CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("proprietary", "Copyright. All rights reserved"),
]
# Words of a hint may stand in lines that follow each other, with comment marks between.
_HINT = r"(?i)licen[sc]e|spdx|all rights reserved|permission is hereby granted|redistribution and use|public domain".replace(" ", r"\W{1,9}")
_LONG = 400  # longer lines are read through windows around each hint
_WINDOW = rf"(?s).{{0,40}}(?:{_HINT}).{{0,90}}"
_REACH = 400  # characters on either side of a hint from which windows take their words
_HINTS = re.compile(_HINT, re.ASCII)
_GAP = re.compile(r"[^\w.]+|_|\.(?!\d)")
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?\)*"
_TAG = rf"(?i)SPDX-License-Identifier:[\x20\t]*({_ID}(?:[\x20\t]+(?-i:AND|OR|WITH)[\x20\t]+{_ID})*)"


def passages(text: Column) -> Column:
    """Lines of the whole text that speak of a licence; of very long lines, the part around each hint."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(_HINT))
    cut = F.transform(
        lines,
        lambda line: F.when(F.length(line) <= _LONG, F.array(line)).otherwise(
            F.regexp_extract_all(line, F.lit(_WINDOW), F.lit(0))
        ),
    )
    return F.when(text.rlike(_HINT), F.flatten(cut)).otherwise(F.array().cast("array<string>"))


def _words(text: str) -> list[str]:
    return [w for w in _GAP.split(text.lower()) if w]


def _counts(words: list[str]) -> Counter:
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


class Windows:
    """For a text, the window around a hint that is most like a template."""

    def __init__(self, templates: list[tuple[str, str]]):
        spoken = [(name, _words(notice), notice) for name, notice in templates]
        known = Counter(t for _, words, _ in spoken for t in set(_counts(words)))
        self.unknown = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in known.items()}
        # How many words a template has, and how many of them before a hint.
        self.shapes = sorted({(len(_words(notice[: m.start()])), len(words)) for _, words, notice in spoken for m in _HINTS.finditer(notice)})
        self.of_term = defaultdict(list)
        for k, (_, words, _) in enumerate(spoken):
            vector = self._vector(words)
            for term, weight in vector.items():
                self.of_term[term].append((k, weight))

    def _vector(self, words: list[str]) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf.get(t, self.unknown) for t, n in _counts(words).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    def _cosine(self, words: list[str]) -> float:
        dots = defaultdict(float)
        for term, weight in self._vector(words).items():
            for k, other in self.of_term.get(term, ()):
                dots[k] += weight * other
        return max(dots.values(), default=0.0)

    def best(self, text: str) -> str | None:
        """Lines do not end a window: notices are wrapped, and comment marks are no words."""
        most, found, seen = 0.0, None, set()
        for m in _HINTS.finditer(text):
            at = m.start()
            while at and m.start() - at < _REACH and text[at - 1].isalnum():
                at -= 1
            before, after = _words(text[max(0, at - _REACH) : at]), _words(text[at : m.end() + _REACH])
            for lead, size in self.shapes:
                window = tuple(before[max(0, len(before) - lead) :] + after[: size - lead])
                if hash(window) in seen:
                    continue
                seen.add(hash(window))
                cosine = self._cosine(window)
                if cosine > most:
                    most, found = cosine, " ".join(window)
        return found


def closest_window(text: Column, templates: list[tuple[str, str]]) -> Column:
    """The best window of every text with a hint; null for the others, which are not handed to Python."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        windows = Windows(templates)
        return pa.array([windows.best(t.as_py()) if t.is_valid else None for t in texts], pa.string())

    return run(F.when(text.rlike(_HINT), text))


def tagged(text: Column, templates: list[tuple[str, str]]) -> Column:
    """What SPDX tags state, in the templates' names where these have one; null without a tag.

    "only" and "or later" are left off, as in the templates. Tags that differ all hold.
    """
    plain = F.regexp_replace(F.concat_ws("\n", F.regexp_extract_all(text, F.lit(_TAG), F.lit(1))), r"(?i)-only(?![\w.-])|-or-later(?![\w.-])|\+", "")
    for name in sorted({name for name, _ in templates}):
        plain = F.regexp_replace(plain, rf"(?i)(?<![\w.-]){re.escape(name)}(?![\w.-])", name)
    each = F.array_distinct(F.split(F.regexp_replace(plain, r"[\x20\t]+", " "), "\n"))
    each = F.filter(each, lambda e: (e != "") & ~F.upper(e).isin("NONE", "NOASSERTION"))
    joined = F.array_join(F.transform(each, lambda e: F.when(e.rlike("(?i) or ") & (F.size(each) > 1), F.concat(F.lit("("), e, F.lit(")"))).otherwise(e)), " AND ")
    return F.when(text.rlike("(?i)spdx") & (joined != ""), joined)


def terms(text: Column) -> Column:
    """Words and numbers in lower case, and each with its successor."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda w: w != "")
    pairs = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.concat(words, F.filter(pairs, lambda p: p.contains(" ")))


def _damped(tf: str) -> Column:
    """Term frequencies on a logarithmic scale, so that repetition around a notice does not drown it."""
    return 1 + F.ln(tf)


def _template_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``license, template, term, idf, weight``: unit vectors; the table has the templates' size."""
    rows = spark.createDataFrame([(k, *row) for k, row in enumerate(templates)], "template int, license string, notice string")
    each = rows.select("template", "license", F.explode(terms(F.col("notice"))).alias("term"))
    counts = each.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("term").agg((F.log((1 + F.lit(len(templates))) / (1 + F.countDistinct("template"))) + 1).alias("idf"))
    weighted = counts.join(idf, "term").withColumn("weight", _damped("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template")))
    return weighted.select("template", "license", "term", "idf", (F.col("weight") / norm).alias("weight"))


def best_templates(found: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """``row, license, cosine`` of the best passage of every row of ``row, passage``, if it reaches ``least``."""
    weights = F.broadcast(_template_weights(found.sparkSession, templates))
    unknown = math.log(1 + len(templates)) + 1
    each = found.withColumn("place", F.monotonically_increasing_id()).select("row", "place", F.explode(terms(F.col("passage"))).alias("term"))
    counts = each.groupBy("row", "place", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(weights.select("term", "idf").distinct())
    weighted = counts.join(idf, "term", "left").withColumn("w", _damped("tf") * F.coalesce("idf", F.lit(unknown))).drop("idf")
    norms = weighted.groupBy("row", "place").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(weights, "term").groupBy("row", "place", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["row", "place"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.where(F.col("cosine") >= least).groupBy("row").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", "license")).alias("b"))
    return best.select("row", "b.license", "b.cosine")


def directory(path: Column) -> Column:
    """The path without its last part; empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, with the top as the empty path."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(
    df: DataFrame,
    path: Column,
    is_license_file: Column,
    key: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = 0.5,
) -> DataFrame:
    """``key, license, origin, cosine, directory`` of every row.

    A statement is what SPDX tags say, with a cosine of 1, or else the best
    template. ``origin`` is ``header`` for a statement in the file itself, ``file`` for a
    licence file, ``inherited`` with the ``directory`` that it comes from, or
    ``none``. Of several licence files in a directory the one with the largest
    cosine counts, then the last identifier in order. Null text has no
    statement; a null path is a file at the top; rows with equal keys or paths
    are separate files. An empty table gives an empty result.
    """
    content = F.col(text).cast("string")
    rows = df.select(
        F.col(key).alias("_key"),
        directory(F.coalesce(path.cast("string"), F.lit(""))).alias("folder"),
        F.coalesce(is_license_file, F.lit(False)).alias("is_file"),
        passages(content).alias("_lines"),
        closest_window(content, templates).alias("_window"),
        tagged(content, templates).alias("tag"),
    )
    lines = F.when(F.col("_window").isNull(), F.col("_lines")).otherwise(F.array_append("_lines", F.col("_window")))
    rows = rows.withColumn("passages", lines).drop("_lines", "_window")
    # Written once: row numbers must not change if a lost executor's work is repeated.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "licences")
    spoken = materialize(rows.where(F.size("passages") > 0).select("row", F.explode("passages").alias("passage")), "passages")
    own = materialize(best_templates(spoken, templates, least), "stated")
    stated = rows.where(F.size("passages") > 0).join(own, "row", "left")
    stated = stated.withColumn("license", F.coalesce("tag", "license")).withColumn("cosine", F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("cosine")))
    files = stated.where("is_file AND license IS NOT NULL").groupBy("folder").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", "license")).alias("f"))
    files = files.select(F.col("folder").alias("_above"), "f.*")
    folders = rows.select("folder").distinct()
    above = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("depth", "_above")).join(files, "_above")
    nearest = above.groupBy("folder").agg(F.max_by(F.struct("_above", "license"), "depth").alias("n"))
    nearest = nearest.select("folder", F.col("n._above").alias("directory"), F.col("n.license").alias("inherited"))
    silent = rows.where(F.size("passages") == 0).select("_key", "folder", "is_file", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("cosine"))
    everything = stated.select("_key", "folder", "is_file", "license", "cosine").unionByName(silent).join(nearest, "folder", "left")
    origin = F.when(F.col("license").isNotNull() & F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    everything = everything.withColumn("origin", origin)
    return everything.select(
        F.col("_key").alias(key),
        F.coalesce("license", "inherited").alias("license"),
        "origin",
        "cosine",
        F.when(F.col("origin") == "inherited", F.col("directory")).alias("directory"),
    )
