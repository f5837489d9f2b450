"""Licence scan: TF-IDF cosine of lines and licence files to templates, then inheritance.

Every line of every text is a possible header, and a licence file (by its name) also counts as
a whole. Terms are runs of a-z and 0-9, A-Z in lower case; a term's weight is its count times
ln((1 + T) / (1 + t)) + 1, for t of the T templates that hold it, so words of no template only
lengthen a line's vector. The best template of at least ``LEAST`` cosine is the file's own
licence (ties: the lesser licence name).

A file without one inherits from the nearest directory above it, its own included, that has a
licence file with a licence (of several the best, then the lesser name). Directories, not
files, look for their ancestors, and top directories are joined under salted keys, so a source
that holds a third of all files is one row.

A line can only reach ``LEAST`` if it holds terms that carry ``LEAST`` squared of a template's
weight (Cauchy), so lines without any of the heavier key terms are left out beforehand; that
loses nothing. A file is scored inside its row by array functions: no row numbers are needed, no
terms are shuffled, and the result does not depend on where the rows come from. Built-in
functions only.

Null and empty texts have no licence of their own; a null path is a file in no directory and
inherits nothing. Repeated rows stay, one row each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.6
#: Keys that a top directory's licence is spread over.
SALT = 64

# --- fixed values: public licence names, header wordings and file names -----------------------
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
]
#: The commonest words of English, the first to be no key terms.
COMMON = (
    "the of and to in is that for with this be by as it on are was from at not or a an all any"
    " you we can may will no if has have which their there use under"
).split()
LICENCE_FILES = ["LICENSE", "LICENCE", "COPYING", "NOTICE"]
# -----------------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


class Model:
    """Weights of the templates' terms, as plain numbers."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> None:
        split = [(name, _terms(text)) for name, text in templates]
        n = len(split)
        held = {t: sum(t in words for _, words in split) for _, w in split for t in w}
        self.least = least
        self.unknown = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in sorted(held.items())}
        self.vectors: list[tuple[int, str, str, float]] = []  # template, licence, term, weight
        self.keys: set[str] = set()
        for number, (name, words) in enumerate(split):
            weights = {t: words.count(t) * self.idf[t] for t in sorted(set(words))}
            length = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors += [(number, name, t, w / length) for t, w in weights.items()]
            # The commonest words, then the shortest: as many as cannot suffice are no keys.
            mass = 0.0
            place = {t: n for n, t in enumerate(COMMON)}
            for t in sorted(weights, key=lambda t: (place.get(t, len(place)), len(t), t)):
                mass += (weights[t] / length) ** 2
                if mass >= least * least - 1e-9:
                    self.keys.add(t)


def _words(text: Column) -> Column:
    return F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+")


def _constant(value, kind: str) -> Column:
    """A nested constant; read once while the query is planned."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def own_licence(text: Column, is_licence_file: Column, model: Model) -> Column:
    """Struct (s, licence) of a text's best unit and template, s its score negated; NULL if
    none reaches ``least``.

    Everything happens inside the row: units are the distinct lines, and the whole text of a
    licence file, that hold a key term. The sorted words of a unit are run through once; at the
    end of a run of equal words its weight goes to the unit's length and to the dot products
    with all templates.
    """
    keys = F.array(*(F.lit(k) for k in sorted(model.keys)))
    whole = F.when(is_licence_file, F.array(text)).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(F.split(text, "\n"), whole))
    units = F.filter(F.transform(parts, _words), lambda words: F.arrays_overlap(words, keys))

    names = [name for _, name in sorted({(n, x) for n, x, _, _ in model.vectors})]
    shares: dict[str, list[float]] = {t: [0.0] * len(names) for t in model.idf}
    for number, _, term, share in model.vectors:
        shares[term][number] = share * model.idf[term]
    known = _constant(
        {t: {"idf": model.idf[t], "shares": own} for t, own in shares.items()},
        "map<string, struct<idf: double, shares: array<double>>>",
    )

    def closed(run: Column) -> tuple[Column, Column]:
        """Square of the length, and dot products, with the run of ``last`` added."""

        def add(term: Column) -> Column:
            weight = run["n"] * F.coalesce(term["idf"], F.lit(model.unknown))
            dots = F.zip_with(run["dots"], term["shares"], lambda dot, share: dot + run["n"] * share)
            return F.struct(
                (run["square"] + weight * weight).alias("square"),
                F.when(term.isNull(), run["dots"]).otherwise(dots).alias("dots"),
            )

        # Looked up once: the array binds the term to a name.
        added = F.get(F.transform(F.array(F.try_element_at(known, run["last"])), add), F.lit(0))
        return added["square"], added["dots"]

    def state(last: Column, n: Column, square: Column, dots: Column) -> Column:
        return F.struct(last.alias("last"), n.alias("n"), square.alias("square"), dots.alias("dots"))

    def step(run: Column, word: Column) -> Column:
        square, dots = closed(run)
        return (
            F.when(run["last"] == "", state(word, F.lit(1.0), run["square"], run["dots"]))
            .when(run["last"] == word, state(word, run["n"] + 1.0, run["square"], run["dots"]))
            .otherwise(state(word, F.lit(1.0), square, dots))
        )

    def best(words: Column) -> Column:
        start = state(F.lit(""), F.lit(0.0), F.lit(0.0), F.array_repeat(F.lit(0.0), len(names)))
        ordered = F.sort_array(F.filter(words, lambda word: word != ""))

        def scored(run: Column) -> Column:
            square, dots = closed(run)
            one = F.struct(square.alias("square"), dots.alias("dots"))
            return F.get(F.transform(F.array(one), least), F.lit(0))

        def least(unit: Column) -> Column:
            scores = F.zip_with(
                unit["dots"],
                F.array(*map(F.lit, names)),
                lambda dot, name: F.struct((-F.round(dot / F.sqrt(unit["square"]), 6)).alias("s"), name.alias("licence")),
            )
            return F.array_min(F.filter(scores, lambda score: score["s"] <= -model.least))

        return F.aggregate(ordered, start, step, scored)

    return F.array_min(F.transform(units, best))


def _ancestors(directory: Column) -> Column:
    """The directory and all above it: structs of depth and path."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("path")),
    )


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """directory, licence, giver: from the nearest of a directory's ancestors in ``licensed``
    (path, licence, one row each), itself included."""
    salt = F.pmod(F.xxhash64("directory"), F.lit(SALT))
    asked = directories.select("directory", F.explode(_ancestors(F.col("directory"))).alias("a"))
    asked = asked.select(
        "directory", "a.depth", "a.path", F.when(F.col("a.depth") == 1, salt).otherwise(0).alias("salt")
    )
    top = ~F.col("path").contains("/")
    spread = F.when(top, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    givers = licensed.select("path", "licence", F.explode(spread.cast("array<long>")).alias("salt"))
    found = asked.withColumn("salt", F.col("salt").cast("long")).join(givers, ["path", "salt"])
    nearest = F.max(F.struct("depth", "path", "licence"))
    return (
        found.groupBy("directory").agg(nearest.alias("g"))
        .select("directory", "g.licence", F.col("g.path").alias("giver"))
    )


def scan(
    files: DataFrame, key: str, path: Column, text: str = "text", model: Model | None = None
) -> DataFrame:
    """Per row: key, path, own_licence, own_score, licence, inherited_from."""
    model = model or Model()
    rows = files.select(
        F.col(f"`{key}`").alias("key"),
        path.alias("path"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    name = F.substring_index(F.upper("path"), "/", -1)
    rows = rows.withColumn(
        "is_licence_file", F.coalesce(name.isin(LICENCE_FILES), F.lit(False))
    ).withColumn(
        "directory",
        F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")),
    )
    own = own_licence(F.col("text"), F.col("is_licence_file"), model)
    marked = rows.withColumn("own", own).select(
        "key", "path", "directory", "is_licence_file", F.col("own.licence").alias("licence"), (-F.col("own.s")).alias("score")
    )
    best = F.min(F.struct((-F.col("score")).alias("s"), "licence"))
    licensed = (
        marked.where(F.col("is_licence_file") & F.col("licence").isNotNull())
        .where(F.col("directory").isNotNull())
        .groupBy("directory").agg(best.alias("b"))
        .select(F.col("directory").alias("path"), "b.licence")
    )
    given = inherited(
        rows.select("directory").where(F.col("directory").isNotNull()).distinct(), licensed
    ).withColumnRenamed("licence", "above")
    out = marked.join(given, "directory", "left")
    takes = F.col("licence").isNull()
    return out.select(
        F.col("key").alias(key),
        "path",
        F.col("licence").alias("own_licence"),
        F.col("score").alias("own_score"),
        F.coalesce("licence", "above").alias("licence"),
        F.when(takes, F.col("giver")).alias("inherited_from"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(path: str, model: Model | None = None) -> str:
    """DuckDB SQL for a scan of ``documents`` under the given path expression: every line is
    scored against every template, without key terms; directories are walked one by one."""
    model = model or Model()
    vectors = ", ".join(f"({n}, {_quoted(x)}, {_quoted(t)}, {w!r}::DOUBLE)" for n, x, t, w in model.vectors)
    idf = ", ".join(f"({_quoted(t)}, {w!r}::DOUBLE)" for t, w in model.idf.items())
    names = ", ".join(map(_quoted, LICENCE_FILES))
    return f"""
WITH RECURSIVE vectors(template, licence, term, share) AS (VALUES {vectors}),
idf(term, idf) AS (VALUES {idf}),
files AS (
  SELECT doc_id, {path} AS path, coalesce(text, '') AS text FROM documents),
named AS (
  SELECT *, coalesce(upper(regexp_extract(path, '[^/]*$')) IN ({names}), false) AS is_licence_file,
    CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS directory
  FROM files),
units AS (
  SELECT DISTINCT doc_id, part FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM named
    UNION ALL SELECT doc_id, text FROM named WHERE is_licence_file)),
terms AS (
  SELECT doc_id, part, term, count(*) AS n FROM (
    SELECT doc_id, part, unnest(string_split_regex(
      translate(part, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+')) AS term FROM units)
  WHERE term <> '' GROUP BY ALL),
weighed AS (
  SELECT doc_id, part, term, n * coalesce(idf, {model.unknown!r}::DOUBLE) AS weight
  FROM terms LEFT JOIN idf USING (term)),
lengths AS (
  SELECT doc_id, part, sqrt(sum(weight * weight)) AS length FROM weighed GROUP BY ALL),
scored AS (
  SELECT doc_id, licence, round(sum(weight * share) / any_value(length), 6) AS score
  FROM weighed JOIN vectors USING (term) JOIN lengths USING (doc_id, part)
  GROUP BY doc_id, part, template, licence),
own AS (
  SELECT doc_id, arg_min(licence, (-score, licence)) AS own_licence, max(score) AS own_score
  FROM scored WHERE score >= {model.least!r}::DOUBLE GROUP BY doc_id),
marked AS (SELECT * FROM named LEFT JOIN own USING (doc_id)),
licensed AS (
  SELECT directory, arg_min(own_licence, (-own_score, own_licence)) AS licence
  FROM marked WHERE is_licence_file AND own_licence IS NOT NULL AND directory IS NOT NULL
  GROUP BY directory),
walk(directory, here) AS (
  SELECT DISTINCT directory, directory FROM named WHERE directory IS NOT NULL
  UNION ALL
  SELECT directory, regexp_replace(here, '/[^/]*$', '') FROM walk WHERE contains(here, '/')),
given AS (
  SELECT w.directory, arg_max(l.licence, length(here)) AS above, arg_max(here, length(here)) AS giver
  FROM walk w JOIN licensed l ON l.directory = w.here GROUP BY w.directory)
SELECT doc_id, path, own_licence, own_score, coalesce(own_licence, above) AS licence,
  CASE WHEN own_licence IS NULL THEN giver END AS inherited_from
FROM marked LEFT JOIN given USING (directory)
"""
