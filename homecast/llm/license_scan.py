"""License scans: TF-IDF cosine to notice templates, and inheritance by directory (DataFrame
functions only).

Every worded line of a whole text is compared with the templates by the cosine of sparse
TF-IDF vectors (term count times ``ln((1 + documents) / (1 + documents with the term)) + 1``;
frequencies over all documents).  Lines that cannot reach the threshold are left out
beforehand, exactly: the cosine is at most the share of the template's norm that the common
terms hold, so a line needs one of the template's heaviest terms, and enough of them.  Equal
lines are scored once.

A document's own licence is that of its best line.  A document marked as a licence file
stands for its directory; each directory takes the licence of its nearest ancestor that has
one (itself included), by a join of its ancestor paths with the directories of licence files,
and documents join their directory.

Defined cases: a null text has no lines; a null path has no directory and inherits nothing;
between equal scores the licence first in order stands, between licence files of a directory
the best score, then the smallest id; repeated rows get equal results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

THRESHOLD = 0.7
#: Possessive, so that a long dotted number takes no stack.
TERM = "[a-z0-9]++(?:\\.[0-9]++)*+"
#: Licence and the wording of its usual notice.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                   "file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                "of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_terms(spark: SparkSession, templates) -> DataFrame:
    """template, licence, term, tf."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, licence string, text string")
    return rows.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "template", "licence", "term").agg(F.count("*").alias("tf"))


def document_frequency(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df of the ``wanted`` terms, over all rows of ``texts(text)``."""
    counts = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    return counts.join(wanted, "term")


def notices(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(rid, text) -> rid, line (number), licence, score: the lines that reach the
    threshold, each with its best template."""
    spark = docs.sparkSession
    n = docs.count()
    idf = F.log(F.lit(1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    vectors = template_terms(spark, templates)
    few = vectors.select("term").distinct().collect()  # the templates' own terms
    of_templates = F.array(*[F.lit(r["term"]) for r in few])
    template_df = materialize(docs.select(F.explode(F.array_intersect(terms(F.col("text")), of_templates)).alias("term"))
                              .groupBy("term").agg(F.count("*").alias("df")))
    vectors = materialize(vectors.join(template_df, "term", "left").withColumn("w", F.col("tf") * idf).select(
        "template", "licence", "term", "w"))
    weight: dict[int, dict[str, float]] = {}
    for r in vectors.collect():
        weight.setdefault(r["template"], {})[r["term"]] = r["w"] ** 2
    heavy, enough = set(), F.lit(False)
    shared = F.col("shared")
    for w in weight.values():
        need, rest = threshold ** 2 * sum(w.values()) * (1 - 1e-9), sum(w.values())
        for term in sorted(w, key=lambda t: (-w[t], t)):  # without these, too little is left
            if rest < need:
                break
            heavy.add(term)
            rest -= w[term]
        held = sum((F.when(F.array_contains(shared, t), x).otherwise(0.0) for t, x in sorted(w.items())), F.lit(0.0))
        enough = enough | (held >= need)
    if not heavy:
        return docs.select("rid", F.lit(0).alias("line"), F.lit("").alias("licence"), F.lit(0.0).alias("score")).limit(0)
    some = F.array(*[F.lit(t) for t in sorted(heavy)])
    lines = docs.select("rid", F.posexplode(F.split("text", "\n", -1)).alias("line", "l")).select(
        "rid", "line", terms(F.col("l")).alias("terms")).filter(F.arrays_overlap("terms", some))
    lines = lines.withColumn("shared", F.array_intersect("terms", of_templates)).filter(enough)
    lines = materialize(lines.select("rid", "line", F.sort_array("terms").alias("terms")))
    each = lines.select("terms").distinct().select("terms", F.explode("terms").alias("term")) \
        .groupBy("terms", "term").agg(F.count("*").alias("tf"))
    others = materialize(each.select("term").distinct().join(vectors.select("term"), "term", "left_anti"))
    df = template_df.union(document_frequency(docs, others))
    each = each.join(df, "term", "left").withColumn("w", F.col("tf") * idf)
    norm = each.groupBy("terms").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template_norm = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    dot = each.select("terms", "term", "w").join(
        vectors.select("template", "licence", "term", F.col("w").alias("t_w")), "term").groupBy(
        "terms", "template", "licence").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    scored = dot.join(norm, "terms").join(template_norm, "template").select(
        "terms", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score"))
    best = scored.filter(F.col("score") >= threshold).groupBy("terms").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select(
        "terms", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))
    return lines.join(best, "terms").select("rid", "line", "licence", "score")


def scan(docs: DataFrame, path: Column, licence_file: Column, id_col: str = "doc_id", text: str = "text",
         **options) -> DataFrame:
    """One row per document: doc_id, path, own_licence, own_score, n_notices,
    inherited_licence, inherited_from, licence.

    ``licence_file``: a condition on the columns path, own_licence and first_line (the
    number of the first notice, among the lines) that marks licence files."""
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), text_or_empty(text).alias("text"))
    keyed = rows.withColumn("rid", F.struct("doc_id", F.xxhash64("text").alias("content")))
    found = materialize(notices(keyed.select("rid", "text"), **options).distinct())
    own = found.groupBy("rid").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.count("*").alias("n_notices"),
        F.min("line").alias("first_line"))
    own = keyed.select("rid", "doc_id", "path").join(own, "rid", "left").select(
        "doc_id", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "first_line")
    folder = F.regexp_replace(F.when(F.col("path").contains("/"), F.col("path")).otherwise(
        F.concat(F.lit("/"), F.col("path"))), "/[^/]*$", "")
    own = materialize(own.withColumn("dir", folder))
    marked = own.filter(F.col("own_licence").isNotNull() & F.col("dir").isNotNull()).filter(licence_file)
    of_dir = marked.groupBy("dir").agg(F.min(F.struct(
        (-F.col("own_score")).alias("s"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "own_licence")).alias("b")) \
        .select(F.col("dir").alias("above"), F.col("b.own_licence").alias("licence"))
    parts = F.split("dir", "/")
    dirs = own.filter("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.posexplode(F.transform(parts, lambda _, i: F.array_join(
        F.slice(parts, F.lit(1), i + 1), "/"))).alias("depth", "above"))
    above = above.union(dirs.filter(F.substring("dir", 1, 1) != "/").select("dir", F.lit(-1), F.lit("")))
    nearest = above.join(of_dir, "above").groupBy("dir").agg(
        F.max(F.struct("depth", "above", "licence")).alias("b")).select(
        F.col("dir").alias("_d"), F.col("b.licence").alias("inherited_licence"), F.col("b.above").alias("inherited_from"))
    return own.join(nearest, F.col("dir") == F.col("_d"), "left").select(
        "doc_id", "path", "own_licence", "own_score", "n_notices", "inherited_licence", "inherited_from",
        F.coalesce("own_licence", "inherited_licence").alias("licence"))
