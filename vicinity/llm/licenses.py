"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies.

DataFrame functions only. Words are runs of letters and digits in lower case;
shingles are five words (all words of shorter texts). A text is read in
windows that overlap by half, per template size in powers of two, of at least
twice a template's shingles, so a whole template lies in one. Each of BANDS
bands is one minimum hash: a window that holds 0.8 of a template has a Jaccard
similarity of at least 0.8 / 4.2 with it, so it misses all bands with a
probability below (1 - 0.19)**BANDS, under 0.000002. Windows that share no
shingle with any template can't share a minimum, and are left out beforehand.
Templates of fewer than five words are one shingle of their own length, looked
up in the texts' shingles of that length without bands.

Null and empty texts match nothing. Whole texts are scanned, however long, in
the row's own task; only the templates are broadcast, in scans of MOST_SHINGLES
at most, so a larger table of templates takes several.
Equal rows give one row a template. Empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
SMALLEST_WINDOW = 8
#: Templates' shingles that are broadcast at most.
MOST_SHINGLES = 200_000

#: Notices to look for (fixed values): id and wording.
TEMPLATES = [
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def runs(w: Column, n: int) -> Column:
    """Hashes of the runs of n words, in order, of at least n words."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(n)]))


def shingles(w: Column) -> Column:
    """Hashes of the runs of SHINGLE words, in order; one of all words, if fewer; none without words."""
    return F.when(F.size(w) >= SHINGLE, runs(w, SHINGLE)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def minimum(h: Column, band: Column) -> Column:
    """The minimum of a window's hashes under the permutation of a band."""
    return F.array_min(F.transform(h, lambda x: F.xxhash64(x, band)))


def template_table(templates: DataFrame) -> DataFrame:
    """template, h (distinct shingles), window (size in shingles) of the templates of at least SHINGLE words."""
    t = templates.select("template", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") >= SHINGLE).select("template", F.array_distinct(shingles(F.col("w"))).alias("h"))
    size = F.greatest(F.lit(SMALLEST_WINDOW), F.pow(F.lit(2), F.ceil(F.log2(2 * F.size("h")))).cast("int"))
    return t.withColumn("window", size)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, text string")


def scan_short(docs: DataFrame, short: DataFrame, n: int) -> DataFrame:
    """scan_licenses for templates (template, w) of n words, fewer than SHINGLE."""
    t = short.where(F.size("w") == n).select("template", runs(F.col("w"), n)[0].alias("s"))
    some = F.array(*[F.lit(r["s"]) for r in t.select("s").distinct().collect()])  # as bounded as the templates
    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") >= n)
    rows = rows.select("doc_id", "same", F.explode(F.array(runs(F.col("w"), n))).alias("h")).where(F.arrays_overlap("h", some))
    starts = F.sequence(F.lit(0), F.size("h") - 1, F.lit(SMALLEST_WINDOW // 2))
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_intersect(F.slice("h", i + 1, F.lit(SMALLEST_WINDOW)), some).alias("s")))
    met = rows.select("doc_id", "same", F.explode(cut).alias("c")).select("doc_id", "same", F.col("c.at").alias("at"), F.explode("c.s").alias("s")).join(F.broadcast(t), "s")
    # equal rows count once
    best = met.groupBy("doc_id", "same", "template").agg(F.count_distinct("at").alias("n_windows"), F.min("at").alias("first_shingle"))
    return best.select("doc_id", "template", F.lit(1).alias("n_shingles"), F.lit(1).alias("matched"), F.lit(1.0).alias("containment"), "n_windows", "first_shingle")


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, n_shingles, matched (shingles in the best window), containment, n_windows that reach it, first_shingle."""
    own = templates.select("template", F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.size(words(F.col("text"))))).first()[0] or 0
    if size > MOST_SHINGLES and own.count() > 1:
        parts, out = -(-2 * size // MOST_SHINGLES), None
        number = F.pmod(F.xxhash64("template", "text"), F.lit(parts))
        for i in [r["i"] for r in own.select(number.alias("i")).distinct().orderBy("i").collect()]:
            part = _scan(docs, own.where(number == i), containment)
            out = part if out is None else out.unionByName(part)
        return out
    return _scan(docs, own, containment)


def _scan(docs: DataFrame, templates: DataFrame, containment: float) -> DataFrame:
    """scan_licenses of a table of templates that may be broadcast."""
    short = templates.select("template", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w").between(1, SHINGLE - 1))
    out = _scan_long(docs, templates, containment)
    for n in sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect()):
        out = out.unionByName(scan_short(docs, short, n))
    return out


def _scan_long(docs: DataFrame, templates: DataFrame, containment: float) -> DataFrame:
    """_scan of the templates of at least SHINGLE words."""
    t = template_table(templates)
    sizes = t.agg(F.sum(F.size("h")), F.array_sort(F.collect_set("window")), F.array_distinct(F.flatten(F.collect_list("h")))).first()
    if not sizes[0]:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "'' template", "0 n_shingles", "0 matched", "0D containment", "0L n_windows", "0 first_shingle")
    some = F.array(*[F.lit(x) for x in sizes[2]])
    # each generator is a border that keeps the arrays before it from being computed again in what follows
    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), F.explode(F.array(words(F.col("text")))).alias("w"))
    rows = rows.select("doc_id", "same", F.explode(F.array(shingles(F.col("w")))).alias("s")).where(F.arrays_overlap("s", some))
    rows = rows.select("doc_id", "same", "s", F.explode(F.array(*[F.lit(x) for x in sizes[1]])).alias("window"))
    step = (F.col("window") / 2).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - 1), step)
    cut = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("s", i + 1, F.col("window")).alias("h"))), lambda x: F.arrays_overlap(x["h"], some))
    windows = rows.select("doc_id", "same", "window", F.explode(cut).alias("w"))
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    signed = windows.select("doc_id", "same", "window", "w", F.explode(F.transform(bands, lambda b: F.xxhash64(b, minimum(F.col("w.h"), b)))).alias("band"))
    index = t.select("template", F.col("window").alias("of"), F.explode(F.transform(bands, lambda b: F.xxhash64(b, minimum(F.col("h"), b)))).alias("key"))
    met = signed.join(F.broadcast(index), (F.col("band") == F.col("key")) & (F.col("window") == F.col("of")))
    # a window meets a template once, whatever the bands
    met = met.groupBy("doc_id", "same", "template", F.col("w.at").alias("at")).agg(F.first("w.h").alias("wh"))
    checked = met.join(F.broadcast(t.select("template", "h")), "template").withColumn("matched", F.size(F.array_intersect("h", "wh")))
    good = checked.where(F.col("matched") >= F.lit(containment) * F.size("h"))
    best = good.groupBy("doc_id", "same", "template", F.size("h").alias("n_shingles")).agg(F.max("matched").alias("matched"), F.count("*").alias("n_windows"), F.min("at").alias("first_shingle"))
    return best.select("doc_id", "template", "n_shingles", "matched", (F.col("matched") / F.col("n_shingles")).alias("containment"), "n_windows", "first_shingle")
