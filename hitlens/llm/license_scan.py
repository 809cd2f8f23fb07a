"""License scan: MinHash bands retrieve templates, exact shingle containment verifies them.

Texts and templates become lower-case runs of letters and digits. A text is cut into windows of `WINDOW` words, one every
`STRIDE`; a template into its windows at every word (a shorter template is one window). A window's signature is the
smallest hash of its word pairs under each of `BANDS` seeds, a band being one of them. A copy of a template of five words or more
overlaps one window so that at least half of the pairs of the two are shared, so each band
collides with probability 1/2 or more and `BANDS` of them miss with 2**-BANDS (see `miss_probability`). Candidates are then verified: of the template's distinct
five-word shingles at least `CONTAINED` must stand in the text around the window.

DataFrame functions alone. Every window of every text is looked up; bands are joined with the templates' (a parameter
of bounded size, broadcast only below a checked number of rows).

Edge cases: null, empty and short texts match nothing; rows equal in id and text give one result; rows of one id with other
texts are told apart by a hash of the text; a null id is an id; a template of under five words is one shingle; empty
tables, of documents or templates, give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import FULL_TEXTS
from .store import join_small, stage

WINDOW, STRIDE, BANDS, SHINGLE_WORDS, CONTAINED = 8, 4, 12, 5, 0.8
#: Word pairs of a template that a window must have (all of a template with fewer): a common one alone ("of the") retrieves
#: too much.
SHARED = 2
#: Up to so many different word pairs of templates are sent along to leave out windows that share too few; with more of them
#: every window is looked up. Both give the same rows, since SHARED is held against each template after the look-up.
MAX_PAIRS = 10_000
#: Notices as their licenses word them (fixed values): license, text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
) + FULL_TEXTS


def miss_probability(similarity: float, bands: int = BANDS) -> float:
    """The probability that no band of two windows of that Jaccard similarity collides."""
    return (1 - similarity) ** bands


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, license string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(of: Column, size: int) -> Column:
    """Hashes of all runs of `size` elements; of fewer, of the whole; of none, nothing."""
    last = F.size(of) - size
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(of, i + 1, F.lit(size))))
    return F.when(F.size(of) > 0, many).otherwise(F.array().cast("array<bigint>"))


def _pairs(of: Column) -> Column:
    """Hashes of all pairs of neighbouring words; of a single word, of it alone; of none, nothing."""
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(of) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(of, i), F.get(of, i + 1)))
    return F.when(F.size(of) > 0, many).otherwise(F.array().cast("array<bigint>"))


def _bands(rows: DataFrame, stride: int, shared: list[int] | None = None, least_shared: int = 1, lone: list[int] | None = None, reach: int = 0) -> DataFrame:
    """(key columns, words, pairs) to (key columns, at, part, around, band, value): the signatures of windows of WINDOW - 1
    pairs, and the words from `reach` before a window to `reach` behind it.

    shared: the templates' pairs. Two signatures can only agree through a pair that both windows have, so windows
    without any of these are left out. least_shared: how many of them a window must have; the window over a copy has four,
    less two for each word that an edit changes there. lone: pairs of templates that have no other; one of them is enough."""
    size = WINDOW - 1
    starts = F.when(F.size("pairs") > 0, F.sequence(F.lit(0), F.greatest(F.size("pairs") - 1, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if shared is not None:
        found = F.filter(F.transform("pairs", lambda h, i: F.when(h.isin(shared), i)), lambda i: i.isNotNull())
        steps = range((size - 1) // stride + 1)
        around = F.flatten(F.transform(found, lambda i: F.array(*(i - i % stride - k * stride for k in steps))))
        part = lambda i: F.slice("pairs", i + 1, F.lit(size))
        several = lambda i: F.size(F.filter(part(i), lambda h: h.isin(shared))) >= least_shared
        enough = (lambda i: several(i) | F.exists(part(i), lambda h: h.isin(lone))) if lone else several
        starts = F.filter(F.array_distinct(around), lambda i: (i >= 0) & enough(i))
    # The last windows may be shorter; those that a longer one before them holds whole are left out.
    starts = F.filter(starts, lambda i: (i == 0) | (i + size - stride < F.size("pairs")))
    keys = [c for c in rows.columns if c not in ("words", "pairs")]

    def least(part: Column, band: int) -> Column:
        return F.array_min(F.transform(part, lambda h: F.xxhash64(h, F.lit(band))))

    def window(w: Column, at: Column) -> Column:
        low = F.greatest(at - reach, F.lit(0))
        return F.struct(at.alias("at"), F.slice("pairs", at + 1, F.lit(size)).alias("part"), F.slice(w, low + 1, at + WINDOW + reach - low).alias("around"))

    # Windows are made where the text's words are bound once, so that rows carry their own words and not the text.
    found = F.transform(F.array("words"), lambda w: F.transform(starts, lambda at: window(w, at)))[0]
    windows = rows.select(*keys, F.explode(found).alias("w")).select(*keys, "w.at", "w.part", "w.around")
    return windows.select(*keys, "at", "part", "around", F.posexplode(F.array(*(least(F.col("part"), b) for b in range(BANDS)))).alias("band", "value"))


def scan(docs: DataFrame, templates: DataFrame, id: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per document and license that it carries: id, mark (hash of the text), license, containment (of its best
    template), word (where its first verified window starts)."""
    known = templates.select("template", "license", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    known = stage(known.select("template", "license", F.size("words").alias("length"), F.array_distinct(_runs(F.col("words"), SHINGLE_WORDS)).alias("shingles"), _pairs(F.col("words")).alias("pairs")), "templates")
    wanted = stage(_bands(known.select("template", F.array().cast("array<string>").alias("words"), "pairs"), 1).select("template", "band", "value").distinct(), "bands")
    own = F.array_distinct("pairs")
    pairs = known.select(F.explode(own).alias("pair"), (F.size(own) < SHARED).alias("lone")).groupBy("pair").agg(F.max("lone").alias("lone")).limit(MAX_PAIRS + 1).collect()
    shared, lone = [r.pair for r in pairs], [r.pair for r in pairs if r.lone]
    if not shared:  # no templates
        shared = [0]
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), words(F.col(text)).alias("words"))
    reach = known.agg(F.max("length")).first()[0] or 0
    found = _bands(rows.withColumn("pairs", _pairs(F.col("words"))), STRIDE, shared if len(shared) <= MAX_PAIRS else None, SHARED, lone, reach)
    hits = join_small(found, wanted, ["band", "value"], "inner").select("id", "mark", "template", "at", "part", "around")
    about = known.select("template", "license", "length", "shingles", own.alias("own"))
    hits = join_small(hits, about, "template", "inner", F.size("own") + F.size("shingles"))
    hits = hits.filter(F.size(F.filter("part", lambda h: F.array_contains("own", h))) >= F.least(F.lit(SHARED), F.size("own")))
    # The exact check, in the words within the template's length around the window; nothing is shuffled before it.
    low, base = (F.greatest(F.col("at") - x, F.lit(0)) for x in (F.col("length"), F.lit(reach)))
    near = F.slice("around", low - base + 1, F.col("at") + WINDOW + F.col("length") - low)
    share = F.transform(F.array(near), lambda n: F.size(F.array_intersect("shingles", _runs(n, SHINGLE_WORDS))) / F.size("shingles"))[0]  # cut once
    checked = hits.select("id", "mark", "license", "at", share.alias("containment")).filter(F.col("containment") >= contained)
    return checked.groupBy("id", "mark", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("word"))
