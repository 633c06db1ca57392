"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Everything is a column expression or a join of DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.llm.common import pick, staged, text_or_empty

# Notices and opening sentences of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Words of a window and of a shingle, step from window to window, and bands of one MinHash each.
#: Any run of WINDOW - STRIDE + 1 words lies inside a window. A whole five-word notice shares
#: four of a window's five shingles, so no band meets with a chance of (1 - 0.8)**5 = 0.0003; a
#: window inside a longer notice equals a window of the template, so every band meets.
WINDOW, SHINGLE, STRIDE, BANDS = 6, 2, 2, 5
CONTAINMENT = 0.8
MOST_TEMPLATES = 10_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Hash of each pair of neighbouring words; an array one shorter than the words."""
    none = F.array().cast("array<bigint>")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, pairs).otherwise(none)


def windows_of(shingles: Column, stride: int) -> Column:
    """``struct(at, w)`` for each window; the last one ends with the text, a short text is one window."""
    per = WINDOW - SHINGLE + 1
    last = F.greatest(F.size(shingles) - per, F.lit(0))
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    none = F.array().cast("array<struct<at:int,w:array<bigint>>>")
    return F.when(F.size(shingles) > 0, F.transform(at, lambda a: F.struct(a.alias("at"), F.slice(shingles, a + 1, per).alias("w")))).otherwise(none)


def bands_of(window: Column) -> Column:
    """One MinHash per band: the least shingle hash under the band's own order."""
    turn = [0x9E3779B97F4A7C15 * (k + 1) % (1 << 64) for k in range(BANDS)]
    signed = [t - (1 << 64) if t >> 63 else t for t in turn]
    least = lambda t: F.array_min(F.transform(window, lambda x: x.bitwiseXOR(F.lit(t))))
    return F.array(*(F.struct(F.lit(k).alias("band"), least(t).alias("least")) for k, t in enumerate(signed)))


def templates_table(spark, templates) -> DataFrame:
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates, which are broadcast")
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")
    run = rows.withColumn("words", words_of(F.col("text"))).withColumn("run", shingles_of(F.col("words")))
    return run.select("template", "license", F.array_distinct("run").alias("own"), "run").where("size(own) > 0")


def licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, licenses, n_spans, spans``.

    Windows of ``WINDOW`` words, one every ``STRIDE`` words, and those of the templates, one at
    every word, get ``BANDS`` MinHashes of their shingles; windows that agree in a band are
    retrieved. Hits of a template that lie closer than its length form a region, and a region
    holds the license if ``containment`` of the template's distinct shingles are among those
    that were hit in it. spans: ``struct(start, license, end, containment)`` in word positions,
    end exclusive, by start; licenses: the distinct names, sorted.

    Null and empty texts, and texts of one word, have none. Copies of a text are looked at
    once. Repeated rows get equal rows, null ids are kept, an empty table gives an empty
    result. Without templates nothing is found.
    """
    spark = docs.sparkSession
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), F.col("text")).alias("b")).alias("key")
    known = templates_table(spark, templates)
    sought = known.select("template", F.explode(windows_of(F.col("run"), 1)).alias("x")).select("template", F.explode(bands_of(F.col("x.w"))).alias("b"))
    sought = F.broadcast(sought.select("template", "b.band", "b.least").distinct())
    # columns of their own, so that no lambda evaluates them again for every element
    seen = own.select(key, words_of(F.col("text")).alias("words")).select("key", shingles_of(F.col("words")).alias("s")).select("key", F.explode(windows_of(F.col("s"), STRIDE)).alias("x"))
    seen = seen.select("key", "x.at", "x.w", F.explode(bands_of(F.col("x.w"))).alias("b"))
    retrieved = seen.join(sought, (F.col("b.band") == F.col("band")) & (F.col("b.least") == F.col("least")))
    hits = staged(retrieved.select("key", "at", "w", "template").distinct(), "hits")

    each = hits.join(F.broadcast(known.select("template", "license", "own")), "template")
    found = each.select("key", "template", "license", F.size("own").alias("n"), F.posexplode("w").alias("i", "s"), "at", "own")
    found = found.select("key", "template", "license", "n", (F.col("at") + F.col("i")).alias("place"), "s", F.array_contains("own", F.col("s")).alias("is"))
    found = found.where("is").select("key", "template", "license", "n", "place", "s").distinct()
    order = W.partitionBy("key", "template").orderBy("place")
    begins = (F.col("place") - F.lag("place").over(order) > F.col("n")).cast("int")
    regions = found.withColumn("region", F.sum(F.coalesce(begins, F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    held = regions.groupBy("key", "template", "license", "n", "region").agg((F.count_distinct("s") / F.first("n")).alias("containment"), F.min("place").alias("start"), (F.max("place") + SHINGLE).alias("end"))
    spans = held.where(F.col("containment") >= containment).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "license", "end", "containment"))).alias("spans"),
    )
    spans = staged(spans, "spans")
    joined = own.select("doc_id", key).join(spans, "key", "left")
    listed = F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
    return joined.select("doc_id", F.array_sort(F.array_distinct(F.transform(listed, lambda s: s["license"]))).alias("licenses"), F.size(listed).alias("n_spans"), listed.alias("spans"))
