"""Licence scans by diagonal voting: rolling word k-grams are joined to template places, and offsets vote."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gasframe.llm.common import BROADCAST_BYTES, ascii_lower

K = 3
#: Phrases whose every place counts (fixed values): label, words.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Templates of well-known licence notices (fixed values): label, text. A parameter of ``scan``.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
)
#: Diagonals at most so many words apart are one occurrence with words put in or left out.
NEIGHBOURS = 8
#: Share of a template's k-grams from which an occurrence is verified.
MIN_COVERAGE = 0.6
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(phrases, templates, k: int) -> list[tuple]:
    """(template, label, exact, grams, place, gram) of every k-gram of every phrase and template."""
    out = []
    for t, (label, text) in enumerate([*phrases, *templates]):
        words = _WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        out += [(t, label, t < len(phrases), len(words) - k + 1, i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, places (sorted array of structs (start, end, label) of the
    phrases) and found (array of structs (label, start, end, coverage) of verified template occurrences), in words.

    All word k-grams of all texts are joined, by hash and then by their words, to the places of the templates, a
    table as large as the templates given; it is broadcast if that is not more than ``BROADCAST_BYTES``. A match
    votes for its diagonal (word position less template place). A diagonal with all k-grams of a phrase is a place of
    the phrase. Neighbouring diagonals of a template are merged, and an occurrence is verified by the share of the
    template's k-grams that it holds. What is gathered is bounded by a document's own matches; a very long text is
    scanned whole. Templates that tie give a span each. A null text counts as empty; rows are known by id and text,
    whatever the order in which they come, and repeated rows give repeated rows; a null id is kept; other columns are
    not read; no rows give no rows.
    """
    spark = docs.sparkSession
    schema = "t int, label string, exact boolean, grams int, place int, tgram string"
    places = [(-1, "", False, 0, 0, ""), *_places(phrases, templates, k)]
    table = spark.createDataFrame(places, schema).withColumn("h", F.xxhash64("tgram"))
    table = F.broadcast(table) if sum(40 + len(x[1].encode()) + len(x[5].encode()) for x in places) <= BROADCAST_BYTES else table
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(id_col, whole).alias("row"), F.xxhash64(whole).alias("key"), F.col(id_col).alias("doc_id"), F.filter(F.split(text, _NO_WORD, -1), lambda w: w != "").alias("words"))
    n = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get(F.col("words"), i + j) for j in range(k))).alias("gram")))
    none = F.array().cast("array<struct<pos:int,gram:string>>")
    mark = F.array(F.struct(n.alias("pos"), F.lit("").alias("gram")))
    every = rows.select("row", "key", "doc_id", F.explode(F.concat(mark, F.when(n >= k, grams).otherwise(none))).alias("g")).select("row", "key", "doc_id", "g.pos", "g.gram")
    hits = every.join(table, (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("tgram")))
    diagonals = hits.groupBy("row", "key", "t", "label", "exact", "grams", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.collect_set("place").alias("places"))
    by = Window.partitionBy("row", "key", "t").orderBy("diagonal")
    apart = (F.col("exact") | (F.col("t") < 0) | (F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOURS)).cast("int")
    runs = diagonals.withColumn("apart", F.coalesce(apart, F.lit(1))).withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "key", "t", "label", "exact", "grams", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("copies").alias("copies"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places")).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
    )
    span = F.struct("start", (F.col("last") + k).alias("end"), "label")
    seen = F.struct("label", F.col("start").alias("start"), (F.col("last") + k).alias("end"), F.when(F.col("grams") > 0, F.col("held") / F.when(F.col("grams") > 0, F.col("grams"))).alias("coverage"))
    real = F.col("t") >= 0
    found = merged.groupBy("row", "key").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(~real, F.col("copies"))).cast("int").alias("copies"),
        F.max(F.when(~real, F.col("last"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(real & F.col("exact") & (F.col("held") == F.col("grams")), span))).alias("places"),
        F.array_sort(F.collect_list(F.when(real & ~F.col("exact") & (F.col("held") >= min_coverage * F.col("grams")), seen))).alias("found"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "places", "found")
