"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are words of letters and digits, lower-cased. Templates fall into classes by their number of shingles;
a class of m shingles reads windows of 2 * m shingles, one every m, so that whatever m neighbouring shingles a text has lie
in one window. A window with CONTAINED of a template's t shingles has a Jaccard similarity of at least
CONTAINED * t / (2 * m + (1 - CONTAINED) * t) to it, where t is over m / 2: 0.19 or more. With one hash a band, BANDS bands
miss it with a probability of (1 - that) ** BANDS, by computation 0.03 % at most. A window can only share a band with a
template if it holds the shingle that has the template's least hash there, so texts without any of those shingles are
dropped before windows are made (and before that, texts without the longest word of any), and so are windows without one
of their class; this loses nothing.

Nulls: a null text has no words. Rows with no match give no row; repeated rows give one each, ties of containment the first
place. Very long texts are read whole, an empty table gives an empty result. Only DataFrame functions run.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N, BANDS, CONTAINED = 5, 40, 0.8
#: Statements, notices and usual wordings of public licenses, and the texts of license_texts under the names of their files.
TEMPLATES = {
    "mit-statement": "Released under the MIT License.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-licensed": "licensed under the MIT License",
    "mit-terms": "under the terms of the MIT license",
    "apache-2.0-terms": "under the terms of the Apache License, Version 2.0",
    "bsd-licensed": "licensed under the BSD License",
    "bsd-style": "governed by a BSD-style license that can be found in the LICENSE file",
    "isc-licensed": "licensed under the ISC License",
    "gpl-2.0-or-later-header": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-3.0-or-later-header": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-statement": "licensed under the GNU General Public License",
    "lgpl-statement": "licensed under the GNU Lesser General Public License",
    "lgpl-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-statement": "licensed under the GNU Affero General Public License",
    "agpl-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0-statement": "licensed under the Mozilla Public License",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc-by-sa-4.0-statement": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-license": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-4.0-statement": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-sa-4.0-short": "licensed under CC BY-SA 4.0",
    "cc-by-4.0-short": "licensed under CC BY 4.0",
    "cc0-statement": "waived all copyright and related or neighboring rights",
    **{f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _class(m: int) -> int:
    """Shingles of a class: m to the next power of two."""
    return 1 << (m - 1).bit_length()


def _shingles(words):
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(N)])
    return F.when(F.size(words) >= N, F.transform(F.sequence(F.lit(0), F.size(words) - N), one)).otherwise(F.array().cast("array<long>"))


def _least(shingles, band: int):
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band))))


def _windows(m: int):
    window = lambda i: F.struct(F.lit(m).alias("class"), i.alias("start"), F.slice("s", i + 1, F.lit(2 * m)).alias("s"))
    return F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(m)), window)


def templates(spark, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, size class, words, shingles and band keys of each template of N words or more."""
    rows = [(name, _class(len(w) - N + 1), w) for name, t in texts.items() if len(w := words_of(t)) >= N]
    t = spark.createDataFrame(rows, "license string, class int, w array<string>").withColumn("shingles", F.array_distinct(_shingles(F.col("w"))))
    return t.select("license", "class", "w", "shingles", F.array(*[_least(F.col("shingles"), b) for b in range(BANDS)]).alias("keys"))


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, containment and first_word (of the first window with the highest containment) of each match."""
    spark = docs.sparkSession
    known = templates(spark, texts)
    rows = known.collect()  # the list of templates is a parameter, not data
    classes = sorted({r["class"] for r in rows})
    # of each template and band, the shingle with the least hash
    least = [F.min_by("h", F.xxhash64("h", F.lit(b))) for b in range(BANDS)]
    by_class: dict[int, set] = {c: set() for c in classes}
    for r in known.select("license", "class", F.explode("shingles").alias("h")).groupBy("license", "class").agg(*least).drop("license").collect():
        by_class[r[0]].update(r[1:])
    holds = lambda heads: F.arrays_overlap("s", F.array(*map(F.lit, sorted(heads))).cast("array<long>"))
    heads = set().union(*by_class.values())
    grams = known.select("w", F.posexplode(_shingles(F.col("w"))).alias("i", "h")).filter(F.col("h").isin(sorted(heads))).select(F.slice("w", F.col("i") + 1, N).alias("words"))
    longest = F.array_max(F.transform("words", lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"]
    marks = sorted(r[0] for r in grams.select(longest).distinct().collect())
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z0-9]+"), "").alias("w"))
    slim = slim.filter(F.arrays_overlap("w", F.array(*map(F.lit, marks)).cast("array<string>")))
    slim = slim.select("row", "id", _shingles(F.col("w")).alias("s")).filter(holds(heads))
    windows = F.flatten(F.array(*map(_windows, classes)))
    win = slim.select("row", "id", F.explode(windows).alias("win")).select("row", "id", "win.*")
    # only windows with a least shingle of a template of their class go on
    win = win.filter(reduce(lambda other, c: F.when(F.col("class") == c, holds(by_class[c])).otherwise(other), classes, F.lit(False)))
    band = win.withColumn("keys", F.array(*[_least(F.col("s"), b) for b in range(BANDS)]))
    # band keys retrieve: a window meets the templates with which it shares one, at the first band of those that it shares
    tables = known.select("license", "class", F.posexplode("keys").alias("b", "key"))
    bodies = known.select("license", F.col("shingles").alias("t"), F.col("keys").alias("t_keys"))
    probes = band.select("row", "id", "class", "start", "s", "keys", F.posexplode("keys").alias("b", "key"))
    found = probes.join(F.broadcast(tables), ["class", "b", "key"]).join(F.broadcast(bodies), "license")
    found = found.filter(F.array_position(F.zip_with("keys", "t_keys", lambda a, b: a == b), True) == F.col("b") + 1)
    share = F.size(F.array_intersect("s", "t")) / F.size("t")
    found = found.withColumn("containment", share).filter(F.col("containment") >= CONTAINED)
    best = found.groupBy("row", "license").agg(F.first("id").alias("id"), F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("id", "license", F.col("best.containment").alias("containment"), (-F.col("best.start")).cast("long").alias("first_word"))
