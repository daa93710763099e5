"""License scan with DataFrame functions only: MinHash bands over overlapping windows find templates, exact shingle
containment verifies them.

Texts are lower-cased and read as runs of [a-z0-9]; a shingle is five such words. A template is cut into pieces of PIECE
shingles and each piece gets BANDS one-row bands: the least hash of its shingles under each seed. Windows of WINDOW
shingles start every STEP shingles, so any piece lies whole in some window. It then has Jaccard similarity PIECE / WINDOW
at least with that window, and a template that has a piece whole in the document is missed with probability
(1 - PIECE / WINDOW) ** BANDS at most: 6e-8. If the shingles of a piece stand apart, each among others, it is met with
probability PIECE / (PIECE + WINDOW - 1) a band: 2e-5. Templates of fewer shingles than a piece would be missed more often
(one shingle: 4 %), so those get no bands: they are verified in every document with a template shingle, and none is missed.
A window without any template shingle can collide in no band, so those get no bands; that loses nothing. Templates that a
band of the document meets are kept if at least CONTAINED of their shingles stand in the document.

Everything runs row by row: no shuffle, and the template tables are constants of fixed size.

Defined results: null, empty and short texts match nothing; a template counts once a document however often it is there;
whole texts are read; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
WINDOW = 8
STEP = 4
PIECE = 4
BANDS = 24
CONTAINED = 0.8

#: The notices looked for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """A 64-bit hash of each run of five words, in order; empty for fewer words."""
    n = F.size(words) - (WORDS - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(WORDS)), " ")))).otherwise(F.array().cast("array<bigint>"))


def bands(shingles: Column) -> Column:
    """The least hash of the shingles under each seed; the seed is part of the hash, so bands meet their like only."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*map(least, range(BANDS)))


def once(rows: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once a row: a generator stands where the optimizer would copy the expression into each use."""
    return rows.select(*keep, F.explode(F.array(value)).alias(name))


def template_tables(spark: SparkSession) -> dict[str, tuple[list[int], list[int]]]:
    """name -> (shingle hashes, bands of all its pieces, none if it is shorter than a piece); as many rows as TEMPLATES."""
    rows = spark.createDataFrame(list(TEMPLATES.items()), "name string, text string").coalesce(1)
    rows = rows.withColumn("s", shingle_hashes(word_array(F.col("text"))))
    starts = F.sequence(F.lit(1), F.greatest(F.size("s") - (PIECE - 1), F.lit(1)), F.lit(1))
    rows = rows.withColumn("b", F.flatten(F.transform(starts, lambda i: bands(F.slice(F.col("s"), i, F.lit(PIECE))))))
    return {r.name: (sorted(set(r.s)), sorted(set(r.b)) if len(r.s) >= PIECE else []) for r in rows.collect()}


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment): the templates that each document contains."""
    tables = template_tables(docs.sparkSession)
    known = sorted({h for shingles, _ in tables.values() for h in shingles})
    rows = once(docs, [id_col], "_w", word_array(F.coalesce(F.col(text_col), F.lit(""))))
    rows = once(rows, [id_col], "_s", shingle_hashes(F.col("_w")))
    # Places of template shingles, and of those the windows that hold one.
    rows = once(rows, [id_col, "_s"], "_at", F.filter(F.transform("_s", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull()))
    rows = rows.filter(F.size("_at") > 0)
    span = WINDOW // STEP
    first = F.array_distinct(F.flatten(F.transform("_at", lambda i: F.transform(F.sequence(F.greatest(F.floor(i / STEP) - (span - 1), F.lit(0)), F.floor(i / STEP)), lambda k: (k * STEP).cast("int")))))
    rows = once(rows, [id_col, "_s"], "_first", first)
    rows = once(rows, [id_col, "_s"], "_bands", F.flatten(F.transform("_first", lambda k: bands(F.slice(F.col("_s"), k + 1, F.lit(WINDOW))))))
    hits = []
    for name, (shingles, own) in sorted(tables.items()):
        share = F.size(F.array_intersect("_s", _longs(shingles))) / F.lit(float(len(shingles)))
        met = F.arrays_overlap("_bands", _longs(own)) if own else F.lit(True)
        hits.append(F.when(met, F.struct(F.lit(name).alias("license"), share.alias("containment"))))
    return (
        rows.select(id_col, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_hit"))
        .select(id_col, "_hit.license", "_hit.containment")
        .filter(F.col("containment") >= CONTAINED)
    )


def oracle() -> str:
    """The same relation in DuckDB: containment of each template's shingles in each document, without retrieval."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH template AS (SELECT name, {words.format('t')} AS w FROM (VALUES {values}) AS x(name, t)),
ts AS (SELECT DISTINCT name, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM template)),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))
SELECT doc_id, name AS license, count(*)::DOUBLE / any_value(n) AS containment
FROM s JOIN ts USING (s) JOIN (SELECT name, count(*) AS n FROM ts GROUP BY name) USING (name)
GROUP BY doc_id, name HAVING count(*) >= {CONTAINED} * any_value(n)"""
