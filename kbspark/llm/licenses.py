"""License scans, with DataFrame functions only.

Texts and templates are words; a shingle is five words. Overlapping windows of a text retrieve templates by
MinHash: every band holds one minimum (a band of one row), so a window and a template's window that share
the share J of their shingles meet with probability 1 - (1 - J) ** BANDS. Long templates are cut into windows
at every word, so a copy's windows have equals among them wherever it starts: with one word of twenty
changed (J = 0.52) a window is found with probability 0.947, and a template has many. Templates shorter
than a window are met by windows of one shingle at every word, whose minimum is the shingle itself: there the
probability is 1. What is retrieved is verified by exact containment of the template's shingles.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Words of a window, words from one window to the next, and bands.
WINDOW, STEP, BANDS = 20, 8, 4
CONTAINMENT = 0.8
#: Words of all templates together: they become part of the plan.
TEMPLATE_WORDS = 50_000

#: Texts of public licenses and of the usual notices (fixed values).
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You"
        " may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in"
        " the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(words: Column) -> Column:
    """The hashes of a text's shingles, in order; fewer than five words have none."""

    def hashed(one):
        of = lambda i: F.xxhash64(*(F.get(one, i + k) for k in range(SHINGLE)))
        return F.when(F.size(one) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(one) - SHINGLE), of)).otherwise(F.array().cast("array<long>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


#: Each band's permutation of the hashes is an exclusive or with its seed.
SEEDS = [0x5851F42D4C957F2D * (k + 1) % (1 << 63) for k in range(BANDS)]
WIDTH = WINDOW - SHINGLE + 1


def _minima(values: Column) -> Column:
    """The minimum of the values under each permutation."""
    def least(seed):
        return F.array_min(F.transform(values, lambda v: v.bitwiseXOR(F.lit(seed))))

    return F.array(*map(least, SEEDS))


def _marked(minima: Column) -> Column:
    """Band values: minima told apart by band."""
    return F.array(*(F.xxhash64(F.lit(k), F.get(minima, F.lit(k))) for k in range(BANDS)))


def _all_bands(shingles: Column) -> Column:
    """The band values of the windows at every word (for templates, which are short)."""
    starts = F.sequence(F.lit(1), F.size(shingles) - WIDTH + 1)
    return F.flatten(F.transform(starts, lambda i: _marked(_minima(F.slice(shingles, i, WIDTH)))))


def _bands(shingles: Column) -> Column:
    """The band values of the windows of a text, from one to the next STEP words, and of the last words' window.

    A window is two blocks of STEP shingles, so every shingle is looked at once for each band."""
    n = F.size(shingles)
    block = lambda b: _let(F.array(*(F.get(shingles, b * STEP + i) for i in range(STEP))), _minima)
    last = _marked(_minima(F.transform(F.sequence(n - WIDTH, n - 1), lambda i: F.get(shingles, i))))

    def windows(blocks):
        pair = lambda b: F.zip_with(F.get(blocks, b), F.get(blocks, b + 1), lambda x, y: F.least(x, y))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks) - 2), lambda b: _let(pair(b), _marked)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / STEP).cast("int") - 1), block)
    return F.when(n >= WIDTH, F.concat(_let(blocks, windows), last)).otherwise(F.array().cast("array<long>"))


def _compiled(spark: SparkSession, templates: dict[str, str]):
    """(name, band values or shingles that retrieve it, shingle texts) of each template."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.select("name", _words(F.col("text")).alias("w"))
    keys = F.when(F.size("w") >= WINDOW, _let(_shingles(F.col("w")), _all_bands)).otherwise(_shingles(F.col("w")))
    found = rows.select("name", F.size("w").alias("n"), F.array_distinct(keys).alias("keys"), F.array_distinct(_texts(F.col("w"))).alias("texts")).collect()
    if sum(r["n"] for r in found) > TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {TEMPLATE_WORDS} words")
    if short := [r["name"] for r in found if r["n"] < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return found


def _texts(words: Column) -> Column:
    """The shingles themselves, in order."""

    def of(w):
        shingle = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(SHINGLE)))
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), shingle)).otherwise(F.array().cast("array<string>"))

    return _let(words, of)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """(key, license, containment, first_word) for every template that a row's text holds.

    containment: the share of the template's different shingles that occur in the text, `least` or more;
    first_word: the place (from 0) of the first of them. Letters and digits in lower case are compared, so
    case and punctuation do not matter. A text that holds several templates has a row for each. Null and
    empty texts and texts of fewer than five words hold none; repeated rows are scanned alike; a null key is
    kept. Whole texts are scanned, whatever their length. There is no shuffle.
    """
    spark = docs.sparkSession
    known = _compiled(spark, TEMPLATES if templates is None else templates)
    if not known:
        return spark.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, license string, containment double, first_word int")
    long = [r for r in known if r["n"] >= WINDOW]
    by_shingle = sorted({k for r in known if r["n"] < WINDOW for k in r["keys"]})
    by_band = sorted({k for r in long for k in r["keys"]})
    def met(shingles):
        return F.array_union(F.array_intersect(shingles, _longs(by_shingle)), F.array_intersect(_bands(shingles), _longs(by_band)))

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.select("_key", "_text", _let(_words(F.col("_text")), lambda w: _let(_shingles(w), met)).alias("_met")).where(F.size("_met") > 0)
    # few rows are left; the row number keeps the optimizer from working out _met anew for later conditions
    rows = rows.select("_key", "_met", _texts(_words(F.col("_text"))).alias("_texts"), F.monotonically_increasing_id().alias("_row"))
    table = F.from_json(F.lit(json.dumps([{"name": r["name"], "keys": r["keys"], "texts": r["texts"]} for r in known])), "array<struct<name: string, keys: array<long>, texts: array<string>>>")
    pairs = rows.select("_key", "_texts", F.explode(F.filter(table, lambda t: F.arrays_overlap(t["keys"], F.col("_met")))).alias("t"))
    held = F.array_intersect("t.texts", "_texts")
    pairs = pairs.select("_key", "t.name", (F.size(held) / F.size("t.texts")).alias("containment"), F.array_min(F.transform(held, lambda x: F.array_position(F.col("_texts"), x))).alias("at"))
    return pairs.where(F.col("containment") >= least).select(F.col("_key").alias(key), F.col("name").alias("license"), "containment", (F.col("at") - 1).cast("int").alias("first_word"))


def _longs(values: list[int]) -> Column:
    """One array constant; as many single constants would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")
