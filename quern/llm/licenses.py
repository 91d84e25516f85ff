"""License scans: the texts' units against license templates by Dice over word bigrams.

Texts are normalised (lower case, runs of other characters than letters and digits become one
space). The units of a text are its lines, its paragraphs (between blank lines), the whole text,
and, for each template, runs of its words: windows of five lengths between the least and the most
bigrams that can match (``ladder``), from each place where a bigram of the template stands. So a
notice is found inside a longer line, over several paragraphs and above other text. Two units with
bigram sets A and B have the Dice coefficient 2 |A & B| / (|A| + |B|). It can reach ``THRESHOLD`` =
t only if |A| is between t / (2 - t) and (2 - t) / t times |B|, and |A & B| at least t / (2 - t)
times |B|.

Everything is a column expression in one narrow pass: no shuffle, no Python. A text is split into
words once, its bigrams are hashed (64 bits), and those that no template has are dropped. A text's
number of a template's bigrams alone rules out most templates; only for the others are its units
made. The templates are one constant table of the plan, so the plan does not grow with them.

Defined cases: null, empty and blank texts, and units under two words, match nothing; a template
under two words is refused; equal coefficients go to the alphabetically first template; repeated
units count once. Extra columns are kept; ``license``, ``dice``, ``licenses`` are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Names and texts of license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}

_OTHER = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), _OTHER, " ")), " ")


def bigrams(unit: Column) -> Column:
    """The hashed word bigrams of a text, normalised, in order and with repeats."""
    return _pairs(words(unit))


def _pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold with n bigrams."""
    within = [m for m in range(1, int(n * 2 / threshold) + 2) if 2 * min(m, n) / (m + n) >= threshold]
    return within[0], within[-1]


def ladder(n: int, threshold: float) -> list[int]:
    """Lengths, in bigrams, of the windows that are held against a template of n."""
    low, high = size_bounds(n, threshold)
    return sorted({low, (low + n) // 2, n, (n + high) // 2, high})


def template_table(spark, templates: dict[str, str], threshold: float) -> list[dict]:
    """name, grams (distinct), n, need (that a text must share), low, high and windows of each template.

    The bigrams are made by the same expression as the texts'.
    """
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", F.array_distinct(bigrams(F.col("text"))).alias("grams")).collect()
    short = [r["name"] for r in rows if not r["grams"]]
    if short:
        raise ValueError(f"templates of under two words: {short}")
    out = []
    for r in rows:
        n = len(r["grams"])
        low, high = size_bounds(n, threshold)
        need = math.ceil(n * threshold / (2 - threshold) - 1e-9)
        out.append({"name": r["name"], "grams": list(r["grams"]), "n": n, "need": need, "low": low, "high": high, "windows": ladder(n, threshold)})
    return out


_TABLE = "array<struct<name:string,grams:array<bigint>,n:int,need:int,low:int,high:int,windows:array<int>>>"


def _constant(table: list[dict]) -> Column:
    """The table as one constant, however many rows it has."""
    return F.from_json(F.lit(json.dumps(table)), _TABLE)


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns with license and dice (of the best match, else null) and licenses (all names)."""
    known = TEMPLATES if templates is None else templates
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("license", "dice", "licenses")]
    if not known:
        return docs.select(*names, F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.array().cast("array<string>").alias("licenses"))
    table = template_table(docs.sparkSession, known, threshold)
    every = F.from_json(F.lit(json.dumps(sorted({g for t in table for g in t["grams"]}))), "array<bigint>")
    text = F.col(f"`{text_col}`")

    def dice(unit: Column, t: Column) -> Column:
        """The coefficient of a unit (an array of bigrams) with a template; null where sizes rule it out."""
        return F.element_at(F.transform(F.array(F.array_distinct(unit)), lambda u: F.when(F.size(u).between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(u, t["grams"])) / (F.size(u) + t["n"]))), 1)

    def best(t: Column) -> Column:
        whole = F.col("__lic_grams")
        places = F.filter(F.transform(whole, lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull())
        text = F.col("__lic_text")
        units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))
        runs = F.flatten(F.transform(t["windows"], lambda w: F.transform(places, lambda i: dice(F.slice(whole, i, w), t))))
        return F.greatest(F.array_max(runs), F.array_max(F.transform(units, lambda u: dice(bigrams(u), t))))

    rows = docs.select(*names, text.alias("__lic_text"), words(text).alias("__lic_words"))
    rows = rows.select(*names, "__lic_text", _pairs(F.col("__lic_words")).alias("__lic_grams"))
    rows = rows.select(*names, "__lic_text", "__lic_grams", F.array_intersect("__lic_grams", every).alias("__lic_hits"))
    likely = F.filter(_constant(table), lambda t: (F.size("__lic_hits") >= t["need"]) & (F.size(F.array_intersect(F.col("__lic_hits"), t["grams"])) >= t["need"]))
    scored = F.transform(likely, lambda t: F.struct((-best(t)).alias("order"), t["name"].alias("name")))
    found = rows.select(*names, F.array_sort(F.filter(scored, lambda x: x["order"] <= -threshold)).alias("__lic_found"))
    first = F.get("__lic_found", F.lit(0))
    return found.select(*names, first["name"].alias("license"), (-first["order"]).alias("dice"), F.coalesce(F.array_sort(F.col("__lic_found.name")), F.array().cast("array<string>")).alias("licenses"))
