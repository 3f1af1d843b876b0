"""Licence notices in texts by Dice coefficients over word bigrams, with DataFrame functions only.

A text is normalised (lower case, everything but letters and digits as space) and compared with
templates passage by passage: each line, each paragraph of several lines, and the whole text. Passages and
templates are sets of word bigrams. With m and n bigrams a coefficient of t is out of reach unless
``t m <= (2 - t) n`` and ``t n <= (2 - t) m``, so a passage is compared with the templates between these bounds
only. Most passages end before their bigrams are listed: they have at most as many as words less one, and at least
as many as different words less one. Everything happens within a row, so there is no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per cent.
THRESHOLD = 80

#: Notices and licence texts as their authors publish them; a parameter of the operator.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bigrams_of(template: str) -> list[str]:
    """The different bigrams of a template."""
    words = re.findall(r"[a-z0-9]+", template.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _passages(text: Column) -> Column:
    """Word lists of the lines, of the paragraphs of several lines, and of a text of several lines without
    paragraphs."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split(clean, "\n")
    paragraphs = F.filter(F.split(clean, r"\n ?\n"), lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(F.contains(clean, F.lit("\n")) & (clean.rlike(r"\n ?\n")), F.array(clean)).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, paragraphs, whole)


def _matches(name: str, bigrams: list[str], threshold: int) -> Column:
    """(minus the coefficient, name) of each passage that matches a template, passages between its bounds only."""
    own, m, low, high = F.array(*map(F.lit, bigrams)), len(bigrams), threshold, 200 - threshold
    near = F.filter("passages", lambda b: (low * m <= high * F.size(b)) & (low * F.size(b) <= high * m))
    sizes = F.transform(near, lambda b: F.struct(F.size(F.array_intersect(b, own)).alias("both"), (F.size(b) + m).alias("sizes")))
    hits = F.filter(sizes, lambda x: 200 * x["both"] >= low * x["sizes"])
    return F.transform(hits, lambda x: F.struct((-2 * x["both"] / x["sizes"]).alias("minus"), F.lit(name).alias("name")))


def scan(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: dict[str, str] | None = None,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """A row per row of ``df``: id, ``license`` (the best match, ties by name), ``dice`` (its coefficient),
    ``licenses`` (names of all templates found, by name, with commas) and ``matches`` (pairs of a passage and a template that
    match). NULL names and coefficient, an empty list and 0 without a match.

    A match has a coefficient of ``threshold`` per cent at least. A NULL or empty text matches nothing; NULL and
    repeated ids are kept. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    texts = {name: bigrams_of(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    known = [(name, bigrams) for name, bigrams in sorted(texts.items()) if bigrams]
    low, high = threshold, 200 - threshold  # t and 2 - t, in per cent
    least = min((-(-low * len(b) // high) for _, b in known), default=1)
    most = max((high * len(b) // low for _, b in known), default=0)
    rows = df.select(F.col(id_column).alias("id"), _passages(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("passages"))
    # A passage of w words takes 2 w - 1 characters at least.
    rows = rows.withColumn("passages", F.filter("passages", lambda p: F.char_length(p) >= 2 * least + 1))
    words = F.transform("passages", lambda p: F.filter(F.split(p, r"[ \n]+"), lambda w: w != ""))
    rows = rows.withColumn("passages", F.filter(words, lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) - 1 <= most)))
    pairs = F.transform(
        "passages",
        lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.size(w) - 1), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))),
    )
    rows = rows.withColumn("passages", pairs)
    found = [_matches(name, bigrams, threshold) for name, bigrams in known]
    none = F.array().cast("array<struct<minus:double,name:string>>")
    rows = rows.select("id", F.array_sort(F.concat(none, *found)).alias("found"))
    best = F.get("found", F.lit(0))
    return rows.select(
        F.col("id").alias(id_column),
        best["name"].alias("license"),
        (-best["minus"]).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct("found.name")), ",").alias("licenses"),
        F.size("found").cast("long").alias("matches"),
    )


def oracle(templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> str:
    """The same over ``documents`` in DuckDB SQL, every passage with every template."""
    known = {name: bigrams_of(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams)}])" for name, bigrams in known.items())
    return rf"""
WITH t(name, own) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS c FROM documents),
p AS (
  SELECT r, unnest(string_split(c, chr(10))) AS p FROM d
  UNION ALL SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(c, '\n ?\n')) AS p FROM d) WHERE contains(p, chr(10))
  UNION ALL SELECT r, c FROM d WHERE regexp_matches(c, '\n ?\n')),
w AS (SELECT r, row_number() OVER () AS k, regexp_extract_all(p, '[^ \n]+') AS w FROM p),
b AS (SELECT r, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM w WHERE len(w) >= 2),
m AS (
  SELECT r, name, 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice FROM b, t
  WHERE 200 * len(list_intersect(b, own)) >= {threshold} * (len(b) + len(own))),
g AS (
  SELECT r, count(*) AS matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
         max(dice)::DOUBLE AS dice, min(CASE WHEN dice = top THEN name END) AS license
  FROM (SELECT *, max(dice) OVER (PARTITION BY r) AS top FROM m) GROUP BY r)
SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(matches, 0)::BIGINT AS matches
FROM d LEFT JOIN g USING (r)"""
