"""License scans: passages of documents against licence templates, by Dice over word bigrams; DataFrame operations only.

Texts are normalised as a whole (lower case; every run of other than letters and digits is one blank,
so line ends and comment marks split nothing). A passage is any window of the text's bigrams.
Dice = 2 |A and B| / (|A| + |B|) over the sets of bigrams of passage and template. It can reach d only if
|A and B| >= d / (2 - d) * |B| and |A| <= (2 - d) / d * |B|: so a template is held only against documents
with so many of its bigrams, and from each of these windows of every length grow up to (2 - d) / d times
the template's own. (A best window begins at a bigram of the template, as leaving out others gains.)
Beginnings of matching windows at most half a template apart are one passage. Bigrams are told by 64 bits.

Rows: null and empty texts, and texts of fewer than two words, match nothing; ties stay, as each
licence has its own row; the passages of rows that repeat an id add up; very long texts are scanned
whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICE = 0.8
STRIDE = 1024

#: Notices and first paragraphs of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
}


def words_of(text: str) -> list[str]:
    """A template's words, as the columns have them."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """A template's distinct bigrams."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _places(text: str) -> int:
    """How many bigrams a template has, with repeated ones."""
    return len(words_of(text)) - 1


def _longest(text: str, dice: float) -> int:
    """How many bigrams a passage may have."""
    return int((2 - dice) / dice * _places(text) + 1e-9)


def _made(value: Column, name: str) -> Column:
    """A value computed once, however often it is used: optimiser rules don't copy what a generator puts out."""
    return F.explode(F.array(value)).alias(name)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, licence, n_passages, dice) per document and licence with a passage of at least that Dice; dice is the greatest."""
    given = templates or TEMPLATES
    made = {k: bigrams_of(v) for k, v in given.items()}
    need = {k: dice / (2 - dice) * len(b) for k, b in made.items()}
    code = lambda g: F.xxhash64(F.lit(g))
    every = F.array(*map(code, sorted(set().union(*made.values()))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    words = rows.select("doc_id", _made(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " "), "words"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    grams = words.select("doc_id", _made(F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b))), "grams"))
    known = grams.select("doc_id", "grams", _made(F.array_intersect("grams", every), "known")).where(F.size("known") >= min(need.values()))
    able = F.array(*[
        F.struct(
            F.lit(k).alias("licence"), F.array(*map(code, b)).alias("bigrams"), F.lit(need[k]).alias("need"),
            F.lit(_longest(given[k], dice)).alias("longest"), F.lit(_places(given[k]) // 2).alias("apart"),
        )
        for k, b in made.items()
    ])
    pairs = known.select("doc_id", "grams", "known", F.explode(able).alias("t")).select("*", _made(F.array_intersect("known", "t.bigrams"), "own"))
    pairs = pairs.where(F.size("own") >= F.col("t.need"))
    # Long texts are grown piece by piece; a piece holds the windows that begin in its first STRIDE places.
    pieces = pairs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "t", "own", "grams", F.explode(F.sequence(F.lit(0), F.size("grams") - 1, F.lit(STRIDE))).alias("at"))
    pieces = pieces.select("row", "doc_id", "t", "own", "at", _made(F.slice("grams", F.col("at") + 1, STRIDE + F.col("t.longest")), "piece"))
    starts = F.filter(F.sequence(F.lit(1), F.least(F.lit(STRIDE), F.size("piece"))), lambda i: F.array_contains("own", F.element_at("piece", i)))
    windows = F.transform(starts, lambda i: F.struct((F.col("at") + i).alias("start"), F.slice("piece", i, F.col("t.longest")).alias("grams")))
    spread = pieces.select("row", "doc_id", "t", "own", F.explode(windows).alias("w"))

    def grow(state: Column, at: Column) -> Column:
        """The window gets one more bigram, which counts if it is the first of its like in it."""
        size = state["size"] + at["new"].cast("int")
        both = state["both"] + (at["new"] & at["hit"]).cast("int")
        return F.struct(size.alias("size"), both.alias("both"), F.greatest(state["dice"], 2.0 * both / (size + F.size("t.bigrams"))).alias("dice"))

    cells = F.transform("w.grams", lambda g, k: F.struct((F.array_position("w.grams", g) == k + 1).alias("new"), F.array_contains("own", g).alias("hit")))
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"))
    best = F.aggregate(cells, none, grow)["dice"]
    met = spread.select("row", "doc_id", "t.licence", "t.apart", "w.start", best.alias("dice")).where(F.col("dice") >= dice)
    before = F.lag("start").over(Window.partitionBy("row", "licence").orderBy("start"))
    told = met.withColumn("first", F.coalesce(F.col("start") - before > F.col("apart"), F.lit(True)))
    return told.groupBy("doc_id", "licence").agg(F.count_if("first").alias("n_passages"), F.max("dice").alias("dice"))


def oracle_sql(templates: dict[str, str] | None = None, dice: float = DICE) -> str:
    """The same for DuckDB, by rows of bigrams and joins on their places."""
    given = templates or TEMPLATES
    bigrams = ", ".join("('{}', '{}')".format(k, x.replace("'", "''")) for k, v in given.items() for x in bigrams_of(v))
    sizes = ", ".join(f"('{k}', {len(bigrams_of(v))}, {_places(v) // 2}, {_longest(v, dice)})" for k, v in given.items())
    return f"""
with bigrams(licence, g) as (values {bigrams}),
sizes(licence, b, apart, longest) as (values {sizes}),
texts as (
  select row_number() over () as r, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') as w
  from documents where text is not null),
grams as materialized (
  select r, doc_id, unnest(range(1, len(w))) as i, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) as g from texts where len(w) > 1),
hits as materialized (select r, doc_id, i, licence, g from grams join bigrams using (g)),
able as (
  select r, licence from hits join sizes using (licence)
  group by r, licence, b having count(distinct g) >= {dice / (2 - dice)!r} * b),
seen as materialized (
  select r, doc_id, i, g, lag(i) over (partition by r, g order by i) as before from grams where r in (select r from able)),
grown as (
  select h.r, h.doc_id, h.licence, h.i, s.b, s.apart, coalesce(x.before < h.i, true) as new, t.g is not null as hit, x.i as k
  from hits h join able using (r, licence) join sizes s using (licence) join seen x on x.r = h.r and x.i between h.i and h.i + s.longest - 1
  left join bigrams t on t.licence = h.licence and t.g = x.g),
windows as (
  select *, count(*) filter (new) over upto as a, count(*) filter (new and hit) over upto as shared from grown
  window upto as (partition by r, licence, i order by k rows unbounded preceding)),
best as (select r, doc_id, licence, i, apart, max(2.0::double * shared / (a + b)) as dice from windows group by all having max(2.0::double * shared / (a + b)) >= {dice!r}),
told as (select *, coalesce(i - lag(i) over (partition by r, licence order by i) > apart, true) as new from best)
select doc_id, licence, count(*) filter (new) as n_passages, max(dice) as dice from told group by all"""
