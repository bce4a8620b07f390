"""Licence scan: Dice coefficient over word bigrams against licence templates.

Each line of a text, each run of lines (a notice that is wrapped), and the whole text where it
has several lines, is normalised to its words of ASCII letters in lower case (numbers, and with
them versions, do not count) and compared to every template whose size allows the wanted
coefficient: with a and b distinct bigrams, 2 * common / (a + b) >= t needs
a >= b * t / (2 - t) and a <= b * (2 - t) / t. That bound on distinct bigrams is the only one.

A run is a longest sequence of two or more lines with words, blank ones aside, of each of which
at least half the distinct bigrams stand in templates; a line of one word has none and is in.

A text's lines are scored inside its row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import table

DICE = 0.75

#: Wording of common licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction",
    ),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS'
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    ),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation",
    ),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details. You should have received a copy of the GNU General Public"
        " License along with this program.",
    ),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
        " is hereby granted",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(wording: str) -> list[tuple[str, str]]:
    words = re.sub("[^a-z]+", " ", wording.lower()).split()
    return sorted(set(zip(words, words[1:], strict=False)))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), "")


def _bigrams(words: Column) -> Column:
    at = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))))


def _hashes(pairs: list[tuple[str, str]]) -> Column:
    """The bigrams as _bigrams has them, parsed in one call; words hold letters alone."""
    return F.expr("array(" + ", ".join(f"xxhash64('{a}', '{b}')" for a, b in pairs) + ")")


def _known(bigrams: Column, templates) -> Column:
    """How many of the bigrams stand in some template."""
    return F.size(F.array_intersect(bigrams, _hashes(sorted({pair for _, wording in templates for pair in template_bigrams(wording)}))))


def _best(bigrams: Column, known: Column, templates, dice: float) -> Column:
    """The largest coefficient, and minus the place of the first template that has it; null if none can reach dice.

    With common <= known, a coefficient of dice needs known >= a * dice / (2 - dice) of the a bigrams.
    """
    scored = []
    for k, (_, wording) in enumerate(templates):
        own = template_bigrams(wording)
        n = len(own)
        fits = F.size(bigrams).between(-int(-(n * dice / (2 - dice)) // 1), int(n * (2 - dice) / dice))
        common = F.size(F.array_intersect(bigrams, _hashes(own)))
        score = F.when(fits, common * F.lit(2.0) / (F.size(bigrams) + n)).otherwise(F.lit(0.0))
        scored.append(F.struct(score.alias("dice"), F.lit(-k).alias("order")))
    return F.when(known * (2 - dice) + 1e-9 >= F.size(bigrams) * dice, F.array_max(F.array(*scored)))


def _runs(near: Column) -> Column:
    """(first, last), from 0, of each longest sequence of two or more true places."""
    places = F.filter(F.transform(near, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    first = F.filter(places, lambda i: (i == 0) | ~F.coalesce(F.get(near, i - 1), F.lit(False)))
    last = F.filter(places, lambda i: ~F.coalesce(F.get(near, i + 1), F.lit(False)))
    return F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda r: r["first"] < r["last"])


def _joined(lines: Column) -> Column:
    """The distinct bigrams of lines read as one text, from their own and those over line ends."""
    over = F.transform(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.xxhash64(x["last"], F.get(lines, i + 1)["first"]))
    return F.array_distinct(F.concat(F.flatten(F.transform(lines, lambda x: x["bigrams"])), over))


def scan_licenses(documents: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """The documents, all their columns, with n_license_lines, license, license_line and license_dice.

    n_license_lines counts the lines that by themselves reach the coefficient with some
    template. license is the best match's licence, license_line its first line from 0, or -1
    if the whole text matches better than any line or run; of equal coefficients the smallest
    line, then the first template, wins. Texts without a match, null and empty ones too, have 0
    lines and nulls.
    """
    names = F.array(*[F.lit(name) for name, _ in templates])
    added = ("_words", "_lines", "_near", "_parts", "_several", "_whole", "_top", "n_license_lines", "license", "license_line", "license_dice")
    own = [c for c in documents.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("line"), _words(line).alias("words")))
    # The inner transforms make what several expressions share once for a line.
    made = F.transform(
        F.filter("_words", lambda x: F.size(x["words"]) > 0),
        lambda x: F.struct(
            x["line"].alias("line"), F.get(x["words"], F.lit(0)).alias("first"), F.element_at(x["words"], -1).alias("last"), _bigrams(x["words"]).alias("bigrams")
        ),
    )
    told = F.transform(made, lambda x: F.struct(*[x[c].alias(c) for c in ("line", "first", "last", "bigrams")], _known(x["bigrams"], templates).alias("known")))
    scored = F.transform(
        told,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("line", "first", "last", "bigrams")],
            (2 * x["known"] >= F.size(x["bigrams"])).alias("near"),
            _best(x["bigrams"], x["known"], templates, dice).alias("best"),
        ),
    )
    lines = documents.select(*own, words.alias("_words")).select(*own, (F.size("_words") > 1).alias("_several"), scored.alias("_lines"))
    lines = lines.withColumn("_near", F.transform("_lines", lambda x: x["near"]))

    def unit(line: Column, lines: Column) -> Column:
        # The transforms bind lines and bigrams, which would else be made again for every element.
        bigrams = F.transform(F.transform(F.array(lines), _joined), lambda b: F.struct(b.alias("bigrams"), _known(b, templates).alias("known")))
        return F.element_at(F.transform(bigrams, lambda b: F.struct(line.alias("line"), _best(b["bigrams"], b["known"], templates, dice).alias("best"))), 1)

    some = F.exists("_lines", lambda x: x["near"] & (F.size(x["bigrams"]) > 0))
    parts = F.transform(
        F.when(some, _runs(F.col("_near"))).otherwise(F.array().cast("array<struct<first:int,last:int>>")),
        lambda r: unit(F.get("_lines", r["first"])["line"], F.slice("_lines", r["first"] + 1, r["last"] - r["first"] + 1)),
    )
    whole = F.when(F.col("_several"), unit(F.lit(-1), F.col("_lines")))
    matched = lines.select(*own, "_lines", parts.alias("_parts"), whole.alias("_whole"))

    def hits(units: Column) -> Column:
        ranked = F.transform(units, lambda x: F.struct(x["best"]["dice"].alias("dice"), (-x["line"]).alias("line"), x["best"]["order"].alias("order")))
        return F.filter(ranked, lambda x: x["dice"] >= dice)

    matched = matched.select(*own, hits(F.col("_lines")).alias("_lines"), hits(F.col("_parts")).alias("_parts"), hits(F.array("_whole")).alias("_whole"))
    best, whole = F.array_max(F.concat("_lines", "_parts")), F.get("_whole", F.lit(0))
    top = F.when(best.isNull() | (whole["dice"] > best["dice"]), F.coalesce(whole, best)).otherwise(best)
    return matched.select(*own, F.size("_lines").cast("long").alias("n_license_lines"), top.alias("_top")).select(
        *own,
        "n_license_lines",
        F.get(names, -F.col("_top.order")).alias("license"),
        (-F.col("_top.line")).alias("license_line"),
        F.col("_top.dice").alias("license_dice"),
    )


def _sql() -> str:
    """The same scan in DuckDB, over strings instead of hashes."""
    quoted = lambda pairs: "[" + ", ".join(f"'{a} {b}'" for a, b in pairs) + "]"
    rows = ", ".join(f"({k}, '{name}', {quoted(template_bigrams(w))})" for k, (name, w) in enumerate(TEMPLATES))
    known = quoted(sorted({pair for _, w in TEMPLATES for pair in template_bigrams(w)}))
    return f"""
WITH templates(k, name, t) AS (VALUES {rows}),
lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
    FROM documents
), worded AS (
    SELECT doc_id, pos, [x FOR x IN string_split(trim(regexp_replace(lower(line), '[^a-z]+', ' ', 'g')), ' ') IF x <> ''] AS w
    FROM lines
), paired AS (
    SELECT doc_id, pos, w, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM worded WHERE len(w) > 0
), placed AS (
    SELECT *, 2 * len(list_intersect(b, {known})) >= len(b) AS near, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM paired
), runs AS (
    SELECT doc_id, min(pos) AS pos, flatten(list(w ORDER BY pos)) AS w, 1 AS kind
    FROM (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM placed WHERE near)
    GROUP BY doc_id, run HAVING count(*) > 1
), whole AS (
    SELECT doc_id, -1 AS pos, flatten(list(w ORDER BY pos)) AS w, 2 AS kind FROM worded GROUP BY doc_id HAVING count(*) > 1
), pairs AS (
    SELECT doc_id, pos, b, 0 AS kind FROM paired
    UNION ALL
    SELECT doc_id, pos, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), kind
    FROM (SELECT * FROM runs UNION ALL SELECT * FROM whole)
), scored AS (
    SELECT doc_id, pos, kind, k, name, len(list_intersect(b, t)) * 2.0::DOUBLE / (len(b) + len(t)) AS dice
    FROM pairs JOIN templates
      ON len(b) >= ceil(len(t) * {DICE}::DOUBLE / (2 - {DICE}::DOUBLE)) AND len(b) <= floor(len(t) * (2 - {DICE}::DOUBLE) / {DICE}::DOUBLE)
), hits AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, kind = 2, pos, k) AS nth FROM scored WHERE dice >= {DICE}
), counted AS (
    SELECT doc_id, count(DISTINCT pos) FILTER (kind = 0) AS n FROM hits GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_license_lines, name AS license, pos::INTEGER AS license_line, dice AS license_dice
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN (SELECT * FROM hits WHERE nth = 1) USING (doc_id)
"""


NAME = "op6_license_scan"
ORACLE_SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_license_lines", "license", "license_line", "license_dice"
    )
