"""Licence scans: Dice coefficient of word bigrams between passages and licence templates."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import col

LEAST_DICE = 0.8
#: Letters of a stem of a word.
STEM = 5

#: Customary notices of licences, opening passages of long texts and whole short texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]

#: Letters and digits stay, and line ends, to find passages; all else separates words.
OTHER = r"[^\p{L}\p{N}\n]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _rows(templates: list[tuple[str, str]]) -> list[dict]:
    out = []
    for name, text in templates:
        words = template_words(text)
        grams = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        out.append({"name": name, "n": len(words) - 1, "first": " ".join(words[:2]), "grams": [{"gram": g, "n": n} for g, n in sorted(grams.items())]})
    return out


def size_bounds(n: int, least: float) -> tuple[float, float]:
    """The sizes that a bag can have to reach `least` with one of n: all of the smaller one shared."""
    return least / (2 - least) * n, (2 - least) / least * n


def least_shared(n: int, least: float) -> int:
    """How many of a bag of n a matching one shares with it at least, whatever its size within the bounds."""
    low, high = size_bounds(n, least)
    return min(math.ceil(least * (m + n) / 2 - 1e-9) for m in range(max(1, math.ceil(low - 1e-9)), math.floor(high + 1e-9) + 1))


def telling_stems(templates: list[tuple[str, str]], least: float, letters: int = STEM) -> list[str]:
    """A few stems of words, one of which every matching passage of every template holds; those of under `letters` are whole words.

    A match shares least_shared() of a template's bigrams. If words with one of the stems stand in more
    bigrams than may be missing, one of these is shared. Stems are taken that cover most of what is
    still open; a template without enough long words gives all of its words."""
    wanted, stems_of = [], []
    for _, text in templates:
        words = template_words(text)
        pairs = list(zip(words, words[1:]))
        long = {w[:letters] for w in words if len(w) >= letters}
        if sum(any(len(w) >= letters for w in p) for p in pairs) <= len(pairs) - least_shared(len(pairs), least):
            long |= set(words)
        wanted.append(len(pairs) - least_shared(len(pairs), least) + 1)
        stems_of.append([{x for w in p for x in long if (x in w if len(x) >= letters else x == w)} for p in pairs])
    chosen: list[str] = []
    often = Counter(x for pairs in stems_of for p in pairs for x in p)
    while True:
        open_ = [n - sum(bool(x & set(chosen)) for x in pairs) for n, pairs in zip(wanted, stems_of, strict=True)]
        if max(open_, default=0) <= 0:
            return sorted(chosen)
        gain: Counter = Counter()
        for n, pairs in zip(open_, stems_of, strict=True):
            if n > 0:
                for stem, k in Counter(x for p in pairs if not p & set(chosen) for x in p).items():
                    gain[stem] += min(n, k)
        chosen.append(min(gain, key=lambda x: (-gain[x], often[x], x)))


def _spaces(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))


def passages(clean: Column, low: int, high: int) -> Column:
    """Normalised lines, paragraphs between blank lines, and the whole text: those of low to high bigrams, each once.

    A line has a space less than words. In longer passages each gap has at most one more space than
    line ends, so spaces less line ends are at most the words: most are too long by that alone, and
    only the others are brought to one line."""
    middle, half = (low + high) / 2, (high - low) / 2

    def fits(p: Column) -> Column:
        return F.abs(_spaces(p) - middle) <= half  # the count is made once

    def short(p: Column) -> Column:
        return _spaces(p) - (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))) <= high + 2

    def one_line(p: Column) -> Column:
        return F.trim(F.regexp_replace(p, "[ \n]+", " "))

    lines = F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), fits)
    blank = F.contains(clean, F.lit("\n\n")) | F.contains(clean, F.lit("\n \n"))
    blocks = F.filter(F.when(blank, F.split(clean, "\n ?\n[ \n]*")).otherwise(F.array().cast("array<string>")), short)
    whole = F.when(F.contains(clean, F.lit("\n")) & short(clean), F.array(clean)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(lines, F.filter(F.transform(F.concat(blocks, whole), one_line), fits)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_DICE, templates: list[tuple[str, str]] = TEMPLATES, windows: bool = False) -> DataFrame:
    """doc_id, licenses, n_passages, best_dice of every row of docs; with windows also notices and best_window.

    A passage names the licence of the template with which its bag of word bigrams has the highest
    Dice coefficient, if that is `least` or more; of equal ones the first identifier. licenses has
    the identifiers in order, comma-joined ('' if none), n_passages counts the distinct passages
    that name one, best_dice is 0 if none does. Templates whose size bounds
    the passage misses are not compared. A null text has no passages of note; ids may be null or
    repeated; no rows give no rows; other columns are ignored. Each row is judged where it is.

    Passages end where lines and paragraphs do. Windows find notices among other words: of the whole
    text on one line, a template's begin where a run of its bigrams does, or with its first bigram, and
    are as long as the template, or end with the text. Where one has a coefficient of `least` or more,
    all templates are compared from there, and the template that shares most bigrams, of those with
    `least` or more, is named (of equal ones that of the higher coefficient, then the first
    identifier). notices has their identifiers, best_window the highest coefficient of a named one
    (0 if none). No window is left out, however many there are."""
    rows = _rows(templates)
    bounds = [size_bounds(r["n"], least) for r in rows]
    low, high = math.ceil(min(b[0] for b in bounds)), math.floor(max(b[1] for b in bounds))
    schema = "array<struct<name string, n int, grams array<struct<gram string, n int>>>>"
    table = F.from_json(F.lit(json.dumps(rows)), schema)

    def bag(p: Column) -> Column:
        words = F.split(p, " ")
        return F.struct(p.alias("p"), F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)).alias("grams"))

    def dice(b: Column, t: Column) -> Column:
        shared = F.aggregate(t["grams"], F.lit(0), lambda acc, g: acc + F.least(g["n"], F.size(b["grams"]) - F.size(F.array_remove(b["grams"], g["gram"]))))
        return 2.0 * shared / (F.size(b["grams"]) + t["n"])

    # a matching bag shares least_shared() bigrams, all but the template's repeats of them different ones
    distinct = [least_shared(r["n"], least) - (r["n"] - len(r["grams"])) for r in rows]
    known = F.from_json(F.lit(json.dumps(sorted({g["gram"] for r in rows for g in r["grams"]}))), "array<string>")

    def may_match(b: Column) -> Column:
        return F.size(F.array_intersect(b["grams"], known)) >= max(1, min(distinct))

    def best(b: Column) -> Column:
        fitting = F.filter(table, lambda t: (F.size(b["grams"]) >= least / (2 - least) * t["n"]) & (F.size(b["grams"]) <= (2 - least) / least * t["n"]))
        scored = F.transform(fitting, lambda t: F.struct(dice(b, t).alias("dice"), t["name"].alias("name")))
        first = lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)
        return F.get(F.array_sort(F.filter(scored, lambda s: s["dice"] >= least), first), 0)

    # each step is a column of its own, so that what several parts of the next one use is computed once
    lower = docs.select(col(id_col).alias("doc_id"), F.lower(F.coalesce(col(text_col), F.lit(""))).alias("lower"))
    # most texts hold none of the stems that every match has, and no passage of theirs needs to be looked at
    stems = telling_stems(templates, least)
    parts = [F.contains("lower", F.lit(x)) for x in stems if len(x) >= STEM]
    if short := [x for x in stems if len(x) < STEM]:
        parts.append(F.rlike("lower", F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(short)})(?![\p{{L}}\p{{N}}])")))
    telling = reduce(lambda a, b: a | b, parts)
    clean = lower.select("doc_id", F.when(telling, F.regexp_replace("lower", OTHER, " ")).otherwise("").alias("clean"))
    more = ["windows"] if windows else []
    if windows:
        clean = _with_windows(clean, rows, distinct, least)
    fit = clean.select("doc_id", passages(F.col("clean"), low, high).alias("fit"), *more)
    found = fit.select("doc_id", F.filter(F.transform(F.filter(F.transform("fit", bag), may_match), best), lambda m: m.isNotNull()).alias("found"), *more)
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["name"]))), ",").alias("licenses"),
        F.size("found").cast("long").alias("n_passages"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["dice"])), F.lit(0.0)).alias("best_dice"),
        *([
            F.array_join(F.array_sort(F.array_distinct(F.transform("windows", lambda s: s["name"]))), ",").alias("notices"),
            F.coalesce(F.array_max(F.transform("windows", lambda s: s["dice"])), F.lit(0.0)).alias("best_window"),
        ] if windows else []),
    )


def _with_windows(clean: DataFrame, rows: list[dict], distinct: list[int], least: float) -> DataFrame:
    """doc_id, clean and windows: the named windows as (shared, dice, place, name, begins), place being the order among equals.

    A text without the different bigrams that a match with some template shares has no windows of it;
    that is known from one intersection, and only texts that pass it keep their bigrams."""
    order = sorted(range(len(rows)), key=lambda t: (rows[t]["name"], t))
    table = F.from_json(
        F.lit(json.dumps([
            {
                "name": rows[t]["name"], "place": -i, "n": rows[t]["n"], "need": max(1, distinct[t]), "first": rows[t]["first"],
                "grams": [g["gram"] for g in rows[t]["grams"]], "repeats": [g for g in rows[t]["grams"] if g["n"] > 1],
            }
            for i, t in enumerate(order)
        ])),
        "array<struct<name string, place int, n int, need int, first string, grams array<string>, repeats array<struct<gram string, n int>>>>",
    )
    known = F.from_json(F.lit(json.dumps(sorted({g["gram"] for r in rows for g in r["grams"]}))), "array<string>")

    def words() -> Column:
        return F.split(F.trim(F.regexp_replace("clean", "[ \n]+", " ")), " ")

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def shared(w: Column, t: Column) -> Column:
        # a bag's repeats count as often as the template has them
        again = F.aggregate(t["repeats"], F.lit(0), lambda acc, g: acc + F.greatest(F.lit(0), F.least(g["n"], F.size(F.filter(w, lambda x: x == g["gram"]))) - 1))
        return F.size(F.array_intersect(w, t["grams"])) + again

    def scored(w: Column, t: Column, begins: Column) -> Column:
        return F.transform(F.array(shared(w, t)), lambda k: F.struct(k.alias("shared"), (2.0 * k / (F.size(w) + t["n"])).alias("dice"), t["place"].alias("place"), t["name"].alias("name"), begins.alias("begins")))

    def at(i: Column) -> Column:
        gram, last = F.get(F.col("grams"), i - 1), F.coalesce(F.get(F.col("grams"), i - 2), F.lit(""))

        def begins(t: Column) -> Column:
            return (t["first"] == gram) | (F.array_contains(t["grams"], gram) & ~F.array_contains(t["grams"], last))

        compared = F.when(F.exists(F.col("near"), begins), F.col("near"))
        each = F.flatten(F.transform(compared, lambda t: F.flatten(F.transform(F.array(F.slice(F.col("grams"), i, t["n"])), lambda w: scored(w, t, begins(t))))))
        hits = F.filter(each, lambda s: s["dice"] >= least)
        return F.get(F.transform(F.array(hits), lambda h: F.when(F.exists(h, lambda s: s["begins"]), F.array_max(h))), 0)

    none = F.array().cast("array<string>")
    cut = clean.select("doc_id", "clean", F.when(F.length("clean") > 0, words()).otherwise(none).alias("words"))
    # the bigrams of the templates that the text has; few, so that templates are compared with these alone
    met = cut.select("doc_id", "clean", "words", F.when(F.size("words") > 1, F.array_intersect(pairs(F.col("words")), known)).otherwise(none).alias("met"))
    near = met.select("doc_id", "clean", "words", F.filter(table, lambda t: (F.size("met") >= t["need"]) & (F.size(F.array_intersect("met", t["grams"])) >= t["need"])).alias("near"))
    kept = near.select("doc_id", "clean", "near", F.when(F.size("near") > 0, pairs(F.col("words"))).otherwise(none).alias("grams"))
    begin = F.array_distinct(F.flatten(F.transform("near", lambda t: t["grams"])))
    first = kept.select("doc_id", "clean", "near", "grams", F.when(F.size("near") > 0, F.array_intersect(begin, F.col("grams"))).otherwise(none).alias("begin"))
    places = first.select("doc_id", "clean", "near", "grams", F.when(F.size("begin") > 0, F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains("begin", F.get("grams", i - 1)))).otherwise(F.array().cast("array<int>")).alias("places"))
    return places.select("doc_id", "clean", F.filter(F.transform("places", at), lambda m: m.isNotNull()).alias("windows"))


def scan_sql(least: float = LEAST_DICE, templates: list[tuple[str, str]] = TEMPLATES, windows: bool = False) -> str:
    """The scan of `documents` as DuckDB SQL: each passage against each template of fitting size, and each window against its template."""
    rows = _rows(templates)
    values = ",\n  ".join(
        f"({i}, '{r['name']}', {r['n']}, '{g['gram']}', {g['n']})" for i, r in enumerate(rows) for g in r["grams"]
    )
    firsts = ", ".join(f"({i}, '{r['first']}')" for i, r in enumerate(rows))
    return rf"""
WITH grams(t, name, size, gram, n) AS (VALUES
  {values}
), templates AS (SELECT DISTINCT t, name, size FROM grams),
clean AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS c FROM documents
), passages AS (
  SELECT DISTINCT row, p FROM (
    SELECT row, trim(unnest(string_split(c, chr(10)))) AS p FROM clean
    UNION ALL
    SELECT row, trim(regexp_replace(unnest(regexp_split_to_array(c, '\n ?\n[ \n]*')), '[ \n]+', ' ', 'g')) FROM clean
    UNION ALL
    SELECT row, trim(regexp_replace(c, '[ \n]+', ' ', 'g')) FROM clean
  )
), sized AS (
  SELECT row, p, len(p) - len(replace(p, ' ', '')) AS k FROM passages
), pairs AS (
  SELECT row, p, k, t, name, size FROM sized JOIN templates
    ON k >= {least!r}::DOUBLE / (2 - {least!r}::DOUBLE) * size AND k <= (2 - {least!r}::DOUBLE) / {least!r}::DOUBLE * size
), words AS (
  SELECT row, p, string_split(p, ' ') AS w FROM (SELECT DISTINCT row, p FROM pairs)
), bags AS (
  SELECT row, p, gram, count(*) AS n FROM (
    SELECT row, p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM words
  ) GROUP BY row, p, gram
), scores AS (
  SELECT x.row, x.p, x.name, 2.0::DOUBLE * sum(least(b.n, g.n)) / (x.k + x.size) AS dice
  FROM pairs x JOIN grams g ON g.t = x.t JOIN bags b ON b.row = x.row AND b.p = x.p AND b.gram = g.gram
  GROUP BY x.row, x.p, x.t, x.name, x.k, x.size
), firsts AS (
  SELECT * FROM scores WHERE dice >= {least!r}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY dice DESC, name) = 1
), hits AS (
  SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_passages, max(dice) AS best_dice
  FROM firsts GROUP BY row
){_WINDOWS_SQL.replace("$least", repr(least)).replace("$firsts", firsts) if windows else ""}
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, coalesce(best_dice, 0.0::DOUBLE) AS best_dice{_WINDOWS_COLUMNS if windows else ""}
FROM clean LEFT JOIN hits USING (row){" LEFT JOIN noticed USING (row)" if windows else ""}
"""


#: The windows: each beginning counts the template's bigrams up to the window's end.
_WINDOWS_SQL = r""", firsts_of(t, gram) AS (VALUES
  $firsts
), split AS (
  SELECT row, string_split(trim(regexp_replace(c, '[ \n]+', ' ', 'g')), ' ') AS w FROM clean
), placed AS (
  SELECT row, i, len(w) - 1 AS last, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT row, w, unnest(range(1, len(w))) AS i FROM split)
), met AS (
  SELECT row, t, i, last, gram, name, size, n FROM placed JOIN grams USING (gram)
), begun AS (
  SELECT met.row, met.t, met.i, met.last FROM met LEFT JOIN firsts_of f ON f.t = met.t AND f.gram = met.gram
  LEFT JOIN met p ON p.row = met.row AND p.t = met.t AND p.i = met.i - 1
  WHERE f.t IS NOT NULL OR p.t IS NULL
), counted AS (
  SELECT a.row, b.t, a.i, b.name, b.size, least(b.size, a.last - a.i + 1) AS k, b.gram, least(count(*), b.n) AS n
  FROM (SELECT DISTINCT row, i, last FROM begun) a JOIN met b ON b.row = a.row AND b.i >= a.i AND b.i < a.i + b.size
  GROUP BY a.row, b.t, a.i, b.name, b.size, a.last, b.gram, b.n
), measured AS (
  SELECT row, t, i, name, sum(n) AS shared, 2.0::DOUBLE * sum(n) / (k + size) AS dice FROM counted GROUP BY row, t, i, name, size, k
), named AS (
  SELECT * FROM measured SEMI JOIN (SELECT row, i FROM measured JOIN begun USING (row, t, i) WHERE dice >= $least::DOUBLE) USING (row, i) WHERE dice >= $least::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY row, i ORDER BY shared DESC, dice DESC, name) = 1
), noticed AS (
  SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, max(dice) AS best_window FROM named GROUP BY row
)"""
_WINDOWS_COLUMNS = ", coalesce(notices, '') AS notices, coalesce(best_window, 0.0::DOUBLE) AS best_window"
