"""License texts in documents, by an exact set-similarity join of text blocks with templates.

A token is a run of five words. A block is a stretch of words, twice as long as the longest template and starting
every half of that, so each passage of a template's length lies whole in a block. A block has a template if it holds at
least the threshold's share of the template's tokens.

Tokens are ordered by the number of blocks that hold them, rarest first. Three filters come before any set is compared:
prefix (two sets that share ``o`` tokens share one among the first ``size - o + 1`` of each), length (a block needs
``o`` tokens) and position (a first common token at places i and j leaves at most ``1 + min(size - i, size - j)``). Only
tokens of templates can be shared, so a block is kept as its template tokens; all others stand last in the order and
take no part. No step drops a pair that meets the threshold.

Built-in functions only; one pass reads the texts, and leaves per document its phrase places and template tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import stage

# In lower-cased text: digits, a to z and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
THRESHOLD = 0.8

# Phrases that name a license, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Published license texts, notices and short forms (label, text), each of at least five words.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
               "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
               "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
            "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means."),
)


def words_of(text: str) -> list[str]:
    """Words of a template; lower case for A to Z only."""
    return re.findall(WORDS, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def shingles_of(text: str) -> list[str]:
    """Distinct tokens of a template."""
    words = words_of(text)
    if len(words) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words at least: {text!r}")
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def _lower(text: Column) -> Column:
    """A to Z in lower case, nothing else. Spark's ``lower`` is quicker and does the same to ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _tokens(docs: DataFrame, phrases: Mapping[str, str], shingles: Sequence[str]) -> DataFrame:
    """(row_id, doc_id, n_words, places, hits): phrases and template tokens with their first word, by one pass over the texts."""
    known = sorted({w for s in shingles for w in s.split(" ")})

    def places_of(w: Column, at: Column, phrase: str, label: str) -> Column:
        parts = phrase.split(" ")
        test = lambda i: reduce(and_, [F.get(w, i + k) == part for k, part in enumerate(parts)])
        found = F.transform(F.filter(at, test), lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))
        # most texts lack the phrase's longest word
        return F.when(F.array_contains(w, max(parts, key=len)), found).otherwise(F.array().cast("array<struct<label:string,start:int>>"))

    def look(w: Column) -> Column:
        at = F.transform(w, lambda _, i: i)
        places = [places_of(w, at, phrase, label) for phrase, label in phrases.items()]

        promising = lambda i: reduce(and_, [F.get(w, i + k).isin(known) for k in range(SHINGLE)])
        runs = F.transform(F.filter(at, promising), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " ").alias("shingle")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.concat(*places).alias("places"), F.filter(runs, lambda s: s["shingle"].isin(list(shingles))).alias("hits")
        )

    words = F.regexp_extract_all(F.coalesce(_lower(F.col("text")), F.lit("")), F.lit(WORDS), F.lit(0))
    # the one-element transform splits a text once, not once per use
    seen = F.transform(F.array(words), look)[0]
    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", seen.alias("x")).select("row_id", "doc_id", "x.*")


def license_blocks(tokens: DataFrame, templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, template, label, start, end, containment): blocks that hold a template, and the words its tokens span.

    ``tokens`` is a written table of ``(row_id, hits)``. A passage in the overlap of two blocks comes once.
    """
    spark = tokens.sparkSession
    sets = [shingles_of(text) for _, text in templates]
    half = max(len(words_of(text)) for _, text in templates)
    # as many rows as the templates given in code have tokens
    parts = F.array(*[
        F.struct(F.lit(t).alias("template"), F.lit(templates[t][0]).alias("label"), F.lit(len(s)).alias("n"), F.lit(math.ceil(threshold * len(s) - 1e-9)).alias("needed"),
                 F.array(*[F.lit(x) for x in s]).alias("shingles")) for t, s in enumerate(sets)
    ])
    given = spark.range(1).select(F.explode(parts).alias("t")).select("t.*").withColumn("shingle", F.explode("shingles")).drop("shingles")
    least = min(math.ceil(threshold * len(s) - 1e-9) for s in sets)

    hits = tokens.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.at", "h.shingle").withColumn("of", F.floor(F.col("at") / half).cast("int"))
    hits = hits.select("row_id", "at", "shingle", F.explode(F.array("of", F.col("of") - 1)).alias("block")).where("block >= 0")
    counts = hits.select("row_id", "block", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("n_blocks"))
    # one row per token of the templates
    order = F.row_number().over(Window.orderBy(F.coalesce("n_blocks", F.lit(0)), "shingle"))
    order = stage(given.select("shingle").distinct().join(counts, "shingle", "left").select("shingle", order.alias("token")), "license-tokens")

    hits = stage(hits.join(order, "shingle").select("row_id", "block", "at", "token"), "license-hits")
    given = stage(given.join(order, "shingle").drop("shingle"), "license-templates")
    blocks = hits.groupBy("row_id", "block").agg(F.sort_array(F.collect_set("token")).alias("b")).where(F.size("b") >= least)
    own = given.groupBy("template", "n", "needed").agg(F.sort_array(F.collect_list("token")).alias("t"))
    left = blocks.select("row_id", "block", F.size("b").alias("size"), F.posexplode(F.expr(f"slice(b, 1, size(b) - {least} + 1)")).alias("j", "token"))
    right = own.select("template", "n", "needed", F.posexplode(F.expr("slice(t, 1, n - needed + 1)")).alias("i", "token"))
    leaves = F.lit(1) + F.least(F.col("n") - 1 - F.col("i"), F.col("size") - 1 - F.col("j"))
    pairs = left.join(right, "token").where((F.col("size") >= F.col("needed")) & (leaves >= F.col("needed"))).select("row_id", "block", "template").distinct()
    common = pairs.join(hits, ["row_id", "block"]).join(given, ["template", "token"]).groupBy("row_id", "block", "template", "label", "n", "needed").agg(
        F.count_distinct("token").alias("shared"), F.min("at").alias("start"), (F.max("at") + SHINGLE).alias("end"))
    share = F.col("shared") / F.col("n")
    return common.where("shared >= needed").groupBy("row_id", "template", "label", "start", "end").agg(F.max(share).alias("containment"))


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, n_words, places, blocks): per document the places of phrases and the blocks of templates.

    ``places`` lists (label, start) and ``blocks`` (label, start, end, containment), both in text order; words count from 0.
    A null text is empty; it and a text without words have 0 words and empty lists. Rows that repeat, with or without a
    doc_id in common or null, each get a row of their own. An empty table gives none. Only ``doc_id`` and ``text`` are
    read, so other columns may have any name. Phrases of one label that overlap all count. Templates are given in code.
    """
    shingles = list(dict.fromkeys(s for _, text in templates for s in shingles_of(text)))
    seen = stage(_tokens(docs.select("doc_id", "text"), phrases, shingles), "license-words")
    empty = F.array().cast("array<struct<start:int,end:int,label:string,containment:double>>")
    found = license_blocks(seen, templates, threshold).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "containment"))).alias("blocks"))
    in_order = F.array_sort("places", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return seen.join(found, "row_id", "left").select("doc_id", "n_words", in_order.alias("places"), F.coalesce("blocks", empty).alias("blocks"))
