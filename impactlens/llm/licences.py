"""Licence scans: normalised passages compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from impactlens.llm.columns import ascii_lower, text_of

# Wordings of well-known licences, one paragraph or notice each.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"'
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
        " governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,'
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

PARAGRAPHS = r"\n( ?\n)+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, least: float) -> tuple[float, float]:
    """Bigrams a passage may have to reach a coefficient of `least` with a template of `size` bigrams."""
    return size * least / (2 - least), size * (2 - least) / least


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and line ends one blank."""
    return F.regexp_replace(ascii_lower(text), r"[^a-z0-9\n]+", " ")


def passages(norm: Column) -> Column:
    """The words of every line, of every paragraph (between blank lines), and of the whole text."""
    split = F.concat(F.split(norm, "\n", -1), F.split(norm, PARAGRAPHS, -1), F.array(norm))
    return F.transform(split, lambda p: F.filter(F.split(p, "[ \n]+", -1), lambda w: w != ""))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))
    )
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan_licences(
    docs: DataFrame,
    least: float = 0.8,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, licences) per row: array<struct<licence, dice>> by name, the best coefficient of each found licence.

    Passages are the lines, paragraphs and the whole of a text; one is compared only with templates whose
    size lets it reach `least`. A null or empty text has no licence; equal coefficients give one entry;
    repeated rows are scanned again, an empty table gives no rows, other columns are left out. The scan
    needs no shuffle.
    """
    given = docs.select(F.col(id_col), normalised(text_of(text_col)).alias("norm"))
    # a passage with fewer words than any template needs cannot match
    sizes = [len(template_bigrams(t)) for _, t in templates]
    fewest = min(size_bounds(n, least)[0] for n in sizes)
    words = F.filter(passages(F.col("norm")), lambda w: F.size(w) - 1 >= fewest)
    found = given.select(F.col(id_col), F.transform(words, bigrams).alias("passages"))

    def best(name: str, text: str) -> Column:
        wanted = template_bigrams(text)
        low, high = size_bounds(len(wanted), least)
        fitting = F.filter("passages", lambda p: (F.size(p) >= low) & (F.size(p) <= high))
        grams = F.split(F.lit("\n".join(wanted)), "\n")
        dice = F.transform(
            fitting, lambda p: 2.0 * F.size(F.array_intersect(p, grams)) / (F.size(p) + F.lit(len(wanted)))
        )
        return F.struct(F.lit(name).alias("licence"), F.array_max(dice).alias("dice"))

    all_best = F.filter(F.array(*[best(*t) for t in templates]), lambda x: x["dice"] >= least)
    matched = found.select(F.col(id_col), F.array_sort(all_best).alias("found"))
    # of the wordings of one licence the best counts: the last in this order
    last = F.filter(
        F.col("found"),
        lambda x, i: (i + 1 == F.size("found")) | (F.get(F.col("found"), i + 1)["licence"] != x["licence"]),
    )
    return matched.select(F.col(id_col), last.alias("licences"))
