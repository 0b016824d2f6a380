"""License scans: Dice coefficient over word bigrams of passages and licence templates.

A passage is a line, a run of lines between blank ones, a sentence, or the whole text. It names the licence whose template is
most like it, among those with the same deciding words: versions, and words such as "lesser" or
"noncommercial". Of n template bigrams a passage at
the threshold t has at least n * t / (2 - t), and at most n * (2 - t) / t of its own: templates outside those
bounds are pruned by size. As many bigrams must be shared that, in every template, one with
a stem of _stems() is among them: texts without any stem are not split at all, losslessly.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let

# Wording of public licences and of the usual notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under the Creative Commons CC0 1.0 Universal License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
]
#: Words that tell licences of one family apart (fixed values) and versions, as "v3" or "3"; "0" tells nothing.
DECIDING = "lesser|library|affero|noncommercial|noderivatives|noderivs|sharealike|nc|nd|sa|later|endorse|[1-9]"
#: Word starts, one of which is in most bigrams that tell licences apart.
STEMS = ["licen", "creativ", "common", "gnu", "cc", "permission", "softwar", "copy", "copie", "general", "public", "version", "releas", "term", "distribut", "redistribut", "modif", "reserv", "subject", "condition", "free", "person", "right", "includ", "limit", "file", "associat", "document", "bsd", "clause", "sourc", "contribut", "endors", "promot", "deriv", "written", "binar"]


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """Different word bigrams; of a single word, itself."""
    w = normal_words(text)
    return sorted({f"{x} {y}" for x, y in zip(w, w[1:], strict=False)} or set(w))


def deciding_words(text: str) -> list[str]:
    return sorted({x for w in normal_words(text) if re.fullmatch(DECIDING, x := re.sub("^v(?=[0-9])", "", w))})


@functools.cache
def _stems(threshold: float) -> list[str]:
    """Stems such that every template has more bigrams with one than a passage at the threshold may lack."""
    used: list[str] = []
    for _, text in TEMPLATES:
        grams = bigrams_of(text)
        needed = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9) + 1
        for stem in STEMS:
            if sum(any(re.search(rf"\b{s}", g) for s in used) for g in grams) >= needed:
                break
            if stem not in used and any(re.search(rf"\b{stem}", g) for g in grams):
                used.append(stem)
        if sum(any(re.search(rf"\b{s}", g) for s in used) for g in grams) < needed:
            raise ValueError(f"no stem covers enough of {text!r}")
    return used


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " ")


def _bigrams(w: Column) -> Column:
    pairs = F.when(F.size(w) > 1, F.transform(F.slice(w, 2, F.size(w)), lambda y, k: F.concat_ws(" ", F.get(w, k), y))).otherwise(w)
    return F.array_distinct(pairs)


def _deciding(w: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(w, lambda x: F.regexp_replace(x, "^v(?=[0-9])", "")), lambda x: x.rlike(f"^(?:{DECIDING})$"))))


def licenses(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches (array of license, dice, passage) of every row: the licence most like a passage, one at most each.

    Null and empty texts have none. Of equal Dice, the licence whose name comes first is taken; equal passages of
    a document count once. Texts of any length are scanned whole. Repeated rows get equal results; an empty table gives no rows.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    stem = "(?<![a-z0-9])(?:" + "|".join(_stems(threshold)) + ")"
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    grams = sorted((name, bigrams_of(t), deciding_words(t)) for name, t in TEMPLATES)
    lines = F.split(text, "\n")
    blocks = F.split(text, r"\n[\x20\x09-\x0D]*\n")
    sentences = F.split(F.regexp_replace(text, r"([.!?:;])[\x20\x09-\x0D]+([A-Z(*])", "$1\x01$2"), "\x01")
    passages = F.filter(F.array_distinct(F.concat(lines, blocks, sentences, F.array(text))), lambda p: F.lower(p).rlike(stem))

    def dice(found: Column, template: list[str]) -> Column:
        shared = F.size(F.array_intersect(found, F.array(*map(F.lit, template))))
        return F.round(2 * shared / (F.size(found) + len(template)), 6)

    def bounded(found: Column, template: list[str]) -> Column:
        return F.size(found).between(math.ceil(len(template) * least - 1e-9), math.floor(len(template) * most + 1e-9))

    names = sorted({name for name, _, _ in grams})

    def judged(passage: Column) -> Column:
        def best(x: Column) -> Column:
            found, decides = x["grams"], x["decides"]
            same = lambda d: decides == F.array(*map(F.lit, d)).cast("array<string>")
            each = [F.when(bounded(found, g) & same(d), F.struct(dice(found, g).alias("dice"), F.lit(-names.index(name)).alias("rank"), F.lit(name).alias("license"))) for name, g, d in grams]
            return F.array_max(F.filter(F.array(*each), lambda m: m.isNotNull()))

        known = let(_words(passage), lambda w: F.struct(_bigrams(w).alias("grams"), _deciding(w).alias("decides")))
        return let(let(known, best), lambda m: F.when(m["dice"] >= threshold, F.struct(m["license"].alias("license"), m["dice"].alias("dice"), passage.alias("passage"))))

    found = F.filter(F.transform(passages, judged), lambda m: m.isNotNull())
    nothing = F.array().cast("array<struct<license:string,dice:double,passage:string>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.select("doc_id", F.when(F.lower(text).rlike(stem), found).otherwise(nothing).alias("matches"))
