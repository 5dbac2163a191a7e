"""License scan: Dice coefficient over word bigrams against licence templates.

Built from DataFrame functions alone. A segment (each line, each sentence, each
paragraph and the whole text where they have several lines) is compared only to
templates whose bigram count lies within the bounds that the threshold implies:
with a and b distinct bigrams, Dice is at most 2 min(a, b) / (a + b). By the same
bounds a match shares at least threshold / (2 - threshold) of its template's
bigrams: texts are cut into segments only where the whole text has as many.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import held, tail

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: Between sentences, which may run over several lines.
SENTENCE = r"[.!?][\t\n\f\r ]+"
#: Between paragraphs: lines without letters and digits, as blank ones and those of comment signs alone.
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+"

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
_GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_LGPL_2 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_LGPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_COPIES = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
)
_APACHE = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."



def _tags(*ids: str) -> tuple[str, ...]:
    """The machine-readable tags that source files carry."""
    return tuple(f"SPDX-License-Identifier: {i}" for i in ids)


def _commons(name: str, short: str) -> tuple[str, ...]:
    """How a text names a licence of Creative Commons, version 4.0."""
    title = f"Creative Commons {name} 4.0 International"
    return (f"Licensed under {short} 4.0.", f"This work is licensed under a {title} License.", f"{title} License", f"{name} 4.0 International ({short} 4.0)", f"{name} 4.0", *_tags(f"{short.replace(' ', '-')}-4.0"))


#: Notices by which texts name their licence, tags, whole short texts, openings and headers of long ones, and each of their paragraphs.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        *_GRANT,
        " ".join(_GRANT),
        *_tags("MIT"),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        _APACHE,
        f'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 {_APACHE}',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        *_tags("Apache-2.0"),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        _GPL_2,
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_COPIES}",
        *_tags("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        _GPL_3,
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_COPIES}",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        *_tags("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    ),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", _LGPL_2, "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_tags("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", _LGPL_3, "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_tags("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", " ".join((*_BSD[:3], _BSD[4])), *_tags("BSD-2-Clause")),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", *_BSD, " ".join(_BSD), *_tags("BSD-3-Clause")),
    "ISC": ("Licensed under the ISC License.", *_ISC, " ".join(_ISC), *_tags("ISC")),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. {_MPL}",
        "Mozilla Public License Version 2.0",
        *_tags("MPL-2.0"),
    ),
    "Unlicense": (*_UNLICENSE, " ".join(_UNLICENSE), *_tags("Unlicense")),
    "Zlib": (*_ZLIB, " ".join(_ZLIB), *_tags("Zlib")),
    "CC-BY-4.0": _commons("Attribution", "CC BY"),
    "CC-BY-SA-4.0": _commons("Attribution-ShareAlike", "CC BY-SA"),
    "CC-BY-ND-4.0": _commons("Attribution-NoDerivatives", "CC BY-ND"),
    "CC-BY-NC-4.0": _commons("Attribution-NonCommercial", "CC BY-NC"),
    "CC-BY-NC-SA-4.0": _commons("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _commons("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0.", *_tags("CC0-1.0")),
    "Proprietary": ("All rights reserved.", "Copyright, all rights reserved, no part may be reproduced without permission."),
}


def normal(text: str) -> list[str]:
    """The words of a text: lower case, runs of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> set[tuple[str, str]]:
    w = normal(text)
    return set(zip(w, w[1:]))


def pair_hash(a: str, b: str) -> int:
    """What xxhash64(xxhash64(a), xxhash64(b)) is in Spark, so that plans hold numbers instead of expressions to fold."""
    word = lambda w: xxhash.xxh64_digest(w.encode(), 42)[::-1]  # noqa: E731  little-endian
    h = xxhash.xxh64_intdigest(word(b), xxhash.xxh64_intdigest(word(a), 42))
    return h - (1 << 64) if h >> 63 else h


def _with_pairs(rows: DataFrame, text: str) -> DataFrame:
    """Add _pairs: hashes of the distinct bigrams of a text column."""
    rows = held(rows, _words=F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    pairs = F.slice(F.zip_with("_words", tail(F.col("_words"), 1), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("_words") - 1, F.lit(0)))
    return held(rows, _pairs=F.array_distinct(pairs)).drop("_words")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (double), n_segments (long), best (boolean): a row per document and licence found.

    dice is the best over the document's segments and the licence's templates;
    n_segments counts the segments that reach the threshold; best marks the
    licence of the text's largest dice, since the wordings of a family (versions,
    variants) resemble one another. Null, empty and
    one-word texts have no bigrams and give no row; texts of any length are read
    whole. Rows that agree in id and text give their rows once, and rows of one
    id with different texts each their own. Of licences that tie each gets a
    row, and each is best. Extra columns, whatever their names, are ignored, and an empty table
    gives no rows. The templates are a parameter, held in the plan as literals.
    """
    flat = [(name, t) for name, texts in templates.items() for t in texts if bigrams(t)]
    if not flat:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_segments"), F.lit(True).alias("best")).filter("false")
    counts = [len(bigrams(t)) for _, t in flat]
    bound = lambda n: (threshold / (2 - threshold) * n, (2 - threshold) / threshold * n)
    least, most = min(bound(n)[0] for n in counts), max(bound(n)[1] for n in counts)
    hashes = lambda pairs: f"array({', '.join(f'{pair_hash(a, b)}L' for a, b in sorted(pairs))})"
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(n).alias("n"), F.expr(hashes(bigrams(t))).alias("own")) for (name, t), n in zip(flat, counts)])
    known = F.expr(hashes({p for _, t in flat for p in bigrams(t)}))
    t = F.coalesce(F.col(text), F.lit(""))
    # The whole text's bigrams hold those of all its segments.
    rows = _with_pairs(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_row"), t.alias("_text")), "_text")
    rows = held(rows, _shared=F.array_intersect("_pairs", known)).drop("_pairs").filter(F.size("_shared") > 0)
    enough = lambda x: F.size(F.array_intersect("_shared", x["own"])) >= threshold / (2 - threshold) * x["n"] - 1e-9
    rows = rows.filter(F.exists(table, enough))
    lines = F.split("_text", "\n", -1)
    whole = F.when(F.size(lines) > 1, F.array("_text")).otherwise(F.array().cast("array<string>"))
    joined = F.filter(F.split("_text", PARAGRAPH, -1), lambda s: F.contains(s, F.lit("\n")))
    segments = F.filter(F.array_distinct(F.concat(lines, F.split("_text", SENTENCE, -1), whole, joined)), lambda s: F.length(s) >= 3)
    rows = _with_pairs(rows.select("doc_id", "_row", F.explode(segments).alias("_segment")), "_segment")
    rows = rows.withColumn("_n", F.size("_pairs")).filter(F.col("_n").between(least, most))
    near = F.filter(table, lambda x: (F.col("_n") >= threshold / (2 - threshold) * x["n"]) & (F.col("_n") <= (2 - threshold) / threshold * x["n"]))
    dice = F.transform(near, lambda x: F.struct(x["license"].alias("license"), (2.0 * F.size(F.array_intersect("_pairs", x["own"])) / (F.col("_n") + x["n"])).alias("dice")))
    rows = rows.select("doc_id", "_row", F.explode(F.filter(dice, lambda x: x["dice"] >= threshold)).alias("_m"), "_segment")
    best = rows.groupBy("doc_id", "_row", F.col("_m.license").alias("license")).agg(F.max("_m.dice").alias("dice"), F.count_distinct("_segment").alias("n_segments"))
    top = F.max("dice").over(Window.partitionBy("doc_id", "_row"))  # a row a licence at most
    return best.withColumn("best", F.col("dice") == top).drop("_row")
