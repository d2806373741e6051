"""License scans: TF-IDF cosine to templates and inheritance along paths, with DataFrame functions only.

A document with a licence cue anywhere in its text is compared in two ways, both by the cosine of TF-IDF vectors:
term frequency times the inverse document frequency over all documents. Its header blocks are compared with TEMPLATES,
the usual notices and source headers: every line with a cue, every run of lines between blank ones that has a cue, the
same with runs also ended where comment lines and others meet, and of each kind all of them together. Its whole text is
compared with TEXTS, the full texts of the licences. A word that no template has counts with the frequency of an
unseen one, so that a block that says more than a template is less like it. A whole text at or above TEXT_THRESHOLD
has the licence of the best text; otherwise the best template at or above THRESHOLD is the document's licence.

A licence file is a document with a licence whose whole text has it, whose cue lines or best block hold at least
FILE_SHARE of its words, or which has a licence file's name. It speaks for its directory: documents without a licence of their own inherit that of
the nearest ancestor directory that has one, found by joining directories with the ancestors of directories.

Defined results: a null or empty text has no licence of its own but can inherit; of licence files in one
directory the best score counts, then the first path; templates tie by their order; repeated rows are rows of
their own; a null path belongs to no directory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from importlib.resources import files

from pyspark.sql import Column, DataFrame, functions as F

from bytestrata.llm.common import cut, pick

THRESHOLD, FILE_SHARE = 0.6, 0.5
#: Running prose shares its commonest words with long texts, so that a whole text must be closer than a header.
TEXT_THRESHOLD = 0.85
CUE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|permission to use|all rights reserved|public domain|redistribut|warrant(?:y|ies)|merchantab|provided .{0,4}as is"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
#: How a line of a comment begins.
COMMENT = r"[ \t]*(?:\*|#|//|/\*|--|;|%|<!--)"
#: The licences of TEXTS, each a file of license_texts. Legal codes of CC BY licences are known by their openings in TEMPLATES.
TEXT_NAMES = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC0-1.0", "Unlicense", "ISC")
TEXTS = tuple((name, files("bytestrata.llm").joinpath(f"license_texts/{name}.txt").read_text("utf-8")) for name in TEXT_NAMES)


def _gnu(name: str, kind: str, version: str, *subjects: str) -> tuple:
    """The source headers of a licence of the GNU family: with later versions, and of one version alone."""
    free = "{} is free software: you can redistribute it and/or modify it under the terms of "
    later = f"the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = " {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with {}. If not, see https://www.gnu.org/licenses/"
    only = f"version {version} of the GNU {kind} as published by the Free Software Foundation."
    out = []
    for subject in subjects:
        out += [(name, free.format(subject) + later), (name, free.format(subject) + later + rest.format(subject, kind, kind, subject)), (name, free.format(subject) + only)]
    return tuple(out)


_CC = (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"))
#: Usual notices, titles and source headers of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Licensed under the ISC License."),
    *_gnu("GPL-3.0", "General Public License", "3", "This program"),
    *_gnu("GPL-2.0", "General Public License", "2", "This program"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3", "This program", "This library"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "This library"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3", "This program"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, text) for name, text in TEXTS if name in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"CC-BY{short}-4.0", f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License. http://creativecommons.org/licenses/by{short.lower()}/4.0/") for short, long in _CC),
    *((f"CC-BY{short}-4.0", f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution{long} 4.0 International Public License (Public License).") for short, long in _CC),
)


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def document_frequencies(docs: DataFrame, templates: tuple = TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of a template, over all documents."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    own = pick(docs, "text").select(F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), known).alias("t"))
    counted = own.select(F.explode("t").alias("t")).groupBy("t").count().collect()  # at most the vocabulary
    return docs.count(), {r["t"]: r["count"] for r in counted}


def inverse_frequency(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def vectors(n: int, df: dict[str, int], templates: tuple = TEMPLATES) -> list[dict[str, float]]:
    """TF-IDF vectors of the templates, of length 1."""
    out = []
    for _, text in templates:
        own = {t: c * inverse_frequency(n, df.get(t, 0)) for t, c in Counter(terms(text)).items()}
        length = math.sqrt(sum(v * v for v in own.values()))
        out.append({t: v / length for t, v in own.items()})
    return out


def _blocks(text: Column) -> Column:
    """All pieces of a text that are compared with templates."""
    text = F.regexp_replace(text, r"(?md)^[^\p{L}\p{N}\n]*$", "")
    apart = F.regexp_replace(text, rf"(?md)^({COMMENT}[^\n]*)\n(?!{COMMENT})", "$1\n\n")
    apart = F.regexp_replace(apart, rf"(?md)^((?!{COMMENT})[^\n]+)\n(?={COMMENT})", "$1\n\n")
    parts = [F.split(text, "\n"), F.split(text, "\n{2,}"), F.split(apart, "\n{2,}")]
    cued = F.transform(F.array(*parts), lambda p: F.filter(p, lambda x: x.rlike(CUE)))
    return F.array_distinct(F.flatten(F.transform(cued, lambda p: F.concat(p, F.array(F.array_join(p, "\n"))))))


def _counted(df: DataFrame, texts: str, name: str) -> DataFrame:
    """Adds a column with the distinct terms of each of an array of texts and how often it has them: (t, c)."""
    df = df.withColumn("_s", F.transform(texts, lambda x: F.array_sort(_terms(x))))
    lead = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    df = df.withColumn("_r", F.transform("_s", lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, lead(s)).otherwise(F.array().cast("array<int>")).alias("at"))))
    own = lambda r: F.transform(r["at"], lambda a, k: F.struct(F.get(r["s"], a).alias("t"), (F.coalesce(F.get(r["at"], k + 1), F.size(r["s"])) - a).alias("c")))
    return df.withColumn(name, F.transform("_r", own)).drop("_s", "_r")


def _best(counted: Column, n: int, df: dict[str, int], templates: tuple) -> Column:
    """(score, minus the template, minus the position) of the best of an array of counted texts, the first of equals."""
    own = vectors(n, df, templates)
    words = sorted({t for v in own for t in v})
    size = 1 << len(words).bit_length()
    slots: list[list] = [[] for _ in range(size)]
    for t in words:
        slots[zlib.crc32(t.encode()) % size].append({"t": t, "f": inverse_frequency(n, df.get(t, 0)), "w": [v.get(t, 0.0) for v in own]})
    # a constant, which the optimiser folds: words by their hash, since a map is searched from end to end
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,f:double,w:array<double>>>>")
    slot = lambda t: F.get(table, (F.crc32(t.cast("binary")) % size).cast("int"))
    known = lambda t: F.get(F.filter(slot(t), lambda x: x["t"] == t), 0)
    found = F.transform(counted, lambda v: F.transform(v, lambda x: F.struct(x["c"].alias("c"), known(x["t"]).alias("k"))))
    unseen = F.lit(inverse_frequency(n, 0))
    square = lambda x: F.pow(x["c"] * F.coalesce(x["k"]["f"], unseen), F.lit(2.0))
    dot = lambda v, i: F.aggregate(v, F.lit(0.0), lambda s, x: s + x["c"] * x["k"]["f"] * F.get(x["k"]["w"], i))
    found = F.transform(found, lambda v: F.struct(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + square(x))).alias("length"), F.filter(v, lambda x: x["k"].isNotNull()).alias("v")))
    most = lambda f, k: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda i: F.struct((dot(f["v"], i) / f["length"]).alias("score"), (-i).alias("i"), (-k).alias("k"))))
    return F.array_max(F.transform(F.filter(found, lambda f: f["length"] > 0), most))


def own_licenses(docs: DataFrame, keep: tuple[str, ...], templates: tuple = TEMPLATES, threshold: float = THRESHOLD, texts: tuple = TEXTS) -> DataFrame:
    """The kept columns, license and score (null below the threshold), and share: the part of a text's words that its cue lines or its best block hold."""
    n, df = document_frequencies(docs, templates + texts)
    own = pick(docs, *keep, "text").withColumn("text", F.coalesce("text", F.lit("")))
    cue = F.col("text").rlike(CUE)
    own = own.withColumn("blocks", F.when(cue, _blocks(F.col("text")))).withColumn("whole", F.when(cue, F.array("text")))
    own = _counted(_counted(own, "blocks", "block_terms"), "whole", "whole_terms")
    own = own.withColumn("best", _best(F.col("block_terms"), n, df, templates)).withColumn("best_text", _best(F.col("whole_terms"), n, df, texts))
    named = lambda given, i: F.element_at(F.split(F.lit(" ".join(name for name, _ in given)), " "), 1 - i)
    whole, fits = F.col("best_text.score") >= TEXT_THRESHOLD, F.col("best.score") >= threshold
    words = lambda c: F.size(F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cued = F.array_join(F.filter(F.split("text", "\n"), lambda line: line.rlike(CUE)), "\n")
    share = F.when(whole, 1.0).when(fits, F.greatest(words(cued), words(F.get("blocks", -F.col("best.k")))) / words(F.col("text")))
    return own.select(
        *keep, F.when(whole, named(texts, F.col("best_text.i"))).when(fits, named(templates, F.col("best.i"))).alias("license"),
        F.when(whole, F.col("best_text.score")).when(fits, F.col("best.score")).alias("score"), F.coalesce(share, F.lit(0.0)).alias("share"),
    )


def scan(files: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, origin (header, directory or null) and license_path of every file (doc_id, path, text)."""
    own = cut(own_licenses(files, ("doc_id", "path"), templates, threshold).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", "")))
    is_file = (F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME)
    speaking = own.filter(F.col("license").isNotNull() & is_file & F.col("directory").isNotNull())
    first = F.min_by(F.struct("license", "score", "path"), F.struct(-F.col("score"), F.col("path")))
    speaking = cut(speaking.groupBy("directory").agg(first.alias("said")).select(F.col("directory").alias("ancestor"), "said.*"))
    # one row per directory and ancestor; files meet only the result, one row per directory
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor")))
    directories = own.filter("directory is not null").select("directory").distinct().select("directory", F.explode(ancestors).alias("a")).select("directory", "a.*")
    nearest = directories.join(speaking, "ancestor").groupBy("directory").agg(F.max_by(F.struct("license", "score", "path"), "depth").alias("near"))
    out = own.join(nearest, "directory", "left")
    inherits = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select(
        "doc_id", "path", F.when(inherits, F.col("near.license")).otherwise(F.col("license")).alias("license"), F.when(inherits, F.col("near.score")).otherwise(F.col("score")).alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(inherits, "directory").alias("origin"), F.when(F.col("license").isNotNull(), F.col("path")).when(inherits, F.col("near.path")).alias("license_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: /source/lang/thousand/doc_id.txt."""
    own = pick(docs, "doc_id", "source", "lang", "text")
    name = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "_"), F.lit("-"))
    path = F.concat_ws("/", F.lit(""), name("source"), name("lang"), F.coalesce(F.expr("cast(doc_id div 1000 as string)"), F.lit("-")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(".txt")))
    return own.select("doc_id", path.alias("path"), "text")
