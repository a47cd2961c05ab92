"""Licence scan by canonical digests: texts are brought to one form and hash-joined, whole, to the digests of known ones.

The canonical form is lower case, without copyright lines, with equivalent spellings made one, punctuation and white space
runs as one space. A document is looked up as a whole, by its paragraphs (parts between blank lines) and by its lines; only
a whole unit matches. A document that begins with the title of a short licence is looked up without it, too. Runs of
neighbouring paragraphs match where they are all paragraphs of a known text, from its first long one to the end of its terms.
Everything is Spark SQL. The known texts are a table by digest (short ones here, long ones in `license_digests`); more can be given,
as texts or as a DataFrame.

Defined results: null and empty texts, and units without letters or digits, have no digest and match nothing. Null doc_ids are
returned as null; repeated rows each give their matches.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm.jobs import doc_texts, materialise
from assetgraph.llm.license_digests import LAYOUTS, WHOLE

# Notices and short licence texts in common use, by their public identifiers.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "all-rights-reserved": ["All rights reserved."],
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
#: (pattern, replacement) on lower-case text, in this order; the patterns mean the same to Java, RE2 and Python.
RULES = (
    (r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", " "),
    (r"https?://", " http "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"copyright owner", "copyright holder"),
    (r"[^\p{L}\p{N}]+", " "),
)
#: Where a unit may begin a copyright line, and what every known text has.
SPLIT = {"document": None, "paragraph": r"\n[ \t]*\n\s*", "line": r"\n"}


#: Titles of the licences whose known texts have none.
TITLE = r"(?i)\A\s*(the\s+)?(mit|expat|isc|0bsd|bsd|zero-clause bsd|new bsd|simplified bsd|modified bsd|[23]-clause bsd)\b[^\n]{0,40}?licen[sc]e[^\n]{0,20}\n"
LONG = 12
#: Where the short texts are usually broken into paragraphs.
BREAKS = r"\s+(?=The above copyright notice and this permission notice shall|THE SOFTWARE\s+IS PROVIDED)"


def canonical(text: str) -> str:
    import regex

    text = text.lower()
    for pattern, to in RULES:
        text = regex.sub(pattern, to, text)
    return text.strip(" ")


def known(extra: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(digest, licence id) of all known texts, each digest once."""
    out: dict[str, str] = {}
    for name, texts in [*((k, v) for k, v in NOTICES.items()), *((k, [re.sub(r"\s+", " ", v)]) for k, v in TEXTS.items()), *((extra or {}).items())]:
        for t in texts:
            if c := canonical(t):
                out.setdefault(hashlib.sha256(c.encode()).hexdigest(), name)
    return sorted(out.items())


def layout(text: str) -> list[str]:
    """Digests of a text's paragraphs, "" for those without words, from its first long one to the end of its terms."""
    parts = [canonical(p) for p in re.split(SPLIT["paragraph"], text)]
    start = next((i for i, c in enumerate(parts) if len(c.split()) >= LONG), len(parts))
    end = next((i for i, c in enumerate(parts) if c == "end of terms and conditions"), len(parts))
    parts = parts[start:end]
    while parts and not parts[-1]:
        parts.pop()
    return [hashlib.sha256(c.encode()).hexdigest() if c else "" for c in parts]


def known_rows(extra: dict[str, list[str]] | None = None) -> list[tuple]:
    """digest, license of whole texts; of paragraphs with their place, the number of paragraphs with words, and the digest that names the layout."""
    whole = {(d, n) for d, n in known(extra)} | {(d, n) for n, ds in WHOLE.items() for d in ds}
    rows: set[tuple] = {(d, n, None, None, None) for d, n in whole}
    layouts = [(n, ds) for n, all_ in LAYOUTS.items() for ds in all_]
    for name, text in [*((n, re.sub(BREAKS, "\n\n", t)) for n, t in TEXTS.items()), *((n, t) for n, ts in (extra or {}).items() for t in ts)]:
        layouts.append((name, layout(text)))
    for name, ds in layouts:
        n = sum(d != "" for d in ds)
        if n > 1:
            body = hashlib.sha256(" ".join(ds).encode()).hexdigest()
            rows |= {(d, name, i, n, body) for i, d in enumerate(ds) if d}
    return sorted(rows, key=str)


def canonical_column(column):
    out = F.lower(column)
    for pattern, to in RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return F.trim(out)


KNOWN = "digest string, license string, place int, n int, body string"


def known_table(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame(known_rows(extra), KNOWN)


def scan(docs: DataFrame, extra: dict[str, list[str]] | None = None, more: DataFrame | None = None) -> DataFrame:
    """doc_id, unit_kind, unit (from 0), license, digest of every unit that is a known licence text.

    more: further known texts with the columns of `known_table`. For runs, unit is the first paragraph and digest names the layout.
    """
    texts = doc_texts(docs).where("text is not null").withColumn("row", F.monotonically_increasing_id())

    def units_of(kind: str):
        return F.transform(F.split("text", SPLIT[kind]), lambda x, i: F.struct(F.lit(kind).alias("unit_kind"), i.alias("unit"), x.alias("body")))

    def whole(body):
        return F.array(F.struct(F.lit("document").alias("unit_kind"), F.lit(0).alias("unit"), body.alias("body")))

    kinds = [whole(F.col("text")), units_of("paragraph"), units_of("line")]
    # a document of one line is its own paragraph and line; only the whole is then looked at
    parts = F.when(F.contains("text", F.lit("\n")), F.when(F.col("text").rlike(SPLIT["paragraph"]), F.concat(*kinds)).otherwise(F.concat(kinds[0], kinds[2]))).otherwise(kinds[0])
    titled = F.when(F.substring("text", 1, 200).rlike(TITLE), whole(F.regexp_replace("text", TITLE, ""))).otherwise(F.array_remove(kinds[0], kinds[0][0]))
    units = texts.select("doc_id", "row", F.inline(F.concat(parts, titled)))
    digest = units.select("doc_id", "row", "unit_kind", "unit", F.sha2(canonical_column(F.col("body")), 256).alias("digest"))
    table = F.broadcast(known_table(docs.sparkSession, extra))
    if more is not None:
        table = table.unionByName(more.select(*table.columns)).distinct()
    found = digest.join(table, "digest").where("place is null or unit_kind = 'paragraph'")
    found = materialise(found, "licenses")
    names = ("doc_id", "unit_kind", "unit", "license", "digest")
    pieces = found.where("place is not null").groupBy("doc_id", "row", "license", F.col("body").alias("digest"), "n", (F.col("unit") - F.col("place")).alias("unit"))
    runs = pieces.agg(F.count("*").alias("there")).where("there = n").withColumn("unit_kind", F.lit("run"))
    return found.where("place is null").select(*names).unionByName(runs.select(*names))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    body = "lower(body)"
    for pattern, to in RULES:
        body = f"regexp_replace({body}, '{pattern}', '{to}', 'g')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in known())
    split = lambda kind: f"select doc_id, '{kind}' as unit_kind, u - 1 as unit, parts[u] as body from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as u from (select doc_id, regexp_split_to_array(text, '{SPLIT[kind]}') as parts from documents where text is not null and "
    return f"""
with known(digest, license) as (values {values}),
units as (
  select doc_id, 'document' as unit_kind, 0 as unit, text as body from documents where text is not null
  union all {split("paragraph")} regexp_matches(text, '{SPLIT["paragraph"]}')))
  union all {split("line")} contains(text, chr(10))))
)
select doc_id, unit_kind, cast(unit as int) as unit, license, digest
from (select doc_id, unit_kind, unit, sha256(trim({body}, ' ')) as digest from units) join known using (digest)"""
