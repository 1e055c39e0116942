"""Operator 7, licence scans by sparse TF-IDF cosine and inheritance along paths. DataFrame functions only.

A file's own licence is what the first of these finds in it:
1. an SPDX-License-Identifier tag, read as it stands;
2. a real notice or licence text (HEADERS, and the whole texts in licence_texts). Where any of a text's rarest triples of terms
   stands, in any place of the file and with any comment marks, as many terms as the text has, from where it would begin, are
   compared with it as one sparse vector, and the best cosine from WINDOW on counts; terms that are in no text (years, holders) weigh little;
3. a line with a licence word that is near one of the short TEMPLATES, from MATCH on;
4. such a line with the terms in no template weighed little, if it holds all terms that tell the template from the others.
All are cosines of vectors weighted by count and inverse document frequency, from joins by term with tables of fixed size.

A licence file licenses its directory: a file of a licence file's name (LICENSE, COPYING, ...), a file that is mostly one
whole licence text, of any length, and, where a directory has none of these, a short file with a notice (fewer than
LICENCE_FILE words) that is not named as source code. A file without a notice takes the licence of the nearest ancestor
directory that has one, found by joining each distinct directory's ancestors with the licensed directories.

Weights and products are whole numbers, so the result does not depend on the order of sums.

Defined results: null and empty texts have no notice; a null path has no directory and inherits nothing; a directory with
several licence files takes the best match, then the least licence name; repeated rows each get the result; other
columns pass through (columns named like the results are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, texts_of

#: Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution permitted under the BSD 3 Clause License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "Proprietary": "Copyright. All rights reserved. No license is granted",
}
#: A line with none of these words is no notice.
ANCHOR = r"(?i)licen[sc]e|copyright|rights reserved|public domain"
TERM = "[a-z0-9]+"
MATCH, LICENCE_FILE = 600, 100


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def template_rows() -> tuple[list[tuple[str, str, int]], dict[str, int], dict[str, int], int]:
    """(term, template, weight) rows; squared length of each template; weight of each known term; weight of any other term."""
    n, df = len(TEMPLATES), {}
    for t in TEMPLATES.values():
        for w in set(terms(t)):
            df[w] = df.get(w, 0) + 1
    weigh = lambda d: round(100 * (math.log((1 + n) / (1 + d)) + 1))
    idf = {w: weigh(d) for w, d in df.items()}
    rows = [(w, k, terms(t).count(w) * idf[w]) for k, t in TEMPLATES.items() for w in sorted(set(terms(t)))]
    length = {k: sum(x * x for w, kk, x in rows if kk == k) for k in TEMPLATES}
    return rows, length, idf, weigh(0)


#: Terms that tell a template from the others. A line with unknown terms must hold them all.
TELLING = {
    "Apache-2.0": "apache 2", "MIT": "mit", "GPL-3.0": "gnu general 3", "GPL-2.0": "gnu general 2", "LGPL-3.0": "lesser 3", "AGPL-3.0": "affero 3", "BSD-3-Clause": "bsd 3",
    "MPL-2.0": "mozilla 2", "CC-BY-4.0": "cc by 4", "CC-BY-SA-4.0": "cc by sa 4", "CC-BY-NC-4.0": "cc by nc 4", "CC0-1.0": "cc0", "Proprietary": "copyright rights reserved",
}
#: The weight of a term in no template or text, where such terms weigh little (known ones weigh 100 at least).
LITTLE = 40
#: Texts without any of these words have no notice.
WORDS = ANCHOR + "|permission|redistribut|public licen|source code form|spdx"
WINDOW = 850
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([a-z0-9.+-]*[a-z0-9.+](?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[a-z0-9.+-]*[a-z0-9.+]\)?)*)"
GNU = "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
FREE = (
    "This {1} is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
#: (licence, opening, text), compared from the opening on: what a file says of its licence at its head, and the beginnings of texts that are not in licence_texts.
HEADERS = [
    ("Apache-2.0", "licensed under the apache license version 2 0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "licensed to the apache software foundation", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    *[(k, f"creative commons {t} 4 0 international public license by exercising", f"Creative Commons {t} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {t} 4.0 International Public License")
      for k, t in (("CC-BY-4.0", "attribution"), ("CC-BY-NC-4.0", "attribution noncommercial"))],
    *[(k, f"{w} is free software", FREE.format(name, w, v))
      for w in ("program", "library", "file", "software") for k, name, v in (("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("LGPL-3.0", "Lesser General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("AGPL-3.0", "Affero General Public License", "3"))],
]
#: Licence -> the opening of its whole text in licence_texts.
OPENINGS = {
    "Apache-2.0": "apache license version 2 0 january 2004", "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "BSD-2-Clause": "redistribution and use in source and binary forms", "BSD-3-Clause": "redistribution and use in source and binary forms", "ISC": "permission to use copy modify and",
    "GPL-2.0": "gnu general public license version 2 june 1991", "GPL-3.0": "gnu general public license version 3 29 june 2007", "LGPL-2.1": "gnu lesser general public license version 2 1 february 1999",
    "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007", "MPL-2.0": "mozilla public license version 2 0 1 definitions", "CC0-1.0": "creative commons legal code cc0 1 0 universal",
    "CC-BY-SA-4.0": "attribution sharealike 4 0 international",
}


def real_texts() -> list[tuple[str, str, list[str], bool]]:
    """(licence, opening, terms from the opening on, whether it is a whole licence text)."""
    out = [(k, o, terms(t), False) for k, o, t in HEADERS]
    for k, o in OPENINGS.items():
        out.append((k, o, terms((Path(__file__).parent / "licence_texts" / f"{k}.txt").read_text()), True))
    # 0BSD is ISC without its condition.
    isc = next(t for k, _, t, _ in out if k == "ISC")
    out.append(("0BSD", OPENINGS["ISC"], f"{' '.join(isc)} ".replace("provided that the above copyright notice and this permission notice appear in all copies ", "").split(), True))
    return [(k, o, f" {' '.join(t)} ".partition(f" {o} ")[1:], whole) for k, o, t, whole in out]


#: A text has one anchor in each of so many equal parts of it.
ANCHORS = 8


def anchors(texts: list[list[str]]) -> list[tuple[int, int, tuple[str, str, str]]]:
    """(text, offset, three terms): in each part of a text, the triple that is in the fewest texts and once in this one, the first of such."""
    triples = [list(zip(t, t[1:], t[2:], strict=False)) for t in texts]
    df: dict[tuple, int] = {}
    for g in triples:
        for x in set(g):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, g in enumerate(triples):
        once = {x for x in set(g) if g.count(x) == 1}
        for part in range(ANCHORS):
            at = [j for j in range(len(g) * part // ANCHORS, len(g) * (part + 1) // ANCHORS) if g[j] in once]
            if at:
                j = min(at, key=lambda j: (df[g[j]], j))
                out.append((i, j, g[j]))
    return out


def window_rows() -> tuple[list[tuple], list[tuple], dict[str, int], list[tuple]]:
    """(text, licence, terms, whole, length) and (text, term, weight) rows; weight of each known term; anchors."""
    texts = [(k, "".join(p).split(), whole) for k, _, p, whole in real_texts()]
    df: dict[str, int] = {}
    for _, t, _ in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: round(100 * (math.log((1 + len(texts)) / (1 + d)) + 1)) for w, d in df.items()}
    rows = [(i, w, t.count(w) * idf[w]) for i, (_, t, _) in enumerate(texts) for w in sorted(set(t))]
    length: dict[int, int] = {}
    for i, _, x in rows:
        length[i] = length.get(i, 0) + x * x
    return [(i, k, len(t), whole, length[i]) for i, (k, t, whole) in enumerate(texts)], rows, idf, anchors([t for _, t, _ in texts])


def once(c: Column) -> Column:
    """c from a one-row generator, so that what uses it more than once does not evaluate it again."""
    return F.explode(F.array(c))


def cosine(dot: str, size: str, length: str) -> Column:
    return F.floor(1000 * F.col(dot) / F.sqrt(F.col(size).cast("double") * F.col(length).cast("double"))).cast("long")


def windows(files: DataFrame, text: str) -> DataFrame:
    """(key, license, match, whole): real notices and licence texts from WINDOW on. whole: most of the file is this whole text.

    Every occurrence of an anchor of a text says where the text would begin; the terms from there on are a candidate. A file's
    triples are compared as 64-bit hashes, in its own row, so no text is shuffled; hashes that agree by chance only add a
    candidate, which the cosine decides like any other.
    """
    spark = files.sparkSession
    texts, rows, idf, marks = window_rows()
    n = {i: size for i, _, size, _, _ in texts}
    files = files.select("__key", texts_of(files, text).alias("t")).where(F.rlike("t", F.lit(WORDS))).select("__key", once(F.regexp_extract_all(F.lower("t"), F.lit(TERM), F.lit(0))).alias("w"))
    triples = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    files = files.where(F.size("w") >= 3).select("*", once(triples).alias("h"))
    made = F.array(*[F.struct(F.xxhash64(*map(F.lit, x)).alias("h"), F.lit(i).alias("n_text"), F.lit(at).alias("at"), F.lit(n[i]).alias("n")) for i, at, x in marks])
    held = files.select("*", once(F.array_intersect("h", F.transform(made, lambda a: a["h"]))).alias("m")).where(F.size("m") > 0)
    at = F.filter(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.array_contains("m", x["h"]))
    held = held.select("__key", "w", at.alias("hits"), F.filter(made, lambda a: F.array_contains("m", a["h"])).alias("made"))
    start = lambda a, x: F.struct(a["n_text"].alias("n_text"), F.greatest(x["i"] - a["at"], F.lit(0)).alias("at"), a["n"].alias("n"))
    starts = F.flatten(F.transform("made", lambda a: F.transform(F.filter("hits", lambda x: x["h"] == a["h"]), lambda x: start(a, x))))
    parts = F.transform(F.array_distinct(starts), lambda c: F.struct(c["n_text"].alias("n_text"), c["at"].alias("at"), F.slice("w", c["at"] + 1, c["n"]).alias("terms")))
    parts = held.select("__key", F.size("w").alias("all"), F.explode(parts).alias("c")).select("__key", "all", "c.n_text", "c.at", F.explode("c.terms").alias("term"))
    counted = parts.groupBy("__key", "at", "n_text", "all", "term").count()
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf long")
    table = spark.createDataFrame(rows, "n_text int, term string, x long")
    both = counted.join(F.broadcast(known), "term", "left").join(F.broadcast(table), ["n_text", "term"], "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(LITTLE)))
    sums = both.groupBy("__key", "at", "n_text", "all").agg(F.sum(F.col("w") * F.col("w")).alias("size"), F.sum(F.col("w") * F.coalesce("x", F.lit(0))).alias("dot"))
    texts = spark.createDataFrame(texts, "n_text int, license string, n int, whole boolean, length long")
    scored = sums.join(F.broadcast(texts), "n_text").withColumn("match", cosine("dot", "size", "length")).where(F.col("match") >= WINDOW)
    return scored.select("__key", "license", "match", (F.col("whole") & (2 * F.col("n") >= F.col("all"))).alias("whole"))


def tags(files: DataFrame, text: str) -> DataFrame:
    """(key, license): SPDX tags, the suffixes of versions taken off."""
    found = files.select("__key", texts_of(files, text).alias("t")).where(F.rlike("t", F.lit(SPDX)))
    found = found.select("__key", F.explode(F.regexp_extract_all("t", F.lit(SPDX), F.lit(1))).alias("license"))
    return found.select("__key", F.regexp_replace("license", r"-only\b|-or-later\b|(?<=[0-9])\+|[()]", "").alias("license"))


def lines_near(files: DataFrame, text: str) -> DataFrame:
    """(key, license, match, rank): lines near a short template; rank 3 with all terms weighed in full, 4 with unknown ones weighed little."""
    spark = files.sparkSession
    rows, length, idf, other = template_rows()
    lines = files.select("__key", texts_of(files, text).alias("t")).where(F.rlike("t", F.lit(ANCHOR)))
    lines = lines.select("__key", F.posexplode(F.split("t", "\n")).alias("line", "l")).where(F.rlike("l", F.lit(ANCHOR)))
    held = lines.select("__key", "line", F.explode(F.regexp_extract_all(F.lower("l"), F.lit(TERM), F.lit(0))).alias("term"))
    counted = held.groupBy("__key", "line", "term").count()
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf long")
    weighted = counted.join(F.broadcast(known), "term", "left").withColumns({"w": F.col("count") * F.coalesce("idf", F.lit(other)), "v": F.col("count") * F.coalesce("idf", F.lit(LITTLE))})
    size = weighted.groupBy("__key", "line").agg(F.sum(F.col("w") * F.col("w")).alias("size"), F.sum(F.col("v") * F.col("v")).alias("size_v"))
    telling = {k: t.split() for k, t in TELLING.items()}
    table = [(w, k, x, length[k], int(w in telling[k]), len(telling[k])) for w, k, x in rows]
    table = spark.createDataFrame(table, "term string, license string, x long, length long, tells int, telling int")
    dots = weighted.join(F.broadcast(table), "term").groupBy("__key", "line", "license", "length", "telling").agg(F.sum(F.col("w") * F.col("x")).alias("dot"), F.sum("tells").alias("told"))
    scored = dots.join(size, ["__key", "line"]).withColumns({"m3": cosine("dot", "size", "length"), "m4": cosine("dot", "size_v", "length")})
    full = F.col("m3") >= MATCH
    scored = scored.where(full | ((F.col("m4") >= MATCH) & (F.col("told") == F.col("telling"))))
    return scored.select("__key", "license", F.when(full, F.col("m3")).otherwise(F.col("m4")).alias("match"), F.when(full, F.lit(3)).otherwise(F.lit(4)).alias("rank"))


def notices(files: DataFrame, text: str = "text") -> DataFrame:
    """(key, license, match, whole): each file's best notice, match in thousandths. files: __key and the text."""
    no = F.lit(False).alias("whole")
    rows = tags(files, text).select("__key", "license", F.lit(1000).cast("long").alias("match"), F.lit(1).alias("rank"), no)
    rows = rows.unionByName(windows(files, text).withColumn("rank", F.lit(2))).unionByName(lines_near(files, text).select("*", no))
    best = rows.groupBy("__key").agg(F.min(F.struct("rank", (-F.col("match")).alias("m"), "license")).alias("b"), F.max("whole").alias("whole"))
    return best.select("__key", F.col("b.license").alias("license"), (-F.col("b.m")).alias("match"), "whole")


#: Names of licence files, of source code, and of files that are no licence files by a short notice alone.
NAMED = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright)([._-][^/]*)?$"
SOURCE = r"(?i)\.(py|js|mjs|ts|tsx|jsx|c|h|cc|cpp|hpp|cs|java|kt|scala|go|rs|rb|php|pl|sh|swift|m|r|lua|css|sql|json|ya?ml|toml|xml)$"
CODE = r"(?i)\.(?!txt$|text$|md$|rst$|html?$|adoc$)[a-z][a-z0-9+#]*$"


def directory(path: Column) -> Column:
    """The path up to its last separator; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(dirs: DataFrame) -> DataFrame:
    """(dir, ancestor, depth) for each directory: itself and all above it, '' the topmost."""
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))
    rows = dirs.select("dir", parts.alias("p"), F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    return rows.select("dir", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("ancestor"), "depth")


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files without the text, with own_license, own_match, license and license_dir (the directory it was inherited from)."""
    made = ("own_license", "own_match", "license", "license_dir")
    files = files.select(*[c for c in files.columns if c not in made])
    # A file is known by its path and text, so that rows which repeat a path keep their own notices.
    keyed = files.withColumns({"__key": F.sha2(F.concat_ws("\0", F.coalesce(F.col(path), F.lit("")), texts_of(files, text)), 256), "__dir": directory(F.col(path))})
    keyed = keyed.withColumn("__words", F.when(F.rlike(texts_of(keyed, text), F.lit(ANCHOR)), F.regexp_count(texts_of(keyed, text), F.lit(WORD))))
    own = materialize(notices(keyed, text), "notices").withColumnsRenamed({"license": "own_license", "match": "own_match", "whole": "__whole"})
    rows = keyed.select(*[c for c in keyed.columns if c != text]).join(own, "__key", "left")
    rows = materialize(rows, "licensed-files")
    short = (F.col("__words") < LICENCE_FILE) & ~F.rlike(F.col(path), F.lit(CODE))
    source = F.rlike(F.col(path), F.lit(SOURCE))
    kind = F.when(~source & (F.rlike(F.col(path), F.lit(NAMED)) | F.coalesce("__whole", F.lit(False))), F.lit(0)).when(short, F.lit(1))
    licensed = rows.withColumn("__kind", kind).where(F.col("__kind").isNotNull() & F.col("own_license").isNotNull() & F.col("__dir").isNotNull())
    licensed = licensed.groupBy(F.col("__dir").alias("ancestor")).agg(F.min(F.struct("__kind", (-F.col("own_match")).alias("m"), F.col("own_license").alias("license"))).alias("b"))
    dirs = rows.where(F.col("__dir").isNotNull()).select(F.col("__dir").alias("dir")).distinct()
    found = ancestors(dirs).join(licensed.select("ancestor", "b.license"), "ancestor")
    nearest = found.groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "license")).alias("n"))
    nearest = materialize(nearest.select(F.col("dir").alias("__at"), F.col("n.license").alias("__license"), F.col("n.ancestor").alias("__from")), "licensed-dirs")
    out = rows.join(nearest, rows["__dir"] == nearest["__at"], "left")
    rest = [c for c in files.columns if c != text]
    own_there = F.col("own_license").isNotNull()
    return out.select(*rest, "own_license", "own_match", F.coalesce("own_license", "__license").alias("license"), F.when(~own_there, F.col("__from")).alias("license_dir"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the licence of every document, as a file source/lang/id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    files = docs.select("doc_id", path.alias("path"), "text")
    return scan(files).select("doc_id", "own_license", "own_match", "license", "license_dir")


def _oracle() -> str:
    rows, length, idf, other = template_rows()
    known = ", ".join(f"('{w}', {x})" for w, x in sorted(idf.items()))
    table = ", ".join(f"('{w}', '{k}', {x}, {length[k]})" for w, k, x in rows)
    return f"""
WITH f AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir FROM documents),
l AS (SELECT rid, i, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM f) WHERE regexp_matches(line, '{ANCHOR}')),
w AS (SELECT rid, i, term, count(*) AS n FROM (SELECT rid, i, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM l) GROUP BY ALL),
x AS (SELECT w.rid, w.i, w.term, n * coalesce(k.idf, {other}) AS w FROM w LEFT JOIN (VALUES {known}) k(term, idf) ON w.term = k.term),
z AS (SELECT rid, i, sum(w * w) AS size FROM x GROUP BY ALL),
d AS (SELECT x.rid, x.i, license, length, sum(w * v) AS dot FROM x JOIN (VALUES {table}) t(term, license, v, length) ON x.term = t.term GROUP BY ALL),
m AS (SELECT d.rid, license, floor(1000 * dot::BIGINT / sqrt(size::DOUBLE * length::DOUBLE))::BIGINT AS m FROM d JOIN z ON d.rid = z.rid AND d.i = z.i),
o AS (SELECT rid, first(license ORDER BY m DESC, license) AS own_license, max(m) AS own_match FROM m WHERE m >= {MATCH} GROUP BY rid),
g AS (SELECT f.rid, f.doc_id, f.dir, f.t, own_license, own_match FROM f LEFT JOIN o ON f.rid = o.rid),
s AS (SELECT dir, first(own_license ORDER BY own_match DESC, own_license) AS license FROM g
      WHERE own_license IS NOT NULL AND len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) < {LICENCE_FILE} GROUP BY dir)
SELECT doc_id, own_license, own_match, coalesce(own_license, s.license) AS license, CASE WHEN own_license IS NULL THEN s.dir END AS license_dir
FROM g LEFT JOIN s ON g.dir = s.dir
"""


ORACLE = _oracle()
