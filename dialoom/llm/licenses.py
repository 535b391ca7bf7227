"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory, in DataFrame functions only.

Every line of the whole text that holds a cue (`licens`, `copyright`, ...) is a segment. So is every block with a cue: a
paragraph, a run of comment lines (a header) and the whole of a licence file. Distinct segments and the templates are token
vectors, (1 + ln tf) * idf, with document frequencies over all distinct segments and templates; lines and blocks are two
such collections, and blocks have the notices as templates too. Each segment's best template counts from a cosine of `least`
(rounded to six digits; ties go to the smaller name); what denies a licence ("not licensed under ...") matches none. A file's own licence is its best segment's; n_segments counts its
lines, and one for a block that scores above them. Licence files give theirs to their directory (best score, then smallest path); a file without its own takes
that of the nearest directory above it.

Shared lines and large directories are hot keys: results for those are broadcast, at most 2000 of them, and all others are
joined by shuffles (join_by_frequency).

Defined results: null or empty texts have no segments; a null path has no directory; repeated rows each get a row; an empty
table gives an empty one; of further columns only the ids asked for are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import join_by_frequency, materialise
from dialoom.llm.decontaminate import let

# Phrases by which licences are named or granted.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
# What a line must hold to be a segment.
CUES = ["licens", "licenc", "copyright", "rights reserved", "permission", "redistribut", "public domain", "creative commons", "spdx", "waived"]
# Notices of more than one line, to which blocks are compared.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
NOTICES = {
    "AGPL-3.0": [GNU.format("Affero General Public License", 3), (GNU + GNU_REST).format("Affero General Public License", 3)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": [BSD, BSD + BSD_AS_IS],
    "BSD-3-Clause": [BSD + BSD_THIRD, BSD + BSD_THIRD + BSD_AS_IS],
    "GPL-2.0": [GNU.format("General Public License", 2), (GNU + GNU_REST).format("General Public License", 2)],
    "GPL-3.0": [GNU.format("General Public License", 3), (GNU + GNU_REST).format("General Public License", 3)],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [GNU.format("Lesser General Public License", 2.1), (GNU + GNU_REST).format("Lesser General Public License", 2.1)],
    "LGPL-3.0": [GNU.format("Lesser General Public License", 3), (GNU + GNU_REST).format("Lesser General Public License", 3)],
    "MIT": [MIT, MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + AS_IS],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
# What says that a licence doesn't hold; in blocks only up to DENIED_WORDS words, as whole licences say much.
DENIAL = r"\b(not|never|no longer) (be )?(licensed|released|available|covered)\b"
DENIED_WORDS = 40
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|rem\b|dnl\b)"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def has_cue(text: Column, cues: list[str]) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(cues[0]))
    for x in cues[1:]:
        found = found | F.contains(low, F.lit(x))
    return found


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def blocks_of(text: Column, is_file: Column) -> Column:
    """The paragraphs, the runs of comment lines, and the whole of a licence file."""
    comment = lambda x: x.rlike(COMMENT)
    blank = lambda x: ~x.rlike("[A-Za-z0-9]")

    def cut(lines: Column, ends: Callable[[Column], Column]) -> Column:
        turns = lambda x, i: (i > 0) & (comment(x) != comment(F.get(lines, F.greatest(i - 1, F.lit(0)))))
        marked = F.transform(lines, lambda x, i: F.concat(F.when(ends(x) | turns(x, i), F.lit("\x01")).otherwise(F.lit(" ")), x))
        return F.split(F.array_join(marked, ""), "\x01")

    each = lambda lines: F.concat(cut(lines, blank), cut(lines, lambda x: blank(x) & ~comment(x)))
    return F.concat(let(F.split(text, "\n"), each), F.when(is_file, F.array(text)).otherwise(F.array().cast("array<string>")))


def weights(vectors: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """key, token, weight (of unit length) of (key, token, tf), a written table."""
    raw = join_by_frequency(vectors, idf, "token").withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, key).select(key, "token", (F.col("w") / F.col("length")).alias("weight"))


def classify_segments(segments: DataFrame, templates: dict[str, list[str]], least: float) -> DataFrame:
    """segment, license and score of the distinct segments (segment, words) that match a template."""
    spark = segments.sparkSession
    forms = [(f"{name}/{k}", name, text) for name, texts in templates.items() for k, text in enumerate(texts)]
    forms = spark.createDataFrame(forms, "form string, license string, text string")
    split = lambda df, key, text: df.select(key, F.explode(tokens_of(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    ours = materialise(split(segments, "segment", F.col("words")), "segments")
    theirs = materialise(split(forms, "form", F.col("text")), "forms")
    total = segments.count() + forms.count()
    idf = ours.select("token").union(theirs.select("token")).groupBy("token").agg((F.log((1 + F.lit(total)) / (1 + F.count("*"))) + 1).alias("idf"))
    idf = materialise(idf, "idf")
    near = weights(theirs, "form", idf).join(forms.select("form", "license"), "form").withColumnRenamed("weight", "theirs")
    dots = weights(ours, "segment", idf).join(F.broadcast(near), "token").groupBy("segment", "form", "license").agg(F.round(F.sum(F.col("weight") * F.col("theirs")), 6).alias("score"))
    denied = segments.where((F.size(F.split("words", " ")) <= DENIED_WORDS) & F.col("words").rlike(DENIAL)).select("segment")
    best = dots.where(F.col("score") >= least).join(denied, "segment", "left_anti").groupBy("segment").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    return best.select("segment", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), licence_file: Column | None = None, templates: dict[str, list[str]] = TEMPLATES, notices: dict[str, list[str]] = NOTICES, cues: list[str] = CUES, least: float = 0.7) -> DataFrame:
    """path, the kept columns, n_segments (that match), own_license, own_score, license and inherited_from."""
    text = F.col(text_col)
    lines = F.when(has_cue(text, cues), F.filter(F.split(text, "\n"), lambda x: has_cue(x, cues)))
    joined = lambda xs: F.transform(xs, lambda x: F.array_join(tokens_of(x), " "))
    is_file = F.col(path_col).rlike(LICENCE_FILE) if licence_file is None else licence_file
    blocks = F.when(has_cue(text, cues), F.filter(blocks_of(text, F.coalesce(is_file, F.lit(False))), lambda x: has_cue(x, cues)))
    none = F.array().cast("array<string>")
    rows = files.select(
        F.monotonically_increasing_id().alias("row"), F.col(path_col).alias("path"), *(F.col(k).alias(f"keep_{k}") for k in keep),
        F.coalesce(joined(lines), none).alias("found"), F.coalesce(joined(blocks), none).alias("blocks"), F.coalesce(is_file, F.lit(False)).alias("gives"),
    )
    rows = materialise(rows, "files")
    each = materialise(rows.select("row", F.explode("found").alias("segment")), "lines")
    distinct = materialise(each.select("segment").distinct(), "distinct")
    matched = materialise(classify_segments(distinct.select("segment", F.col("segment").alias("words")), templates, least), "matched")
    scored = join_by_frequency(each, matched, "segment").where(F.col("license").isNotNull())
    # blocks, by a digest as they may be long; those of one line are lines already
    more = rows.select("row", F.explode(F.array_except("blocks", "found")).alias("words")).withColumn("segment", F.unhex(F.md5("words")))
    more = materialise(more, "blocks")
    whole = materialise(more.groupBy("segment").agg(F.first("words").alias("words")), "distinct-blocks")
    # what another licence's notice says too doesn't tell them apart
    shared = lambda k, x: any(x in y for other, ys in notices.items() if other != k for y in ys)
    both = {k: [x for x in templates.get(k, []) if not shared(k, x)] + notices.get(k, []) for k in {**templates, **notices}}
    of_blocks = materialise(classify_segments(whole, both, least), "matched-blocks")
    held = join_by_frequency(materialise(more.select("row", "segment"), "held"), of_blocks, "segment").where(F.col("license").isNotNull())
    scored = scored.select("row", "license", "score", F.lit(1).alias("line")).union(held.select("row", "license", "score", F.lit(0).alias("line")))
    best = F.min(F.struct((-F.col("score")).alias("less"), (-F.col("line")).alias("order"), "license"))
    own = scored.groupBy("row").agg(F.sum("line").alias("n"), best.alias("b")).select("row", "b", (F.col("n") + 1 + F.col("b.order")).alias("n_segments"))
    rows = rows.drop("found", "blocks").join(own, "row", "left").withColumn("own_license", F.col("b.license")).withColumn("own_score", -F.col("b.less")).drop("b")
    rows = materialise(rows.withColumn("dir", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")), "owned")
    given = rows.where(F.col("gives") & F.col("own_license").isNotNull() & F.col("dir").isNotNull()).groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("less"), "path", "own_license")).alias("b")).select("above", F.col("b.own_license").alias("given"))
    parts = F.split("dir", "/")
    upward = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    above = rows.where(F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.explode(F.array_distinct(upward)).alias("above"))
    nearest = above.join(given, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("deep"), "above", "given")).alias("b")).select("dir", F.col("b.above").alias("from"), F.col("b.given").alias("given"))
    out = join_by_frequency(rows, materialise(nearest, "nearest"), "dir")
    lacks = F.col("own_license").isNull()
    return out.select(*(F.col(f"keep_{k}").alias(k) for k in keep), "path", F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), F.when(lacks, F.col("from")).alias("inherited_from"))


def document_path() -> Column:
    """Documents lie at depths one to three of their source's tree."""
    block = F.floor(F.col("doc_id") / 500).cast("string")
    parts = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array("source")).when(F.pmod("doc_id", F.lit(3)) == 1, F.array("source", "lang")).otherwise(F.array(F.col("source"), F.col("lang"), block))
    return F.array_join(F.concat(parts, F.array(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))), "/")


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    forms = ", ".join(f"({quote(f'{n}/{k}')}, {quote(n)}, {quote(t)})" for n, ts in TEMPLATES.items() for k, t in enumerate(ts))
    cue = lambda c: "(" + " OR ".join(f"contains(lower({c}), {quote(x)})" for x in CUES) + ")"
    tokens = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH f AS (
  SELECT doc_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN [source] WHEN 1 THEN [source, lang] ELSE [source, lang, CAST(doc_id // 500 AS VARCHAR)] END || [doc_id || '.txt'], '/') AS path,
    coalesce(contains(lower(string_split(text, chr(10))[1]), 'licens'), false) AS gives, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, array_to_string({tokens('l')}, ' ') AS segment FROM (SELECT doc_id, unnest(ls) AS l FROM f) WHERE {cue('l')}),
forms(form, license, text) AS (VALUES {forms}),
d AS (SELECT DISTINCT segment FROM l),
v AS (
  SELECT 's' AS kind, segment AS k, token, count(*) AS tf FROM (SELECT segment, unnest({tokens('segment')}) AS token FROM d) GROUP BY ALL
  UNION ALL SELECT 't', form, token, count(*) FROM (SELECT form, unnest({tokens('text')}) AS token FROM forms) GROUP BY ALL),
idf AS (SELECT token, ln((1 + (SELECT count(*) FROM d) + (SELECT count(*) FROM forms)) / (1 + count(*))) + 1 AS idf FROM v GROUP BY token),
w AS (SELECT kind, k, token, (1 + ln(tf)) * idf AS w FROM v JOIN idf USING (token)),
n AS (SELECT kind, k, sqrt(sum(w * w)) AS n FROM w GROUP BY ALL),
u AS (SELECT kind, k, token, w / n AS w FROM w JOIN n USING (kind, k)),
dots AS (SELECT s.k AS segment, license, form, round(sum(s.w * t.w), 6) AS score FROM u s JOIN u t ON s.token = t.token AND s.kind = 's' AND t.kind = 't' JOIN forms ON form = t.k GROUP BY ALL),
best AS (SELECT segment, license, score FROM dots WHERE score >= 0.7 AND NOT (len(string_split(segment, ' ')) <= {DENIED_WORDS} AND regexp_matches(segment, {quote(DENIAL)})) QUALIFY row_number() OVER (PARTITION BY segment ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, license AS own_license, score AS own_score, n_segments FROM (SELECT doc_id, license, score, count(*) OVER (PARTITION BY doc_id) AS n_segments, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM l JOIN best USING (segment)) WHERE r = 1),
r AS (SELECT f.doc_id, path, gives, regexp_replace(path, '/[^/]*$', '') AS dir, own_license, own_score, coalesce(n_segments, 0) AS n_segments FROM f LEFT JOIN own USING (doc_id)),
given AS (SELECT dir AS above, own_license AS given FROM r WHERE gives AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1),
near AS (
  SELECT doc_id, above, given FROM r JOIN given ON r.dir = above OR starts_with(r.dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, CAST(n_segments AS BIGINT) AS n_segments, own_license, own_score, coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM r LEFT JOIN near USING (doc_id)
"""


ORACLE = _oracle()
