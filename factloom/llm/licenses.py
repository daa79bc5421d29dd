"""Licence scan by canonical digests.

A text is brought to canonical form - case folded, copyright lines dropped, equivalent spellings made one, everything but
letters and digits taken as a blank - and its SHA-256 is hash-joined to the digests of known licences and notices. Entire
texts are looked up, and each line as an entire notice; both by the same form, so that neither layout nor spelling matters.

Null and empty texts match nothing; a text of any length is digested whole; each row is a text of its own even if its id repeats; a line found twice counts
twice; an empty table gives no rows; further columns are ignored. The table of known licences is a parameter; the join is
broadcast only if Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: wording of public licences and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd() -> list[tuple[str, str]]:
    """The wordings of the two BSD licences: with and without title and reserved rights, numbers or bullets, holder or owner."""
    out = []
    for clauses, name in ((BSD, "BSD-2-Clause"), (BSD + BSD_3, "BSD-3-Clause")):
        for title in ("", name.replace("-Clause", "-Clause License").replace("BSD-", "BSD ") + "\n"):
            for reserved in ("", "All rights reserved.\n"):
                for body in (clauses, clauses.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")):
                    for end in (BSD_END, BSD_END.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")):
                        out.append((name, title + reserved + body + end))
    return out


#: Fixed values: digests of the canonical form of whole texts as Debian's /usr/share/common-licenses has them; Apache-2.0 also without its appendix.
DIGESTS = [
    ("Apache-2.0", "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e"),
    ("CC0-1.0", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
    ("Artistic-1.0", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("GFDL-1.2", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", "308a357adeb0d8a10fe0d0ff9bcc6322de39d728fd1073b64d31129a85a77f5a"),
    ("Apache-2.0", "cf7c26411074d941b42afe8baac32788531f003acea32d25ead49048c329c78d"),
]
KNOWN = [
    *_bsd(),
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]
#: Fixed values: spellings taken as the same.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("v", "version"), ("non infringement", "noninfringement"), ("creative commons attribution", "cc by")]
COPYRIGHT = r"(?im)^[ \t#*/;-]*(?:copyright|\(c\)|©).*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text, in SQL functions that DuckDB has alike."""
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, " ")), r"[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in SPELLINGS * 2:  # neighbours share a blank, so that one pass misses every second of them
        padded = F.replace(padded, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(padded)


def canonical_sql(text: str) -> str:
    """As ``canonical``, in DuckDB's SQL."""
    words = f"trim(regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT}', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    padded = f"(' ' || {words} || ' ')"
    for a, b in SPELLINGS * 2:
        padded = f"replace({padded}, ' {a} ', ' {b} ')"
    return f"trim({padded})"


def oracle() -> str:
    """DuckDB's SQL for ``scan`` over the table documents."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"  # noqa: E731
    texts = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    digests = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in DIGESTS)
    return rf"""WITH known AS (SELECT license, sha256({canonical_sql("text")}) AS digest FROM (VALUES {texts}) k(license, text) UNION SELECT * FROM (VALUES {digests}) g(license, digest)),
base AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT row, min(license) AS license FROM (SELECT row, {canonical_sql("text")} AS c FROM base) JOIN known ON digest = sha256(c) WHERE c <> '' GROUP BY row),
cut AS (SELECT row, {canonical_sql("t")} AS c FROM (SELECT row, unnest(string_split_regex(text, '?
')) AS t FROM base)),
notices AS (SELECT row, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM cut JOIN known ON digest = sha256(c) WHERE c <> '' GROUP BY row)
SELECT doc_id, whole.license AS whole_license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS licenses FROM base LEFT JOIN whole USING (row) LEFT JOIN notices USING (row)"""


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of KNOWN and DIGESTS."""
    rows = spark.createDataFrame(KNOWN, "license string, text string")
    whole = spark.createDataFrame(DIGESTS, "license string, digest string").select("digest", "license")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").unionByName(whole).distinct()


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, whole_license (null if none), n_notices, licenses (sorted, comma-joined).

    Lines whose form is longer than any notice still are hashed and joined; a text's own row carries its id through.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    units = F.concat(F.array(F.col("text")), F.split("text", r"\r?\n"))
    lines = base.select("row", "doc_id", F.posexplode(units).alias("unit", "t")).select("row", "doc_id", "unit", F.sha2(canonical(F.col("t")), 256).alias("digest"))
    nothing = F.sha2(F.lit(""), 256)
    # blank lines go before the join, blank texts get a key of their own: neither is a hot key
    lines = lines.where((F.col("unit") == 0) | (F.col("digest") != nothing))
    lines = lines.withColumn("digest", F.when(F.col("digest") == nothing, F.col("row").cast("string")).otherwise(F.col("digest")))
    found = lines.join(licenses, "digest", "left").where((F.col("unit") == 0) | F.col("license").isNotNull())
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min(F.when(F.col("unit") == 0, F.col("license"))).alias("whole_license"),
            F.count(F.when((F.col("unit") > 0) & F.col("license").isNotNull(), 1)).alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("unit") > 0, F.col("license")))), ",").alias("licenses"),
        )
        .drop("row")
    )
