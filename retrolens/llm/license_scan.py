"""Licence scan by canonical digest lookup.

A text is brought to a canonical form line by line: lower case, equivalent
spellings made one, everything but letters and digits turned into single spaces,
copyright statements dropped (with a year or without, at the head of a longer
line or alone) and lines dropped that hold nothing but a licence's title. The
SHA-256 of the whole canonical text is joined with the digests of known licence
texts: ``license``. Besides, lines as long as a known one-line notice are joined
by their digests: ``notices``. Only built-in functions are used.

Defined results: a null text counts as empty; a text whose canonical form is
empty matches no licence; equal rows each get a row; known texts with the same
canonical form count once (smallest name); an id that is no integer is carried
as null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_id

#: Spellings that licence matching treats as one.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non-", "non"),
    ("merchantibility", "merchantability"),
    ("https:", "http:"),
    ("(c)", "copyright"),
    ("©", "copyright"),
)
#: Titles that stand above a licence's text, in canonical form.
TITLES = (
    "license", "license text", "mit", "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "mit 0", "mit no attribution", "mit no attribution license",
    "isc", "isc license", "the isc license", "isc license isc", "0bsd", "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "bsd license",
    "bsd 2 clause", "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license", "bsd 2 clause simplified license", "freebsd license",
    "bsd 3 clause", "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "revised bsd license", "modified bsd license", "bsd 3 clause new or revised license",
    "zlib", "zlib license", "the zlib license",
)
#: Words after "copyright" where a wrapped line of a licence's own text goes on.
GOES_ON = (
    "holder", "holders", "owner", "owners", "notice", "notices", "license", "licenses", "law", "laws", "act", "interest", "interests", "statement", "statements", "protection", "treaty",
    "and", "or", "in", "on", "to", "is", "of", "as", "are", "for", "the", "a", "this", "that", "which", "by", "with", "disclaimer", "infringement", "status", "assignment",
)
#: How licence texts begin; a copyright statement before them on the same line ends there.
OPENINGS = ("permission is hereby granted", "permission to use", "redistribution and use", "licensed under the", "released under the", "this software is provided")

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_NO_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Texts of known licences and of the usual one-line notices.
KNOWN = (
    ("MIT", f"{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_NO_WARRANTY}"),
    ("MIT-0", f"{_GRANT.removesuffix(', subject to the following conditions:')}.\n\n{_NO_WARRANTY}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_NO_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_NO_WARRANTY}"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n" + _BSD_NO_WARRANTY,
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_NO_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    ("notice:MIT", "Released under the MIT License."),
    ("notice:Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice:GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice:CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


#: SHA-256 of the canonical forms of licences in common use, too long to be given as texts.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "6ac6fd4f2c97251b88ad9f714747fbaa7ee55fc9d89c957efd3b001c6e119079"),
    ("Artistic-1.0-Perl", "a0704f8e4bb86d390b13a61e76900d7f01e306e8eff6aee99c40c905e77b4b80"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "5b70249b146cbacc93a2d67b43dacf44c48ce8cfb229320047f2c30f7c27a489"),
    ("GPL-2.0", "ada43b21b16dd64b4b8f1d9c2ab43ff16f75a8f0f835fc2f37a0c7e65f28d243"),
    ("GPL-3.0", "8e9861f0241ecdbed164792fa0250e24aa9d80c465b5a3fa3fb1b343e7d0e11f"),
    ("LGPL-2.0", "c36ee56beb8d6b7858c078dd0dde2d921f57cb188ec055ab9ffc8fa4879cb4e4"),
    ("LGPL-2.1", "c0ce92e93c060a966ef1fbe8efd240fbcb70fe73aa91be8ea554a2861382b3ae"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "943b3fdc7f6980b75d990eacb1a87912fc1b4207612a5a8c728ed14706534a2d"),
    ("MPL-2.0", "29c715c830b16615bed8ce9fa11adb1ed035c074e9c27cfb5ee68c803276d97b"),
)


def _drop(line: Column) -> Column:
    """Whether a canonical line is a copyright statement, or a title."""
    named = line.rlike("^(portions |parts )?copyright( |$)")
    goes_on = line.rlike(f"^(portions |parts )?copyright ({'|'.join(GOES_ON)})( |$)") & ~line.rlike("(^| )[0-9]{4}( |$)")
    return (line == "") | (named & ~goes_on) | line.isin(*TITLES)


def lines(text: Column) -> Column:
    """The canonical lines of a text; none for null."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(out, F.lit("all rights reserved"), F.lit("\n"))
    out = F.regexp_replace(out, f"(copyright [^\\n]{{0,200}}?)({'|'.join(OPENINGS)})", "$1\n$2")
    out = F.regexp_replace(out, r"(copyright (copyright |[0-9]{4}))", "\n$1")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: ~_drop(x))


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    return F.array_join(lines(text), " ")


def known_texts(spark: SparkSession) -> DataFrame:
    """(license, text) of the built-in licences."""
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest) of licences known by their digests alone."""
    return spark.createDataFrame(list(DIGESTS), "license string, digest string")


def scan(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id", digests: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_canonical, digest, license, notices), a row per input row;
    license is null where the whole text is no known licence; notices: names of
    the one-line notices (known texts named ``notice:``) that are lines of the
    text, sorted and parted by commas, null if there is none."""
    digest = lambda c: F.sha2(c, 256)
    table = known.select("license", canonical(F.col("text")).alias("_form")).where("_form <> ''")
    short = table.where("license LIKE 'notice:%'").agg(F.array_sort(F.collect_set(F.length("_form")))).first()[0]  # as many as there are notices at most
    table = table.select("license", digest(F.col("_form")).alias("digest"))
    listed = (table if digests is None else table.union(digests)).groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(row_id(key).alias("doc_id"), lines(F.col(text)).alias("_lines"))
    form = F.array_join("_lines", " ")
    cited = F.transform(F.filter("_lines", lambda x: F.length(x).isin(*short)), digest) if short else F.array().cast("array<string>")
    # a row's number tells equal rows apart; materialised, it stays
    rows = cut(rows.select("doc_id", F.length(form).cast("long").alias("n_canonical"), digest(form).alias("digest"), F.array_distinct(cited).alias("_cited"), F.monotonically_increasing_id().alias("_row")))
    hits = rows.select("_row", F.explode("_cited").alias("digest")).join(listed.where("license LIKE 'notice:%'"), "digest")
    hits = hits.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return rows.join(listed, "digest", "left").join(hits, "_row", "left").select("doc_id", "n_canonical", "digest", "license", "notices")


def oracle_sql() -> str:
    """scan() over documents with the built-in licences, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    several = lambda words: ", ".join(map(quote, words))

    def form(c: str) -> str:
        c = f"lower(coalesce({c}, ''))"
        for a, b in SPELLINGS:
            c = f"replace({c}, {quote(a)}, {quote(b)})"
        c = f"replace({c}, 'all rights reserved', chr(10))"
        c = f"regexp_replace({c}, '(copyright [^\\n]{{0,200}}?)({'|'.join(OPENINGS)})', '\\1' || chr(10) || '\\2', 'g')"
        c = f"regexp_replace({c}, '(copyright (copyright |[0-9]{{4}}))', chr(10) || '\\1', 'g')"
        c = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        return f"list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' '))"

    start = "^(portions |parts )?copyright"
    drop = f"x = '' OR x IN ({several(TITLES)}) OR (regexp_matches(x, '{start}( |$)') AND NOT (regexp_matches(x, '{start} ({'|'.join(GOES_ON)})( |$)') AND NOT regexp_matches(x, '(^| )[0-9]{{4}}( |$)')))"
    kept = lambda c: f"list_filter({form(c)}, lambda x: NOT ({drop}))"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    held = ", ".join(f"({quote(n)}, {quote(d)})" for n, d in DIGESTS)
    return f"""
WITH known(license, text) AS (VALUES {values}), held(license, digest) AS (VALUES {held}),
forms AS (SELECT license, array_to_string({kept('text')}, ' ') AS form FROM known),
listed AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256(form) AS digest FROM forms WHERE form <> '' UNION ALL SELECT * FROM held) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {kept('text')} AS ls FROM documents),
lined AS (SELECT r, unnest(ls) AS l FROM docs),
cited AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lined JOIN listed ON listed.digest = sha256(l) WHERE license LIKE 'notice:%' GROUP BY r)
SELECT doc_id, length(array_to_string(ls, ' ')) AS n_canonical, sha256(array_to_string(ls, ' ')) AS digest, license, notices
FROM docs LEFT JOIN listed ON listed.digest = sha256(array_to_string(ls, ' ')) LEFT JOIN cited USING (r)"""
