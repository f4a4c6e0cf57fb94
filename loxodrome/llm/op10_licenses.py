"""License scans by canonical digest lookup.

A text is brought to a canonical form (letter case, copyright lines, punctuation, white space, equivalent
spellings) and its SHA-256 looked up, by a hash join, among the digests of known licence texts in the same form.
Entire texts are compared: the document as a whole and, as texts of their own, its lines, so that a short notice
is found wherever it stands. Only DataFrame functions are used.

A text is canonicalised once, and its lines are looked up in its own row: those that are as long as some known text
are digested. The known texts (:data:`KNOWN` in full, :data:`DIGESTS` of longer ones) are parameters; they may be
:data:`MAX_KNOWN` at most, which is checked before they go to all tasks.

Defined cases: a null or empty text has the digest of the empty text and no licence; every row is kept, repeated
ones too, and judged by its own text, whatever its id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.llm.frames import narrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that is a copyright notice: its holder and year differ from copy to copy.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: ASCII but letters, digits and line ends; typographic dashes and quotes.
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{2010}-\x{201f}]+"
#: Spellings that count as equal, in canonical form.
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
)
MAX_KNOWN = 10_000
#: Licences of whole files too long to be kept here: name, length and SHA-256 of the canonical form of the published text.
DIGESTS = (
    ("Apache-2.0", 9706, "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Artistic-1.0-Perl", 5683, "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19510, "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3", 21879, "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 17053, "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", 33277, "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("LGPL-2.0", 23937, "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", 25024, "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22340, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 14272, "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn "
    "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE "
    "IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more "
    "information, please refer to <https://unlicense.org>"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
    "by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the "
    "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies "
    "of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
    "machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
    "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
    "copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
    "License for the specific language governing permissions and limitations under the License."
)
#: Licences by identifier, with the names that one-line notices have for them.
SPDX = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"), "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",), "BSL-1.0": ("Boost Software License, Version 1.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0"), "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL-2.0"), "EPL-2.0": ("Eclipse Public License 2.0",), "CC0-1.0": ("CC0 1.0",), "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
}
#: Known texts: (licence, whole text or notice). Notices are those in common use.
KNOWN = (
    ("MIT", _MIT + _AS_IS),
    ("MIT", "MIT License\n\n" + _MIT + _AS_IS),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT + _AS_IS),
    ("BSD-2-Clause", _BSD_TWO + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THREE + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TWO + _BSD_THREE + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    *((spdx, f"SPDX-License-Identifier: {spdx}{end}") for spdx in SPDX for end in ("", "-only", "-or-later")),
    *((spdx, f"{said} under {the}{name}.") for spdx, names in SPDX.items() for name in names for said in ("Licensed", "Released") for the in ("", "the ")),
)


def _spelt(t: Column, pairs=EQUIVALENT) -> Column:
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def canonical_lines(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out`` for the text: the canonical forms of its lines that aren't empty.

    Lower case, without copyright lines, runs of punctuation and blanks as one space, equivalent spellings as one. Each
    step is a column of its own, so that what several parts of the next one need is computed once.
    """
    rest = [c for c in df.columns if c != text_col]
    d = df.select(*rest, F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER).alias(out))
    d = d.select(*rest, out, (F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("\u00a9")) | F.contains(out, F.lit("all rights reserved"))).alias("_noted"))
    d = d.select(*rest, F.regexp_replace(F.when(F.col("_noted"), F.regexp_replace(out, COPYRIGHT_LINE, "\n")).otherwise(F.col(out)), PUNCTUATION, " ").alias(out))
    lines = F.transform(F.split(_spelt(F.col(out)), "\n", -1), lambda x: F.trim(x))
    return d.select(*rest, F.filter(lines, lambda x: x != "").alias(out))


def canonical(lines: Column) -> Column:
    """The canonical form of the whole text: spellings of several words may stand on two lines."""
    return _spelt(F.array_join(lines, " "), [(a, b) for a, b in EQUIVALENT if " " in a])


def known_texts(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> dict[str, tuple[str, int]]:
    """The licence and the length of each known canonical text, by its digest; of one digest the least licence."""
    if len(known) + len(digests) > MAX_KNOWN:
        raise ValueError(f"{len(known) + len(digests)} known texts; more than {MAX_KNOWN} don't go to all tasks")
    rows = canonical_lines(spark.createDataFrame(list(known), "license string, text string"), "text", "lines").select("license", canonical(F.col("lines")).alias("t"))
    found = [(r["digest"], r["license"], r["n"]) for r in rows.select(F.sha2("t", 256).alias("digest"), "license", F.char_length("t").alias("n")).collect()]
    out: dict[str, tuple[str, int]] = {}
    for digest, license_, n in found + [(d, name, n) for name, n, d in digests]:
        out[digest] = min((license_, n), out.get(digest, (license_, n)))
    return out


def license_scan(df: DataFrame, known=KNOWN, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, text_digest, text_license (null: not known as a whole), line_licenses (distinct, sorted, comma-joined)."""
    table = known_texts(df.sparkSession, known, digests)
    names = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*[F.lit(name) for name, _ in table.values()]))
    d = canonical_lines(narrow(df, id_col, text_col), text_col, "_lines")
    short = F.filter("_lines", lambda x: F.char_length(x).isin(sorted({n for _, n in table.values()})))
    found = F.filter(F.transform(short, lambda x: F.element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    d = d.select(id_col, F.sha2(canonical(F.col("_lines")), 256).alias("text_digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("line_licenses"))
    rows = df.sparkSession.createDataFrame([(k, name) for k, (name, _) in table.items()], "text_digest string, text_license string")
    return d.join(F.broadcast(rows), "text_digest", "left").select(id_col, "text_digest", "text_license", "line_licenses")


def oracle_sql(known=KNOWN, digests=DIGESTS) -> str:
    """The same in DuckDB SQL, over a view named ``documents`` whose ids are distinct."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def base(c: str) -> str:
        t = f"translate(coalesce({c}, ''), {quote(UPPER)}, {quote(LOWER)})"
        return f"regexp_replace(regexp_replace({t}, {quote(COPYRIGHT_LINE)}, chr(10), 'g'), {quote(PUNCTUATION)}, ' ', 'g')"

    def tight(c: str) -> str:
        t = f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
        for a, b in EQUIVALENT:
            t = f"replace({t}, {quote(a)}, {quote(b)})"
        return t

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known)
    more = ", ".join(f"({quote(a)}, {quote(d)})" for a, _, d in digests)
    return f"""
WITH known(license, text) AS (VALUES {values}), more(license, digest) AS (VALUES {more}),
digests AS (SELECT digest, min(license) AS license FROM (SELECT sha256({tight(base("text"))}) AS digest, license FROM known UNION ALL SELECT digest, license FROM more) GROUP BY 1),
base AS (SELECT doc_id, {base("text")} AS b FROM documents),
lines AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line FROM base),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
  FROM (SELECT doc_id, sha256({tight("line")}) AS digest FROM lines) JOIN digests USING (digest) GROUP BY doc_id
)
SELECT base.doc_id, sha256({tight("b")}) AS text_digest, digests.license AS text_license, coalesce(line_licenses, '') AS line_licenses
FROM base LEFT JOIN digests ON digests.digest = sha256({tight("b")}) LEFT JOIN found ON found.doc_id = base.doc_id
"""
