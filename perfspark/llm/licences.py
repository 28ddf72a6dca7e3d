"""Licence scan by canonical digests.

A text is brought to a canonical form: letters in lower case, punctuation and
white space as one space, copyright lines dropped, equivalent spellings made
one.  The digest of that form is looked up among the digests of known licences,
once for the whole text and once for each of its lines, so that both a licence
text and a notice inside a document are found.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfspark.llm.common import ascii_lower, whole_text
from perfspark.runtime import lookup, materialize

#: Everything but letters, digits and line ends, ASCII and typographic.
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\xBF\\x{2000}-\\x{206F}\\x{3000}-\\x{3003}]+"
#: Words after which "copyright" at the start of a line goes on with a sentence that was wrapped there.
CONTINUES = frozenset("""act also and are as assignment attribution belongs claim claims disclaimer disclaimers doctrine doctrines
file for header holder holders if in information infringement interest interests is law laws license licensed licenses like
line lines management material materials notice notices of on or owned owner owners ownership patent patents permission
permissions protection protections related remains resides resulting right rights statement statements status terms that
those to trademark trademarks treaties treaty under which with""".split())
#: What "copyright the" names without claiming it; "copyright the Regents" is a claim.
NAMED = frozenset("library program software work".split())


def _unlike(words: set[str] | frozenset[str]) -> str:
    """Pattern of a rest of a word that is none of ``words``, without looking
    ahead, which not every engine can."""
    heads = sorted({w[0] for w in words if w})
    rest = [f"[^ {''.join(heads)}][^ ]*", *(h + _unlike({w[1:] for w in words if w[:1] == h}) for h in heads)]
    return f"(?:{'|'.join(rest + [''] * ('' not in words))})"


#: A canonical line that only claims rights: the word and then a sign, year or holder; a sign and a year; or the formula.
CLAIM = f"^((c )?copyright ({_unlike(CONTINUES | {'', 'the'})}|the {_unlike(NAMED | {''})})|c [0-9][0-9][0-9][0-9]|all rights reserved)( |$)"
#: Spellings that mean the same, left to right, applied in order.
SPELLINGS = (("licenc", "licens"), ("https", "http"), ("noncommercial", "non commercial"), ("favour", "favor"))
Z_SPELLING = ("(organ|author|recogn|util)is(e|ing|ation)", "iz")

# Texts of public licences and the notices that refer to them.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_SHORT = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

""" + _WARRANTY),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

""" + _AUTHOR),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

""" + _AUTHOR),
)
_NOTICES = (
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", "ISC License"),
)
#: Titles that stand over a text without one of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "The BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Files of ``licence_texts``: the licence, and the lines of its own title.
FILES = (
    ("Apache-2.0", "Apache-2.0", 3), ("CC0-1.0", "CC0-1.0", 2), ("GPL-1", "GPL-1.0", 2), ("GPL-2", "GPL-2.0", 2),
    ("GPL-3", "GPL-3.0", 2), ("LGPL-2", "LGPL-2.0", 2), ("LGPL-2.1", "LGPL-2.1", 2), ("LGPL-3", "LGPL-3.0", 2),
    ("MPL-1.1", "MPL-1.1", 2), ("MPL-2.0", "MPL-2.0", 1), ("GFDL-1.2", "GFDL-1.2", 2), ("GFDL-1.3", "GFDL-1.3", 2),
    ("Artistic", "Artistic-1.0-Perl", 1), ("BSL-1.0", "BSL-1.0", 1), ("Unlicense", "Unlicense", 0), ("Zlib", "Zlib", 0),
    ("BSD-2-Clause", "BSD-2-Clause", 0), ("BSD-3-Clause-UC", "BSD-3-Clause", 0),
)
#: What follows explains how to apply the licence and is often left out.
TERMS_END = "END OF TERMS AND CONDITIONS"
_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

"""


def _bsd(two: str) -> list[tuple[str, str]]:
    """Both clauses counts, with numbers and bullets, and the two usual names
    of those who disclaim."""
    at = two.index("THIS SOFTWARE IS PROVIDED")
    out = []
    for licence, text in (("BSD-2-Clause", two), ("BSD-3-Clause", two[:at] + _NAMES + two[at:])):
        one = text.replace("COPYRIGHT HOLDERS AND", "COPYRIGHT HOLDER AND")
        older = re.sub(r"COPYRIGHT\s+HOLDER\s+OR", "COPYRIGHT OWNER OR", text)
        for form in (text, one, older):
            out += [(licence, form), (licence, re.sub(r"(?m)^\s*[0-9]\. ", "* ", form))]
    return out


def _known() -> tuple[tuple[str, str], ...]:
    """Every text with and without its title, and with and without what
    follows its terms; then the notices."""
    texts = list(_SHORT)
    for file, licence, titled in FILES:
        text = resources.files(__package__).joinpath("licence_texts", file).read_text("utf-8")
        forms = _bsd(text) if file == "BSD-2-Clause" else [(licence, text)]
        if titled:
            forms.append((licence, re.sub(rf"\A(?:[^\n]*[^\W_][^\n]*\n\W*){{{titled}}}", "", text)))
        for _, form in list(forms):
            if TERMS_END in form:
                forms.append((licence, form[:form.index(TERMS_END) + len(TERMS_END)]))
        texts += forms
    return (*texts, *((n, f"{title}\n\n{text}") for n, text in texts for title in TITLES.get(n, ())), *_NOTICES)


KNOWN = _known()


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty ones and claims."""
    form = F.replace(ascii_lower(text), F.lit("©"), F.lit("copyright "))
    form = F.regexp_replace(form, PUNCTUATION, " ")
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    form = F.regexp_replace(form, Z_SPELLING[0], f"$1{Z_SPELLING[1]}$2")
    lines = F.transform(F.split(form, "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(CLAIM))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "licence string, text string")


def digests(licences: DataFrame, licence: str = "licence", text: str = "text") -> DataFrame:
    """digest, licence: one row per canonical text; of several names the least.
    Texts without any canonical line are no licence."""
    lines = canonical_lines(whole_text(text))
    return licences.select(F.col(licence).alias("licence"), lines.alias("lines")).where(F.size("lines") > 0).select(
        F.sha2(F.array_join("lines", " "), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest of the whole canonical text,
    licence (null unless the whole text is one), notices (licences of its lines,
    sorted), n_notices (lines that are one, repeats included).

    Null is the empty text, whose digest is that of no lines and whose licence
    is null.  Repeated rows each give a row.
    """
    table = lookup(digests(licences))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                       canonical_lines(whole_text(text)).alias("lines"))
    # a line is looked up by its digest; only digests leave the scan
    hashed = materialize(read.select(
        "row", "id", F.sha2(F.array_join("lines", " "), 256).alias("digest"),
        F.transform("lines", lambda line: F.sha2(line, 256)).alias("lines")))
    lines = hashed.select("row", F.explode("lines").alias("digest")).join(table, "digest")
    found = lines.groupBy("row").agg(F.sort_array(F.collect_set("licence")).alias("notices"), F.count("*").alias("n_notices"))
    whole = hashed.select("row", "id", "digest").join(table, "digest", "left")
    return whole.join(found, "row", "left").select(
        "id", "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
