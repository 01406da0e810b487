"""Licence scans by canonical digest lookup.

A text's canonical form drops copyright lines, folds case, punctuation and white space and unifies
equivalent spellings; its SHA-256 is hash-joined to the digests of known licence texts. Entire texts are
compared: ``scan`` looks up whole documents; ``scan_notices`` looks up every whole line, and every whole block of
lines between empty (or copyright) lines, as licence headers stand in files. All of it is built-in functions, so it stays in the JVM.

The known texts are ``KNOWN_TEXTS``, the digests of longer licences in ``license_digests``, and ``notices``; or tables of the
caller's, all rows of which are looked for. Spark joins them by a broadcast where their size is known to be
small, else by a shuffle of digests, in which it splits hot ones.

Defined cases: null text has the canonical form and digest of the empty text and matches nothing; a text of
copyright lines only likewise; repeated rows are looked up each, and rows of one id (or none) by their own text;
equal known texts under two names give the smaller name; texts of any length are digested whole; an empty table gives no rows;
further columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import KNOWN_DIGESTS

#: Words that count as equal, as regular expressions for Java and RE2 alike. Fixed values.
SPELLINGS = (
    (r"\blicence\b", "license"),
    (r"\blicences\b", "licenses"),
    (r"\blicenced\b", "licensed"),
    (r"\bsub ?licen[cs]e\b", "sublicense"),
    (r"\borganisation\b", "organization"),
    (r"\borganisations\b", "organizations"),
    (r"\bfavour\b", "favor"),
    (r"\backnowledgement\b", "acknowledgment"),
    (r"\backnowledgements\b", "acknowledgments"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bwhilst\b", "while"),
    (r"\bnon ?commercial\b", "noncommercial"),
    (r"\bcopyright owner\b", "copyright holder"),
    (r"\bhttps\b", "http"),
)
#: Parts of words that a text must hold for any of these to apply.
STEMS = ("licenc", "sub licens", "organis", "favour", "acknowledgement", "fulfil", "whilst", "non commercial", "copyright owner", "https")
#: A line that only states who holds the copyright. Fixed value.
COPYRIGHT = r"(^|\n)[^\n0-9A-Za-z]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt] (?:\([Cc]\)|©|[0-9])|\([Cc]\)|©|[Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd])[^\n]*"
#: Everything that is neither an ASCII letter or digit nor beyond ASCII, and the usual marks beyond it.
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{A9}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}]+"
#: The same but for line feeds.
MARKS_IN_LINES = MARKS.replace(r"[\x00-\x2F", r"[\x00-\x09\x0B-\x2F")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Licence texts and one-line notices that are known without a table of the caller's. Fixed values.
KNOWN_TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL),
)
KNOWN_NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    *((f"{k}-{i}{e}", f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{said}.")
      for what in ("program", "file", "library") for mark in (":", ";") for k, name, versions in (("GPL", "General Public License", (("2.0", "2"), ("3.0", "3"))), ("LGPL", "Lesser General Public License", (("2.1", "2.1"), ("3.0", "3")))) for i, v in versions
      for e, said in (("", f", version {v} of the License"), ("", f"; version {v} of the License"), ("-or-later", f", either version {v} of the License, or (at your option) any later version"), ("-or-later", f"; either version {v} of the License, or (at your option) any later version"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)

#: Licences by the names that notices use. Fixed values.
NAMES = (
    ("MIT", ("MIT License", "MIT")),
    ("ISC", ("ISC License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License")),
    *((f"GPL-{v}.0", (f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0", f"GNU GPL v{v}", f"GPLv{v}", f"GPL-{v}.0")) for v in (1, 2, 3)),
    *((f"LGPL-{v}", (f"GNU Lesser General Public License, version {v.removesuffix('.0')}", f"GNU Lesser General Public License v{v}", f"LGPLv{v.removesuffix('.0')}", f"LGPL-{v}")) for v in ("2.1", "3.0")),
    ("LGPL-2.0", ("GNU Library General Public License, version 2", "GNU Library General Public License v2.0", "LGPL-2.0")),
    *((f"GFDL-{v}", (f"GNU Free Documentation License, Version {v}", f"GFDL-{v}")) for v in ("1.2", "1.3")),
    *((f"MPL-{v}", (f"Mozilla Public License, Version {v}", f"Mozilla Public License {v}", f"MPL {v}")) for v in ("1.1", "2.0")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    *((f"CC-{k}-{v}", (f"CC {k} {v}", f"Creative Commons {n} {v} International License" if v == "4.0" else f"Creative Commons {n} {v} License")) for v in ("3.0", "4.0") for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
)
OPENINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under")


def more_notices() -> list[tuple[str, str]]:
    said = [(i, f"{o} {the}{n}.") for i, names in NAMES for n in names for o in OPENINGS for the in ("", "the ", "a ")]
    return said + [(i, f"SPDX-License-Identifier: {i}{e}") for i, _ in NAMES for e in (("", "-only", "-or-later") if i.startswith(("GPL", "LGPL", "GFDL")) else ("",))]


def notices() -> list[tuple[str, str]]:
    return [*KNOWN_NOTICES, *more_notices(), *((i, t) for i, t in KNOWN_TEXTS if "\n\n" not in t)]


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(x) for x in parts))


def _spelt(text: Column) -> Column:
    """Equivalent spellings made one; most texts hold none of them and are left alone."""
    t = text
    for pattern, word in SPELLINGS:
        t = F.regexp_replace(t, pattern, word)
    return F.when(_any(text, STEMS), t).otherwise(text)


def _folded(docs: DataFrame, text_col: str, marks: str, *kept: Column) -> DataFrame:
    """``kept`` and ``t``: the text in small letters, without copyright lines, runs of marks as one space.

    Each step is a projection of its own, so that none is made twice."""
    d = docs.select(*kept, F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("t"))
    names = d.columns[:-1]
    drop = F.when(_any(F.col("t"), ("copyright", "(c)", "©", "rights reserved")), F.regexp_replace("t", COPYRIGHT, "$1 ")).otherwise(F.col("t"))
    d = d.select(*names, drop.alias("t"))
    return d.select(*names, F.regexp_replace("t", marks, " ").alias("t"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """``kept`` and ``canonical``."""
    d = _folded(docs, text_col, MARKS, *kept)
    names = d.columns[:-1]
    return d.select(*names, F.trim("t").alias("t")).select(*names, _spelt(F.col("t")).alias("canonical"))


def digests(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """``kept`` and ``digest``."""
    d = canonical(docs, text_col, *kept)
    return d.select(*d.columns[:-1], _sha(F.col("canonical")).alias("digest"))


def known(spark: SparkSession, texts=KNOWN_TEXTS) -> DataFrame:
    return spark.createDataFrame(list(texts), "license_id string, text string")


#: Rows up to which a list of known texts (a digest and a name each) is broadcast.
SMALL = 100_000


def _known(known_texts: DataFrame) -> DataFrame:
    """canonical and license_id of texts that have both."""
    k = canonical(known_texts.where("license_id is not null"), "text", F.col("license_id"))
    return k.where("canonical <> ''")


def _table(known_texts: DataFrame, digests: tuple = ()) -> DataFrame:
    k = _known(known_texts).select(_sha(F.col("canonical")).alias("digest"), "license_id")
    if digests:
        k = k.unionByName(known_texts.sparkSession.createDataFrame(list(digests), "license_id string, digest string"))
    k = k.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(k) if known_texts.count() + len(digests) <= SMALL else k


def scan(docs: DataFrame, known_texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_digests: tuple = ()) -> DataFrame:
    """doc_id, key (a hash of the text), digest and license_id (null: none) of every whole text. known_digests: further (license_id, digest)."""
    d = digests(docs, text_col, F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"))
    return d.join(_table(known_texts, known_digests), "digest", "left").select("doc_id", "key", "digest", "license_id")


def scan_notices(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), line (from 0; of a block its first) and license_id of every whole line, and block of lines, that is known.

    Only what is as long as a known text can be equal to one, so nothing else is digested."""
    size = _known(notices).agg(F.coalesce(F.min(F.length("canonical")), F.lit(1)).alias("least"), F.coalesce(F.max(F.length("canonical")), F.lit(0)).alias("most")).first()
    fits = lambda x: F.length(x).between(size["least"], size["most"])
    d = _folded(docs, text_col, MARKS_IN_LINES, F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"))
    d = d.select("doc_id", "key", _spelt(F.regexp_replace(F.trim("t"), " ?\n ?", "\n")).alias("t")).select("doc_id", "key", "t", F.split("t", "\n").alias("lines"))
    single = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("said"))), lambda x: fits(x["said"]))
    # a block: from a line after an empty one (or none) to the next line before an empty one (or none)
    full = lambda i: F.coalesce(F.get("lines", i) != "", F.lit(False))
    ends = lambda step: F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: full(i) & ~full(i + step) & full(i - step))
    block = F.transform(F.arrays_zip(ends(-1).alias("a"), ends(1).alias("z")), lambda x: F.struct(x["a"].alias("line"), F.array_join(F.slice("lines", x["a"] + 1, x["z"] - x["a"] + 1), " ").alias("said")))
    # spellings across lines change a block's length by one a line at most
    near = F.filter(block, lambda x: F.length(x["said"]).between(size["least"] - F.size("lines"), size["most"] + F.size("lines")))
    block = F.when(F.size("lines") > 1, near).otherwise(F.array().cast("array<struct<line:int,said:string>>"))
    every = d.select("doc_id", "key", F.explode(F.concat(single, block)).alias("x")).select("doc_id", "key", "x.line", _spelt(F.col("x.said")).alias("said")).where(fits(F.col("said")))
    return every.select("doc_id", "key", "line", _sha(F.col("said")).alias("digest")).join(_table(notices), "digest").select("doc_id", "key", "line", "license_id")


def licenses(docs: DataFrame, known_texts: DataFrame | None = None, known_notices: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text) and notices (names from its lines and blocks, by ';') a row."""
    spark = docs.sparkSession
    whole = scan(docs, known_texts if known_texts is not None else known(spark), known_digests=KNOWN_DIGESTS if known_texts is None else ())
    lines = scan_notices(docs, known_notices if known_notices is not None else known(spark, notices()))
    found = lines.groupBy("doc_id", "key").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ";").alias("notices"))
    same = [F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("w.key") == F.col("f.key")]
    return whole.alias("w").join(found.alias("f"), same, "left").select("w.doc_id", "digest", "license_id", "notices")


def oracle() -> str:
    """The same lookup as SQL, line by line."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spelt(t: str) -> str:
        for pattern, word in SPELLINGS:
            t = f"regexp_replace({t}, {quote(pattern)}, '{word}', 'g')"
        return t

    def line(col: str) -> str:
        t = f"regexp_replace({col}, {quote(COPYRIGHT)}, '', 'g')"
        return f"trim(regexp_replace(translate({t}, '{UPPER}', '{LOWER}'), {quote(MARKS)}, ' ', 'g'), ' ')"

    lines = lambda t: f"list_transform(string_split(coalesce({t}, ''), chr(10)), lambda x: {line('x')})"
    whole = lambda ls: f"sha256({spelt(f"array_to_string(list_filter({ls}, lambda x: x <> ''), ' ')")})"
    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""
WITH k AS (SELECT * FROM (VALUES {values(KNOWN_TEXTS)}) v(id, text)),
t AS (SELECT digest, min(id) AS license_id FROM (SELECT id, {whole(lines('text'))} AS digest FROM k UNION ALL SELECT * FROM (VALUES {values(KNOWN_DIGESTS)}) v(id, digest)) GROUP BY 1),
n AS (SELECT {whole(lines('text'))} AS digest, min(id) AS license_id FROM (VALUES {values(notices())}) v(id, text) GROUP BY 1),
p AS (SELECT doc_id, {lines('text')} AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS said FROM p),
b AS (SELECT doc_id, replace(trim(u, chr(10)), chr(10), ' ') AS said FROM (SELECT doc_id, unnest(string_split_regex(array_to_string(ls, chr(10)), '\n\n+')) AS u FROM p) WHERE contains(trim(u, chr(10)), chr(10))),
f AS (SELECT doc_id, string_agg(DISTINCT license_id, ';' ORDER BY license_id) AS notices
      FROM (SELECT doc_id, sha256({spelt('said')}) AS digest FROM l WHERE said <> '' UNION ALL SELECT doc_id, sha256({spelt('said')}) FROM b) x JOIN n USING (digest) GROUP BY doc_id),
d AS (SELECT doc_id, {whole('ls')} AS digest FROM p)
SELECT d.doc_id, d.digest, t.license_id, f.notices FROM d LEFT JOIN t USING (digest) LEFT JOIN f USING (doc_id)
"""
