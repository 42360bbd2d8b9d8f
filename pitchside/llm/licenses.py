"""Licence scans by sentence rules, in DataFrame functions only.

A text is split into sentences at full stops, colons, semicolons and blank lines; marks of comments at
the start of lines are dropped and single line breaks join. A sentence is normalised (lower case, other
characters than letters and digits as one blank) and mapped to an identifier: it is a known licence
sentence, fits one of PATTERNS, or is a notice (NOTICE, SPDX, TITLE) around a known name. Where a
sentence runs over other lines (a title above, a heading below), the longest runs of its lines that
are known count. The identifiers found, in order, are matched against ordered rules: a rule holds where
its identifiers stand one after the other, and leaves a gap in their place before the next rule is
tried. All of it is one projection: no shuffle, whatever the skew.

A null or empty text has no sentences, no identifiers and no licences. Every row gives one row,
repeated rows and null ids too; only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import table

#: Licences by their SPDX identifier, and the names that notices and titles use for them.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit license mit", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache license version 2 0 january 2004", "apache software license 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license version 2 june 1991", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl 2 0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license version 3 29 june 2007", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl 3 0", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1 february 1999", "gnu lgpl version 2 1", "lgpl 2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007", "gnu lgpl version 3", "lgpl 3 0", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007", "gnu agpl version 3", "agpl 3 0", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license"],
    "ISC": ["isc license"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero v1 0 universal license", "cc0 1 0 universal license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license version 1 0 august 17th 2003", "boost software license"],
    "EPL-1.0": ["eclipse public license v1 0", "eclipse public license 1 0", "eclipse public license v 1 0", "eclipse public license version 1 0"],
    "EPL-2.0": ["eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"],
    "0BSD": ["zero clause bsd license", "bsd zero clause license", "0bsd license"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "EUPL-1.2": ["european union public licence v 1 2", "european union public licence version 1 2", "european union public license 1 2", "european union public licence 1 2", "eupl version 1 2"],
    "PostgreSQL": ["postgresql license", "postgresql licence"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
}
#: Sentences of licence texts, normalised.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
}
#: Sentences with a name or an address in them.
PATTERNS = [
    ("isc-grant", r"^permission to use copy modify (and )?(or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies$"),
    ("isc-as-is", r"^the software is provided as is and .{1,80} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness$"),
    ("bsd-names", r"^neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("bsd-as-is", r"^this software is provided by .{1,80} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$"),
    ("mpl-copy", r"^if a copy of the mpl was not distributed with this file you can obtain one at .{1,80}$"),
    ("gpl-copy", r"^you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library|software)$"),
]
#: Families of the public licence that one text serves: the word in its name, and versions as texts write them.
FAMILIES = {"GPL": ("", {"2": "2.0", "3": "3.0"}), "LGPL": ("lesser ", {"2 1": "2.1", "3": "3.0"}), "AGPL": ("affero ", {"3": "3.0"})}
_TERMS = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
#: Notices around a name, or several joined by or, and, with; then notices with a clause after the name.
_UNDER = (
    r"^(?:(?:the|this|these|all|our|its) (?:[a-z0-9]+ ){1,6}(?:is|are) )?(?:dual |multi |triple )?"
    r"(?:licensed|released|distributed|available|published|provided|covered|made available) under (?:the )?(?:terms of |terms and conditions of )?(?:the |a |an )?(?:either )?(?:the )?"
)
NOTICE = _UNDER + r"(.+?)(?: the license)?$"
CLAUSE = _UNDER + r"(.+?) (?:by|see|which|as) .+$"
SPDX = r"^(?:.{0,20} )?spdx license identifier (.+)$"
FIELD = r"^(?:project |package |code )?licen[cs]e (.+)$"
TITLE = r"^(?:the )?(.*licen[cs]e.*)$"
FORMS = (SPDX, NOTICE, CLAUSE, FIELD, TITLE)
#: What makes a name one of later versions, or says nothing; and what joins names.
LATER, ONLY, JOINT = r" (?:or (?:any )?(?:later|newer)(?: version)?)( |$)", r" only( |$)", " or | and | with "
#: Licences of more than one sentence or of a sentence of their own, first rule first; then notices.
TEXT_RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-use"]),
    ("Apache-2.0", ["apache-use", "apache-as-is"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("MPL-2.0", ["mpl-form"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
]
#: A text or sentence without one of these (blanks stand for anything but letters and digits) holds nothing known.
CUES = ["licen", "gpl", "spdx", "cc by", "cc0", "mpl", "permission", "redistribut", "software", "copyright", "without any warranty"]
CUE = "|".join(CUES).replace(" ", "[^a-z0-9]+")
#: Marks of comments at the start of a line, by classes of single characters that are never given back: a
#: repeated group would need a stack as deep as the line is long. (HELD is for a SQL whose patterns need none.)
_SIGNS = r"[\x20\x09/*#;%<>!-]*"
HELD = rf"(^|\n){_SIGNS}(?:(?:rem|dnl)[\x20\x09]{_SIGNS})?"
MARK = HELD.replace(_SIGNS, _SIGNS + "+")
#: Stops that end no sentence.
STOPS = r"(\bv)\.[\x20\x09]+|(identifier|licen[cs]e):"
#: Where a sentence ends.
END = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09\x0D]*\n"


def known_names() -> dict[str, str]:
    """Name, normalised, and licence."""
    out = {spdx.lower().replace("-", " ").replace(".", " "): spdx for spdx in NAMES}
    return out | {name: spdx for spdx, names in NAMES.items() for name in names}


def known_sentences() -> dict[str, str]:
    """Normalised sentence and its identifier, notices left out."""
    out = {text: i for i, text in SENTENCES.items()}
    for family, (word, versions) in FAMILIES.items():
        terms = _TERMS.format(word)
        out[terms] = f"terms:{family}"
        for text, v in versions.items():
            later = f"version {text} of the license or at your option any later version"
            out[f"{terms} either {later}"] = out[f"{terms} {later}"] = f"later:{family}-{v}"
            out[f"{terms} version {text} of the license"] = f"name:{family}-{v}"
            out[f"either {later}"] = out[later] = f"either:{v}"
            out[f"version {text} of the license"] = f"version:{v}"
    return out


def rules() -> list[tuple[str, str]]:
    """Licence and the identifiers in a row, as they stand in the list of a text's identifiers."""
    listed = [*TEXT_RULES]
    for family, (_, versions) in FAMILIES.items():
        for v in versions.values():
            listed += [(f"{family}-{v}-or-later", [f"terms:{family}", f"either:{v}"]), (f"{family}-{v}", [f"terms:{family}", f"version:{v}"])]
    listed += [(f"{spdx}-or-later", [f"later:{spdx}"]) for spdx in NAMES if "GPL" in spdx]
    listed += [(spdx, [f"name:{spdx}"]) for spdx in NAMES]
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in listed]


def most_lines() -> int:
    """Words, and so lines, of the longest sentence that is known: .{1,80} is 40 words at most, a clause after a
    name or an exception counts up to that too."""
    texts = [*known_sentences(), *[re.sub(r"[^a-z0-9 ]", "", p) + " x" * 40 * p.count("{1,80}") for _, p in PATTERNS]]
    return max(*(len(t.split()) for t in texts), 80)


#: Lines that are enough to tell whether a known sentence begins: subject, notice and the first word of a name.
BEGINNING = 24


def starts() -> str:
    """A pattern of how all that is known begins: three words (or all) of sentences and names; notices up to the
    first word of a name."""
    texts = [*known_sentences(), *known_names(), *["the " + n for n in known_names()], *[re.split(r" [^a-z0-9 ]", p.lstrip("^"))[0] for _, p in PATTERNS]]
    words = {" ".join(t.split()[:3]) for t in texts}
    names = "|".join(sorted({n.split()[0] for n in known_names()}))
    return rf"^(?:[0-9]{{1,2}} )?(?:(?:{'|'.join(sorted(words))})(?: |$)|(?:{_UNDER[1:]}|(?:project |package |code )?licen[cs]e )(?:{names})(?: |$)|(?:.{{0,20}} )?spdx license identifier )"


def _literal_map(entries: dict[str, str]) -> Column:
    """A map as one constant (keys and values are words, so = and ; are free)."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in sorted(entries.items()))), F.lit(";"), F.lit("="))


def _identifier(s: Column) -> Column:
    """The identifier of a normalised sentence, or null; of a notice of several names all of theirs, joined by +."""
    names, known = _literal_map(known_names()), _literal_map(known_sentences())
    out = known[s]
    for i, pattern in PATTERNS:
        out = F.coalesce(out, F.when(s.rlike(pattern), F.lit(i)))

    def named(part: Column) -> Column:
        return F.transform(F.array(names[F.rtrim(part, F.lit("~"))]), lambda n: F.concat(F.when(F.endswith(part, F.lit("~")) & n.contains("GPL"), F.lit("later:")).otherwise(F.lit("name:")), n))[0]

    def of(text: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(text, LATER, "~$1"), ONLY, "$1")
        return F.array_join(F.filter(F.transform(F.split(text, JOINT, -1), named), lambda x: x.isNotNull()), "+")

    notice = F.filter(F.transform(F.array(*[F.regexp_extract(s, f, 1) for f in FORMS]), of), lambda x: x != "")
    return F.coalesce(out, F.try_element_at(notice, F.lit(1)))


def _identifiers(clean: Column) -> Column:
    """Identifiers of the known sentences, in order: runs of a sentence's lines that together make one."""
    once = lambda x, f: F.transform(F.array(x), f)[0]
    start, most = starts(), most_lines()

    def hits(sentence: Column) -> Column:
        lines = F.transform(F.split(sentence, "\n", -1), lambda u: F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")))
        return once(F.filter(lines, lambda u: u != ""), lambda u: once(runs(u), apart))

    def runs(lines: Column) -> Column:
        """The longest known run from each line that can begin one."""

        def longest(i: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size(lines) - i + 1))
            text = lambda k: F.regexp_replace(F.array_join(F.slice(lines, i, k), " "), "^[0-9]{1,2} ", "")
            found = F.transform(sizes, lambda k: F.struct(i.alias("i"), k.alias("k"), once(text(k), _identifier).alias("id")))
            return F.try_element_at(F.filter(found, lambda e: e["id"].isNotNull()), F.lit(-1))

        begins = lambda i: F.array_join(F.slice(lines, F.greatest(i, F.lit(1)), F.lit(BEGINNING)), " ").rlike(start)
        places = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: (i > 0) & begins(i))
        return F.filter(F.transform(places, longest), lambda h: h.isNotNull())

    def apart(found: Column) -> Column:
        inside = lambda h: F.exists(found, lambda g: (g["i"] < h["i"]) & (g["i"] + g["k"] > h["i"]))
        return F.flatten(F.transform(F.filter(found, lambda h: ~inside(h)), lambda h: F.split(h["id"], r"\+", -1)))

    sentences = F.filter(F.split(clean, END, -1), lambda r: r.rlike(CUE))
    return F.flatten(F.transform(sentences, hits))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (licence sentences), sentence_ids and licenses, each joined by commas."""
    state = F.struct(F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")).alias("left"), F.array().cast("array<string>").alias("got"))
    ordered = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in rules()])

    def step(s: Column, rule: Column) -> Column:
        there = s["left"].contains(rule["pattern"])
        return F.struct(
            F.when(there, F.replace(s["left"], rule["pattern"], F.lit("|"))).otherwise(s["left"]).alias("left"),
            F.when(there, F.array_union(s["got"], F.array(rule["name"]))).otherwise(s["got"]).alias("got"),
        )

    found = F.when(F.size("ids") > 0, F.aggregate(ordered, state, step, lambda s: F.array_join(s["got"], ",")))
    clean = F.regexp_replace(F.regexp_replace("low", MARK, "$1"), STOPS, "$1$2 ")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
        .select("doc_id", F.when(F.col("low").rlike(CUE), clean).alias("clean"))
        .select("doc_id", F.when(F.col("clean").isNotNull(), _identifiers(F.col("clean"))).otherwise(F.array().cast("array<string>")).alias("ids"))
        .select(
            "doc_id",
            F.size("ids").cast("long").alias("n_known"),
            F.array_join("ids", ",").alias("sentence_ids"),
            F.coalesce(found, F.lit("")).alias("licenses"),
        )
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda d: ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in sorted(d.items()))
    steps, last = [], "found"
    for n, (name, pattern) in enumerate(rules()):
        there = f"contains(gone, {quoted(pattern)})"
        steps.append(
            f"r{n} AS (SELECT rid, ids, CASE WHEN {there} THEN replace(gone, {quoted(pattern)}, '|') ELSE gone END AS gone, "
            f"CASE WHEN {there} AND NOT list_contains(got, {quoted(name)}) THEN list_append(got, {quoted(name)}) ELSE got END AS got FROM {last})"
        )
        last = f"r{n}"
    fits = " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN {quoted(i)}" for i, p in PATTERNS)
    parts = lambda p: f"regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(t, {quoted(p)}, 1), {quoted(LATER)}, '~\\1', 'g'), {quoted(ONLY)}, '\\1', 'g'), {quoted(JOINT)})"
    named = lambda p: f"nullif(array_to_string(list_filter(list_transform({parts(p)}, lambda x: CASE WHEN x LIKE '%~' AND contains(spdx[rtrim(x, '~')], 'GPL') THEN 'later:' ELSE 'name:' END || spdx[rtrim(x, '~')]), lambda x: x IS NOT NULL), '+'), '')"
    return f"""
WITH known(sentence, id) AS (VALUES {values(known_sentences())}),
names(name, spdx) AS (VALUES {values(known_names())}),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS low FROM documents),
cleaned AS (SELECT rid, regexp_replace(regexp_replace(low, {quoted(HELD)}, '\\1', 'g'), {quoted(STOPS)}, '\\1\\2 ', 'g') AS clean FROM numbered WHERE regexp_matches(low, {quoted(CUE)})),
split AS (SELECT rid, regexp_split_to_array(clean, {quoted(END)}) AS parts FROM cleaned),
sentences AS (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS sn FROM split),
lined AS (
  SELECT rid, sn, list_filter(list_transform(string_split(part, chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM sentences WHERE regexp_matches(part, {quoted(CUE)})),
begun AS (SELECT rid, sn, lines, unnest(range(1, len(lines) + 1)) AS i FROM lined),
runs AS (SELECT rid, sn, i, lines, unnest(range(1, least({most_lines()}, len(lines) - i + 1) + 1)) AS k FROM begun WHERE regexp_matches(array_to_string(lines[i:i + {BEGINNING - 1}], ' '), {quoted(starts())})),
texts AS (SELECT rid, sn, i, k, regexp_replace(array_to_string(lines[i:i + k - 1], ' '), '^[0-9]{{1,2}} ', '') AS t FROM runs),
spdx_names AS (SELECT map(list(name), list(spdx)) AS spdx FROM names),
hits AS (
  SELECT rid, sn, i, k, coalesce(known.id, CASE {fits} END, {", ".join(named(p) for p in FORMS)}) AS id
  FROM texts CROSS JOIN spdx_names LEFT JOIN known ON t = known.sentence),
longest AS (SELECT rid, sn, i, max(k) AS k, arg_max(id, k) AS id FROM hits WHERE id IS NOT NULL GROUP BY rid, sn, i),
apart AS (SELECT * FROM longest x WHERE NOT EXISTS (SELECT 1 FROM longest g WHERE g.rid = x.rid AND g.sn = x.sn AND g.i < x.i AND g.i + g.k > x.i)),
listed AS (SELECT rid, flatten(list(string_split(id, '+') ORDER BY sn, i)) AS ids FROM apart GROUP BY rid),
found AS (SELECT rid, ids, '<' || array_to_string(ids, '><') || '>' AS gone, CAST([] AS VARCHAR[]) AS got FROM listed),
{", ".join(steps)}
SELECT d.doc_id, coalesce(len(r.ids), 0)::BIGINT AS n_known,
       coalesce(array_to_string(r.ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(r.got, ','), '') AS licenses
FROM numbered d LEFT JOIN {last} r ON d.rid = r.rid
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_rules": op6}
SQL = {"op6_license_rules": _sql()}
