"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised to lower-case ASCII letters and digits with single spaces. Known
sentences have identifiers; a name in them (of a holder, a program) may be any of up to NAMES words, and a list mark may stand before them. A line
break ends a sentence, yet following lines that make a known sentence when joined, the longest first, are that sentence: licence texts are often
wrapped, or stand behind comment marks. A document's identifiers, in order, with a bar where more than GAP other
sentences stand between two, are matched against the rules in their order: longer sequences first, and what a rule matched is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import let

#: Ends of sentences; the first of them also ends what lines may be joined.
STOP = r"[.!?;]+[\x20\x09-\x0D]+"
#: A comment mark that looks like one.
MARK = r"\n[\x20\x09]*;+([\x20\x09-\x0D])"
#: Other sentences that may stand between two of one licence.
GAP = 2
#: Words of a name.
NAMES = 10
_FREE = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation either version {} of the license or at your option any later version"
_ONLY = "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal {} the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_FEE = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
#: Licences that an SPDX line may name.
SPDX = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-1.0 EPL-2.0 CC0-1.0 Unlicense BSL-1.0 Zlib Artistic-2.0 WTFPL CDDL-1.0 EUPL-1.2 OFL-1.1 PostgreSQL NCSA Python-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0"
).split()
#: Normalised sentences of public licences and notices by identifier; * is a name.
SENTENCES = {
    "mit-grant": _GRANT.format("in") + " subject to the following conditions",
    "mit0-grant": _GRANT.format("in"),
    "ncsa-grant": _GRANT.format("with") + " subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "isc-grant": _FEE + " provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": _FEE,
    "isc-warranty": "the software is provided as is and * all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement *",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-defined": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "gpl-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl3-program": "this program is free software " + _FREE.format("", 3).replace("  ", " "),
    "gpl3-named": "* is free software " + _FREE.format("", 3).replace("  ", " "),
    "gpl2-named": "* is free software " + _FREE.format("", 2).replace("  ", " "),
    "gpl2-program": "this program is free software " + _FREE.format("", 2).replace("  ", " "),
    "gpl2-only-program": "this program is free software " + _ONLY,
    "free-program": "this program is free software",
    "free-named": "* is free software",
    "gpl3-terms": _FREE.format("", 3).replace("  ", " "),
    "gpl2-terms": _FREE.format("", 2).replace("  ", " "),
    "gpl2-only-terms": _ONLY,
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-library": "this library is free software " + _FREE.format("lesser", "2 1"),
    "lgpl3-library": "this library is free software " + _FREE.format("lesser", 3),
    "free-library": "this library is free software",
    "lgpl21-terms": _FREE.format("lesser", "2 1"),
    "lgpl3-terms": _FREE.format("lesser", 3),
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "agpl3-program": "this program is free software " + _FREE.format("affero", 3),
    "agpl3-terms": _FREE.format("affero", 3),
    "mpl2-title": "mozilla public license version 2 0",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-plain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-title": "eclipse public license v 1 0",
    "epl2-title": "eclipse public license v 2 0",
    "cc0-title": "cc0 1 0 universal",
    "cc0-dedicated": "to the extent possible under law * all copyright and related and neighboring rights to *",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-licensed": "distributed under the boost software license version 1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "artistic2-title": "the artistic license 2 0",
    "wtfpl-title": "do what the fuck you want to public license",
    "cddl1-title": "common development and distribution license cddl version 1 0",
    "eupl12-title": "european union public licence v 1 2",
    "ofl11-licensed": "this font software is licensed under the sil open font license version 1 1",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "python2-title": "python software foundation license version 2",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd": "licensed under cc by nc nd 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
}
SENTENCES |= {f"spdx-{n}": "spdx license identifier " + n.lower().replace("-", " ").replace(".", " ") for n in SPDX}
#: Rules in their order, a sequence of sentences and the licence that it states.
RULES = [
    ("mit-grant mit-notice mit-warranty mit-liability", "MIT"), ("mit-grant mit-notice mit-warranty", "MIT"),
    ("bsd-use bsd-source bsd-binary bsd-advertising bsd-endorse bsd-warranty", "BSD-4-Clause"), ("bsd-use bsd-source bsd-binary bsd-endorse bsd-warranty", "BSD-3-Clause"), ("ncsa-grant bsd-source bsd-binary bsd-endorse", "NCSA"),
    ("bsd-use bsd-source bsd-binary bsd-advertising", "BSD-4-Clause"), ("bsd-use bsd-source bsd-binary bsd-endorse", "BSD-3-Clause"), ("bsd-use bsd-source bsd-binary bsd-warranty", "BSD-2-Clause"), ("bsd-use bsd-source bsd-binary", "BSD-2-Clause"),
    ("apache-defined apache-comply apache-copy", "Apache-2.0"), ("apache-licensed apache-comply apache-copy", "Apache-2.0"),
    ("free-program gpl3-terms gpl-hope", "GPL-3.0-or-later"), ("free-named gpl3-terms", "GPL-3.0-or-later"), ("free-program gpl2-terms gpl-hope", "GPL-2.0-or-later"), ("free-named gpl2-terms", "GPL-2.0-or-later"), ("free-program gpl2-only-terms gpl-hope", "GPL-2.0-only"),
    ("free-program agpl3-terms gpl-hope", "AGPL-3.0-or-later"), ("free-library lgpl21-terms lgpl-hope", "LGPL-2.1-or-later"), ("free-library lgpl3-terms lgpl-hope", "LGPL-3.0-or-later"),
    ("gpl3-program gpl-hope", "GPL-3.0-or-later"), ("gpl2-program gpl-hope", "GPL-2.0-or-later"), ("gpl2-only-program gpl-hope", "GPL-2.0-only"), ("agpl3-program gpl-hope", "AGPL-3.0-or-later"), ("lgpl21-library lgpl-hope", "LGPL-2.1-or-later"), ("lgpl3-library lgpl-hope", "LGPL-3.0-or-later"),
    ("free-program gpl3-terms", "GPL-3.0-or-later"), ("free-program gpl2-terms", "GPL-2.0-or-later"), ("free-program gpl2-only-terms", "GPL-2.0-only"), ("free-program agpl3-terms", "AGPL-3.0-or-later"), ("free-library lgpl21-terms", "LGPL-2.1-or-later"), ("free-library lgpl3-terms", "LGPL-3.0-or-later"),
    ("isc-grant isc-warranty", "ISC"), ("0bsd-grant isc-warranty", "0BSD"), ("mit0-grant mit-warranty", "MIT-0"), ("mit-grant mit-notice", "MIT"), ("mpl2-form mpl2-copy", "MPL-2.0"), ("mpl2-form mpl2-copy-plain", "MPL-2.0"), ("zlib-warranty zlib-grant", "Zlib"),
    ("gpl3-program", "GPL-3.0-or-later"), ("gpl3-named", "GPL-3.0-or-later"), ("gpl2-named", "GPL-2.0-or-later"), ("gpl2-program", "GPL-2.0-or-later"), ("gpl2-only-program", "GPL-2.0-only"), ("gpl3-terms", "GPL-3.0-or-later"), ("gpl2-terms", "GPL-2.0-or-later"), ("gpl2-only-terms", "GPL-2.0-only"),
    ("agpl3-program", "AGPL-3.0-or-later"), ("agpl3-terms", "AGPL-3.0-or-later"), ("lgpl21-library", "LGPL-2.1-or-later"), ("lgpl3-library", "LGPL-3.0-or-later"), ("lgpl21-terms", "LGPL-2.1-or-later"), ("lgpl3-terms", "LGPL-3.0-or-later"),
    ("mit-grant", "MIT"), ("mit0-grant", "MIT-0"), ("ncsa-grant", "NCSA"), ("mit-released", "MIT"), ("mit-licensed", "MIT"), ("isc-grant", "ISC"), ("0bsd-grant", "0BSD"), ("apache-licensed", "Apache-2.0"), ("apache-defined", "Apache-2.0"), ("apache-title", "Apache-2.0"),
    ("gpl-work", "GPL-3.0"), ("gpl2-title", "GPL-2.0"), ("gpl3-title", "GPL-3.0"), ("lgpl21-title", "LGPL-2.1"), ("lgpl3-title", "LGPL-3.0"), ("agpl3-title", "AGPL-3.0"), ("mpl2-form", "MPL-2.0"), ("mpl2-title", "MPL-2.0"),
    ("epl1-terms", "EPL-1.0"), ("epl2-terms", "EPL-2.0"), ("epl1-title", "EPL-1.0"), ("epl2-title", "EPL-2.0"), ("cc0-title", "CC0-1.0"), ("cc0-dedicated", "CC0-1.0"), ("unlicense-free", "Unlicense"), ("boost-title", "BSL-1.0"), ("boost-licensed", "BSL-1.0"), ("zlib-grant", "Zlib"),
    ("artistic2-title", "Artistic-2.0"), ("wtfpl-title", "WTFPL"), ("cddl1-title", "CDDL-1.0"), ("eupl12-title", "EUPL-1.2"), ("ofl11-licensed", "OFL-1.1"), ("postgresql-grant", "PostgreSQL"), ("python2-title", "Python-2.0"),
    ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nd", "CC-BY-ND-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"), ("cc-by-nc-nd", "CC-BY-NC-ND-4.0"), ("cc-by-work", "CC-BY-4.0"), ("cc-by-sa-work", "CC-BY-SA-4.0"),
    ("cc-by-nc-work", "CC-BY-NC-4.0"), ("cc-by-nd-work", "CC-BY-ND-4.0"), ("cc-by-nc-sa-work", "CC-BY-NC-SA-4.0"), ("cc-by-nc-nd-work", "CC-BY-NC-ND-4.0"), *((f"spdx-{n}", n) for n in SPDX),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A name; an abbreviation's dot in it ends no sentence.
_NAME = r"[a-z0-9]+(?:[ \n](?:\.\n)?[a-z0-9]+){0," + str(NAMES - 1) + "}?"
_LIST_MARK = "(?:[0-9a-z] )?"


def _pattern(sentence: str) -> str:
    # a name that begins a sentence stands on one line, or it would take in the lines before
    first, rest = (_NAME.replace(r"[ \n](?:\.\n)?", " "), sentence[1:]) if sentence[0] == "*" else ("", sentence)
    return first + rest.replace(" ", r"[ \n]").replace("*[ \\n]", "*[ \\n](?:\\.\\n)?").replace("*", _NAME)


_ORDER = sorted(SENTENCES.items(), key=lambda kv: (kv[1].count("*"), -len(kv[1])))
#: A known sentence on lines of its own, however wrapped; those without names first, longer ones first. No normalised line has a dot.
KNOWN = "(?m)^" + _LIST_MARK + "(?:" + "|".join(_pattern(s) for _, s in _ORDER) + ")$"
_NAMED = [(k, f"^{_LIST_MARK}{_pattern(s)}$") for k, s in _ORDER if "*" in s]


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, without empty ones; a dot where lines before and after can't be joined."""
    plain = lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "))
    lines = lambda p: F.filter(F.transform(F.split(p, r"\n+"), plain), lambda s: s != "")
    return F.flatten(F.transform(F.split(F.regexp_replace(text, MARK, "\n$1"), STOP), lambda p: F.concat(lines(p), F.array(F.lit(".")))))


def _identifier(hit: Column) -> Column:
    """The identifier of a known sentence as found: on one line or several, behind a list mark or none."""
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() if "*" not in s for x in (s, name)])
    flat = F.translate(hit, "\n", " ")
    found = [F.when(F.rlike(hit, F.lit(p)), F.lit(k)) for k, p in _NAMED]
    return F.coalesce(known[flat], known[F.regexp_replace(flat, "^[0-9a-z] ", "")], *found)


def sequence(found: Column) -> Column:
    """found: sentences. The known ones' identifiers in order, each <so>, with bars at wide gaps (of other sentences, or other lines)."""
    between = lambda s: F.size(F.filter(F.split(s, "\n"), lambda x: (x != "") & (x != ".")))

    def marked(whole):
        gaps = F.split(whole, KNOWN)
        one = lambda h, i: F.concat(F.when((i > 0) & (between(F.get(gaps, i)) > GAP), "|").otherwise(""), F.lit("<"), _identifier(h), F.lit(">"))
        hits = F.regexp_extract_all(whole, F.lit(KNOWN), F.lit(0))
        return F.when(F.rlike(whole, F.lit(KNOWN)), F.array_join(F.transform(hits, one), "")).otherwise("")

    return let(F.array_join(found, "\n"), marked)


def _rule(names: str) -> str:
    return "".join(f"<{n}>" for n in names.split())


def matched(sequence: Column) -> Column:
    """Licences that a sequence states, in the rules' order, each once."""
    rules = F.array(*[F.struct(F.lit(_rule(r)).alias("rule"), F.lit(n).alias("name")) for r, n in RULES])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.when(F.contains(a["left"], r["rule"]), F.struct(F.replace(a["left"], r["rule"], F.lit("#")).alias("left"), F.array_union(a["names"], F.array(r["name"])).alias("names"))).otherwise(a)
    return F.array_join(F.aggregate(rules, start, step, lambda a: a["names"]), ",")


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_sentences, sentence_ids (each <so>, a bar at a gap), licences (comma-joined, empty for none).

    A null or empty text has no sentences. Repeated rows have equal results. A very long text is scanned whole. Other columns aren't read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), let(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: F.struct(F.size(F.filter(s, lambda x: x != ".")).cast("long").alias("n"), sequence(s).alias("ids"))).alias("found"))
    return rows.select("doc_id", F.col("found.n").alias("n_sentences"), F.col("found.ids").alias("sentence_ids"), F.when(F.col("found.ids") == "", "").otherwise(matched(F.col("found.ids"))).alias("licences"))


def oracle() -> str:
    """The same as DuckDB SQL: known sentences are rows of a table, tried one by one on what the pattern of all found; rules are applied by a recursive query."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({k}, {quoted(name)}, {quoted('^' + _LIST_MARK + _pattern(s) + '$')})" for k, (name, s) in enumerate(_ORDER))
    rules = ", ".join(f"({k + 1}, {quoted(_rule(r))}, {quoted(n)})" for k, (r, n) in enumerate(RULES))
    return rf"""WITH RECURSIVE known(place, id, pattern) AS (VALUES {table}), rules(k, rule, name) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '{MARK}', chr(10) || '\1', 'g'), '{STOP}') AS parts FROM documents),
s AS (SELECT r, doc_id, flatten(list_transform(parts, lambda p: list_append(list_filter(list_transform(regexp_split_to_array(p, '\n+'),
    lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''), '.'))) AS found FROM p),
w AS (SELECT r, doc_id, len(list_filter(found, lambda x: x <> '.')) AS n, array_to_string(found, chr(10)) AS whole FROM s),
h AS (SELECT r, whole, regexp_extract_all(whole, {quoted(KNOWN)}) AS hits FROM w WHERE regexp_matches(whole, {quoted(KNOWN)})),
e AS (SELECT r, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i, unnest(regexp_split_to_array(whole, {quoted(KNOWN)})[1 : len(hits)]) AS gap FROM h),
d AS (SELECT hit, arg_min(id, place) AS id FROM (SELECT DISTINCT hit FROM e) JOIN known ON regexp_matches(hit, pattern) GROUP BY hit),
q AS (SELECT r, string_agg(CASE WHEN i > 1 AND len(list_filter(string_split(gap, chr(10)), lambda x: x <> '' AND x <> '.')) > {GAP} THEN '|' ELSE '' END || '<' || id || '>', '' ORDER BY i) AS ids FROM e JOIN d USING (hit) GROUP BY r),
m(ids, k, rest, names) AS (SELECT DISTINCT ids, 0, ids, []::VARCHAR[] FROM q UNION ALL
    SELECT ids, rules.k, replace(rest, rule, '#'), CASE WHEN contains(rest, rule) AND NOT list_contains(names, name) THEN list_append(names, name) ELSE names END FROM m JOIN rules ON rules.k = m.k + 1)
SELECT doc_id, n::BIGINT AS n_sentences, coalesce(q.ids, '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences
FROM w LEFT JOIN q USING (r) LEFT JOIN (SELECT * FROM m WHERE k = {len(RULES)}) m ON q.ids = m.ids"""
