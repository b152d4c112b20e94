"""Licence texts as they are published: wrapped, and behind comment marks."""

import textwrap

import duckdb
import pyarrow as pa
import pytest
from framewright.llm.licences import RULES, SENTENCES, oracle, scan_licences

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
HOLDER = BSD.replace("the copyright holder nor", "Example Widgets Inc. nor")
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
SPDX_LINE = "SPDX-License-Identifier: BSD-3-Clause\n"
UNLICENSE = "This is free and unencumbered software released into the public\ndomain.\n"
TITLE = "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n"
WANT = [
    (MIT, "<mit-grant><mit-notice><mit-warranty>", "MIT"), (BSD, "<bsd-use><bsd-source><bsd-binary><bsd-endorse>", "BSD-3-Clause"), (BSD[: BSD.index("3.")], "<bsd-use><bsd-source><bsd-binary>", "BSD-2-Clause"),
    (GPL, "<gpl3-program><gpl-hope>", "GPL-3.0-or-later"), (GPL.replace("software:", "software;"), "<free-program><gpl3-terms><gpl-hope>", "GPL-3.0-or-later"), (APACHE, "<apache-defined><apache-comply><apache-copy>", "Apache-2.0"),
    (HOLDER, "<bsd-use><bsd-source><bsd-binary><bsd-endorse>", "BSD-3-Clause"), (GPL.replace("version 3", "version 2").replace("This program is free", "Widgets 2 is free"), "<gpl2-named><gpl-hope>", "GPL-2.0-or-later"),
    (LGPL.replace("Foundation;", "Foundation,"), "<free-library><lgpl21-terms>", "LGPL-2.1-or-later"), (MPL, "<mpl2-form><mpl2-copy>", "MPL-2.0"), (ISC, "<isc-grant><isc-warranty>", "ISC"), (SPDX_LINE, "<spdx-BSD-3-Clause>", "BSD-3-Clause"),
    (UNLICENSE, "<unlicense-free>", "Unlicense"), (TITLE, "<agpl3-title>", "AGPL-3.0"),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "\t"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped(table, mark, end):
    rows = [(k, end.join(["def f(): pass", *(mark + line for line in text.splitlines()), "code();"]), "a") for k, (text, _, _) in enumerate(WANT)]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in scan_licences(table(rows)).collect()}
    assert got == {k: (ids, name) for k, (_, ids, name) in enumerate(WANT)}


def test_any_width_and_no_joins_over_ends(table):
    grant, notice = SENTENCES["mit-grant"], SENTENCES["mit-notice"]
    rows = [(w, textwrap.fill(grant, w), "a") for w in (14, 20, 33, 70, 900)]
    rows += [(2000, "released under.\nthe mit license", "a"), (2001, "not released under\nthe mit license", "a"), (2002, SENTENCES["free-program"] + ".\n" + SENTENCES["gpl3-terms"], "a")]
    rows += [(2003, textwrap.fill(grant, 40) + "\nx\ny\nz\n" + textwrap.fill(notice, 40), "a")]
    got = {r.doc_id: r.sentence_ids for r in scan_licences(table(rows)).collect()}
    assert got == {w: "<mit-grant>" for w in (14, 20, 33, 70, 900)} | {2000: "", 2001: "", 2002: "<free-program><gpl3-terms>", 2003: "<mit-grant>|<mit-notice>"}


def test_every_rule_names_known_sentences_and_every_sentence_is_found(table):
    assert {n for rule, _ in RULES for n in rule.split()} <= set(SENTENCES)
    assert len({name for _, name in RULES}) >= 30
    rows = [(k, s.replace("*", "some one and others"), "a") for k, s in enumerate(SENTENCES.values())]
    got = {r.doc_id: r.sentence_ids for r in scan_licences(table(rows)).collect()}
    assert got == {k: f"<{n}>" for k, n in enumerate(SENTENCES)}


def test_the_sql_agrees_on_wrapped_texts(table):
    rows = [(k, mark + ("\n" + mark).join(text.splitlines()), "a") for k, (mark, text) in enumerate((m, t) for m in ("", "# ", ";; ") for t, _, _ in WANT)] + [(900, None, "a"), (901, "", "a"), (902, MIT + "\nx\ny\nz\n" + BSD + APACHE, "a")]
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = db.execute(oracle()).fetchall()
    assert sorted(map(str, (tuple(r) for r in scan_licences(table(rows)).collect()))) == sorted(map(str, want))
