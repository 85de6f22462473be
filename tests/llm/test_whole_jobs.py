"""Jobs that were once done in part."""

from plantpulse.llm import extraction, licences, personal


def _pages(spark, shell, n=12):
    rows = [(i, f"http://a.example/{i}", shell.format(i)) for i in range(n)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in extraction.main_text(frame).collect()}


def test_the_tree_judges_inside_and_outside_of_articles(spark):
    """Boilerplate in an article goes under any name and as a plain paragraph; a body beside a teaser stays."""
    got = _pages(spark, (
        "<body><div class=xq>Same top</div><article><p>Teaser {0}</p><p class=zz>Same line</p><p>More {0}</p><div class=qq>Same box</div>"
        "<p>Same end</p></article><div class=story><p>Body {0} of many words</p><p>Body again {0}</p><ul><li>Same item</ul></div></body>"
    ))
    assert got[3] == "Teaser 3\nMore 3\nBody 3 of many words\nBody again 3"


def test_names_are_no_last_word(spark):
    """An article in a form or in a branch with a noisy name is found if the tree knows it as important."""
    got = _pages(spark, "<body><form id=page><div class=top>Same</div><div class='widget'><p>Own text {0}</p></div></form></body>")
    assert got[5] == "Own text 5"


def test_copies_of_a_page_are_no_site(spark):
    assert set(_pages(spark, "<body><article><p>One text</p><p>and more</p></article></body>").values()) == {"One text\nand more"}


def test_without_a_tree_elements_decide(spark):
    one = lambda page: _pages(spark, page, 1)[0]
    assert one("<div>see also</div><article>A long text of the article itself</article>") == "A long text of the article itself"
    assert one("<article>In short</article><div>The body of the text, much longer</div>") == "In short\nThe body of the text, much longer"


# --- licences as they stand in files ---------------------------------------------

APACHE = """/*
 * Copyright 2020 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package x;"""
MIT = """The MIT License (MIT)

Copyright (c) 2020 Somebody

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
#
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution."""
BSD_NAME = """
#
# 3. Neither the name of Some Company, Inc. nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission."""
GPL = """; This {0} is free software{1} you can redistribute it and/or modify
; it under the terms of the GNU {2}General Public License as published by
; the Free Software Foundation{3} either version {4} of the License, or
; (at your option) any later version.
;
; This {0} is distributed in the hope that it will be useful,
; but WITHOUT ANY WARRANTY; without even the implied warranty of
; MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
; GNU {2}General Public License for more details.
;
; You should have received a copy of the GNU {2}General Public License
; along with this {0}.  If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licences_broken_over_lines(spark):
    texts = {
        APACHE: "Apache-2.0", MIT: "MIT", MIT.replace("\n", "\r\n"): "MIT", BSD: "BSD-2-Clause", BSD + BSD_NAME: "BSD-3-Clause", ISC: "ISC", MPL: "MPL-2.0",
        GPL.format("program", ":", "", ",", "3"): "GPL-3.0-or-later", GPL.format("program", ";", "", ";", "2"): "GPL-2.0-or-later",
        GPL.format("library", ";", "Lesser ", ";", "2.1"): "LGPL-2.1-or-later", GPL.format("program", ":", "Affero ", ",", "3"): "AGPL-3.0-or-later",
        "This is free and unencumbered software released into the public\ndomain.": "Unlicense",
        "Creative Commons Legal Code\n\nCC0 1.0 Universal\n": "CC0-1.0", "Eclipse Public License - v 2.0\n\nTHE PROGRAM": "EPL-2.0",
        "// SPDX-License-Identifier: Apache-2.0\n#include": "Apache-2.0",
        "/* SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note) OR BSD-3-Clause */": "GPL-2.0-or-later BSD-3-Clause",
        "no stop before\nLicensed under the MIT License.\nThis program is free software.": "MIT",
        "We never said it was Licensed under the MIT License.": "", "mozilla public license, v. 1.1": "",
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.licences(frame).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    ids = {r.doc_id: r.sentence_ids for r in licences.licences(frame).collect()}
    assert ids[0] == "APACHE2_NOTICE APACHE2_COPY APACHE2_ASIS" and ids[4] == "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_NAME"


def test_every_identifier_of_the_wider_rules_has_a_sentence():
    assert {i for _, ids in licences._rules() for i in ids} <= set(licences._sentences().values())


# --- cards in other ways of writing ----------------------------------------------

def test_a_trained_model_adds_cards_with_other_separators(spark):
    """Half of the base candidates fail Luhn in the very same formats, as in the shared tables."""
    def check(fifteen):
        doubled = [int(d) * (2 - i % 2) for i, d in enumerate(fifteen)]
        return str(-sum(v - 9 * (v > 9) for v in doubled) % 10)

    rows, want = [], {}
    for i in range(120):
        body = str(411111111111111 + 7919 * i)
        right = body + check(body)
        if i % 2:
            right = body + str((int(right[-1]) + 1) % 10)
        rows.append((i, f"card {right[:4]} {right[4:8]} {right[8:12]} {right[12:]} of somebody"))
    card = "5500005555555559"
    fours = [card[j : j + 4] for j in range(0, 16, 4)]
    for i, gap in enumerate((".", "/", "_", "  "), 1000):
        want[i] = f"card:5:{5 + len(gap.join(fours))}"
        rows += [(i, f"card {gap.join(fours)} of somebody"), (i + 100, f"card {gap.join(fours)[:-1]}8 of somebody")]
        want[i + 100] = ""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal.train(docs)
    assert "card" in model.thresholds
    got = {r.doc_id: r.spans for r in personal.personal_data(docs, model).collect()}
    assert {i: got[i] for i in want} == want
    clean = {r.doc_id: r.text for r in personal.redacted(docs, model).collect()}
    assert all(clean[i] == "card [CARD] of somebody" for i in range(1000, 1004))
