"""Licences in documents: sentences to identifiers, sequences of identifiers to licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import whole_text

# --- fixed values: sentences of public licences and notices, and what their sequences mean ---
SENTENCES = {
    "APACHE2_UNDER": "Licensed under the Apache License, Version 2.0.",
    "APACHE2_NOTICE": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "APACHE2_COPY": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE2_ASIS": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT_UNDER": "Released under the MIT License.",
    "MIT_LICENSED": "Licensed under the MIT License.",
    "MIT_GRANT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT_NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT_WARRANTY": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "BSD_GRANT": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD_SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD_BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD_NAME": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL3_UNDER": "This work is licensed under the GNU General Public License, version 3.",
    "GPL_FREE": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2_FREE": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL_WARRANTY": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL_COPY": "You should have received a copy of the GNU General Public License along with this program.",
    "MPL2_UNDER": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CCBYNC4_UNDER": "Licensed under CC BY-NC 4.0.",
    "CCBY4_UNDER": "Licensed under CC BY 4.0.",
    "CCBYSA4_UNDER": "Licensed under CC BY-SA 4.0.",
    "CCBY4_WORK": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CCBYNC4_WORK": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "RIGHTS_RESERVED": "All rights reserved; no licence is granted.",
}
#: The first rule that matches where an identifier stands is taken, and goes on behind it.
RULES = [
    ("Apache-2.0", ["APACHE2_NOTICE", "APACHE2_COPY", "APACHE2_ASIS"]),
    ("Apache-2.0", ["APACHE2_NOTICE"]),
    ("Apache-2.0", ["APACHE2_UNDER"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY"]),
    ("MIT", ["MIT_UNDER"]),
    ("MIT", ["MIT_LICENSED"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL_WARRANTY", "GPL_COPY"]),
    ("GPL-3.0-or-later", ["GPL_FREE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL_WARRANTY", "GPL_COPY"]),
    ("GPL-2.0-or-later", ["GPL2_FREE"]),
    ("GPL-3.0-only", ["GPL3_UNDER"]),
    ("MPL-2.0", ["MPL2_UNDER"]),
    ("CC-BY-NC-4.0", ["CCBYNC4_UNDER"]),
    ("CC-BY-NC-4.0", ["CCBYNC4_WORK"]),
    ("CC-BY-4.0", ["CCBY4_UNDER"]),
    ("CC-BY-4.0", ["CCBY4_WORK"]),
    ("CC-BY-SA-4.0", ["CCBYSA4_UNDER"]),
    ("LicenseRef-none", ["RIGHTS_RESERVED"]),
]
#: Further sentences, and further wordings of those above; {} stands for up to SLOT words, such as a holder's name.
#: The SQL does not know them, nor sentences that are broken over lines.
WIDER = [
    ("APACHE2_COPY", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2_COPY", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.txt"),
    ("APACHE2_COPY", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0.txt"),
    ("APACHE2_ASF", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("APACHE2_TITLE", "Apache License Version 2.0, January 2004"),
    ("MIT_NOTICE", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("MIT_LICENSED", "This project is licensed under the MIT License."),
    ("MIT_LICENSED", "This software is licensed under the MIT License."),
    ("MIT_UNDER", "This software is released under the MIT License."),
    ("MIT_UNDER", "Released under the MIT licence."),
    ("MIT_LICENSED", "Licensed under the MIT licence."),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC_GRANT", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ZERO_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer."),
    ("BSD_ADS", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {}."),
    ("BSD_NAME", "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD_NAME", "Neither the name of {} nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD_NAME", "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL_FREE", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL_FREE", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3, or (at your option) any later version."),
    ("GPL2_FREE", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL2_FREE", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version."),
    ("GPL2_ONLY", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL2_ONLY", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("GPL3_ONLY", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GPL3_ONLY", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL21_FREE", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL3_FREE", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL3_FREE", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL2_FREE", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL3_FREE", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL_WARRANTY", "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL_COPY", "You should have received a copy of the GNU General Public License along with {}."),
    ("LGPL_COPY", "You should have received a copy of the GNU Lesser General Public License along with {}."),
    ("AGPL_COPY", "You should have received a copy of the GNU Affero General Public License along with {}."),
    ("GPL1_TITLE", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL2_TITLE", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL3_TITLE", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL2_TITLE", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL21_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL3_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL3_TITLE", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL2_TITLE", "Mozilla Public License Version 2.0"),
    ("EPL1_TITLE", "Eclipse Public License - v 1.0"),
    ("EPL2_TITLE", "Eclipse Public License - v 2.0"),
    ("EPL1_UNDER", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL1_UNDER", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL2_UNDER", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL2_UNDER", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("UNLICENSE", "This is free and unencumbered software released into the public domain."),
    ("CC0_TITLE", "CC0 1.0 Universal"),
    ("CC0_WAIVED", "To the extent possible under law, {} has waived all copyright and related or neighboring rights to {}."),
    ("CCBYSA4_WORK", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CCBYND4_WORK", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CCBYNCSA4_WORK", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CCBYNCND4_WORK", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CCBYND4_UNDER", "Licensed under CC BY-ND 4.0."),
    ("CCBYNCSA4_UNDER", "Licensed under CC BY-NC-SA 4.0."),
    ("CCBYNCND4_UNDER", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0_UNDER", "Licensed under CC0 1.0."),
    ("BOOST_UNDER", "Distributed under the Boost Software License, Version 1.0."),
    ("BOOST_TITLE", "Boost Software License - Version 1.0 - August 17th, 2003"),
]
#: Licences of the wider sentences, tried before RULES.
WIDER_RULES = [
    ("BSD-4-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADS", "BSD_NAME"]),
    ("Apache-2.0", ["APACHE2_ASF", "APACHE2_COPY", "APACHE2_ASIS"]),
    ("GPL-2.0-only", ["GPL2_ONLY", "GPL_WARRANTY", "GPL_COPY"]), ("GPL-3.0-only", ["GPL3_ONLY", "GPL_WARRANTY", "GPL_COPY"]),
    ("LGPL-2.0-or-later", ["LGPL2_FREE", "GPL_WARRANTY"]), ("LGPL-2.1-or-later", ["LGPL21_FREE", "GPL_WARRANTY", "LGPL_COPY"]),
    ("LGPL-3.0-or-later", ["LGPL3_FREE", "GPL_WARRANTY", "LGPL_COPY"]), ("AGPL-3.0-or-later", ["AGPL3_FREE", "GPL_WARRANTY", "AGPL_COPY"]),
    ("Apache-2.0", ["APACHE2_ASF"]), ("Apache-2.0", ["APACHE2_TITLE"]), ("ISC", ["ISC_GRANT"]), ("0BSD", ["ZERO_GRANT"]),
    ("GPL-2.0-only", ["GPL2_ONLY"]), ("GPL-3.0-only", ["GPL3_ONLY"]), ("LGPL-2.0-or-later", ["LGPL2_FREE"]),
    ("LGPL-2.1-or-later", ["LGPL21_FREE"]), ("LGPL-3.0-or-later", ["LGPL3_FREE"]), ("AGPL-3.0-or-later", ["AGPL3_FREE"]),
    ("GPL-1.0", ["GPL1_TITLE"]), ("GPL-2.0", ["GPL2_TITLE"]), ("GPL-3.0", ["GPL3_TITLE"]), ("LGPL-2.0", ["LGPL2_TITLE"]),
    ("LGPL-2.1", ["LGPL21_TITLE"]), ("LGPL-3.0", ["LGPL3_TITLE"]), ("AGPL-3.0", ["AGPL3_TITLE"]), ("MPL-2.0", ["MPL2_TITLE"]),
    ("EPL-1.0", ["EPL1_TITLE"]), ("EPL-1.0", ["EPL1_UNDER"]), ("EPL-2.0", ["EPL2_TITLE"]), ("EPL-2.0", ["EPL2_UNDER"]),
    ("Unlicense", ["UNLICENSE"]), ("CC0-1.0", ["CC0_TITLE"]), ("CC0-1.0", ["CC0_WAIVED"]), ("CC0-1.0", ["CC0_UNDER"]),
    ("CC-BY-SA-4.0", ["CCBYSA4_WORK"]), ("CC-BY-ND-4.0", ["CCBYND4_WORK"]), ("CC-BY-ND-4.0", ["CCBYND4_UNDER"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4_WORK"]), ("CC-BY-NC-SA-4.0", ["CCBYNCSA4_UNDER"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCND4_WORK"]), ("CC-BY-NC-ND-4.0", ["CCBYNCND4_UNDER"]),
    ("BSL-1.0", ["BOOST_UNDER"]), ("BSL-1.0", ["BOOST_TITLE"]),
]
#: What an SPDX-License-Identifier may name; older names without "only" stay as they are written.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause "
    "BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 "
    "CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 "
    "Vim W3C WTFPL X11 Zlib"
).split()
#: Words that a slot of a sentence may hold.
SLOT = 12
#: Every known sentence holds one of these; other texts need not be split.
CUES = "licen|permission|redistribut|software|warranty|waived|cc0"
_ENDS = r"([.!?:])[ \t]+"


def normalised(sentence: str) -> str:
    """Letters a to z and digits in lower case, everything between them one space."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Identifier of each normalised sentence, and of its parts where it ends within itself ("v. 2.0")."""
    out = {}
    for name, sentence in SENTENCES.items():
        pieces = [normalised(p) for p in re.sub(_ENDS, r"\1\n", sentence).split("\n")]
        # A sentence that the splitter cuts is known by its last piece.
        out[next(p for p in reversed(pieces) if len(p) > 3 or len(pieces) == 1)] = name
    return out


def _pattern(rules=RULES) -> str:
    return "|".join("(?:" + "".join(f"{i} " for i in ids) + ")" for _, ids in rules)


def _licence_of(rules=RULES) -> dict[str, str]:
    return {"".join(f"{i} " for i in ids): licence for licence, ids in rules}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _spdx_id(name: str) -> str:
    return "SPDX_" + re.sub("[^A-Z0-9]", "_", name.upper())


def _sentences() -> dict[str, str]:
    """Identifier of every known sentence as a whole, normalised and without what fills its slots."""
    every = [*SENTENCES.items(), *WIDER, *((_spdx_id(x), f"SPDX-License-Identifier: {x}") for x in SPDX)]
    return {normalised(sentence.replace("{}", "")): name for name, sentence in every[::-1]}


def _rules() -> list[tuple[str, list[str]]]:
    return [*WIDER_RULES, *RULES, *((x, [_spdx_id(x)]) for x in SPDX)]


def _broken(plain: str) -> str:
    """A pattern for words that may stand on several lines."""
    return plain.replace(" ", "[ \n]")


def _lines(text: Column) -> Column:
    """Normalised words, with a line break where a line or a sentence ends or a list's number stands."""
    # Each licence of an SPDX expression gets a tag of its own; a plus means or later.
    text = F.regexp_replace(text, r"[ \t]+(?:OR|AND|WITH)[ \t]+(?<=SPDX-License-Identifier:[^\r\n]{0,200})", "\nSPDX-License-Identifier: ")
    text = F.regexp_replace(text, r"(?<=GPL-[123]\.[01])\+", "-or-later")
    text = F.regexp_replace(text, r"(?mi)^[ \t]*(?:rem|dnl)\b", "")
    text = F.regexp_replace(text, r"(?m)^([^A-Za-z0-9\n]*(?:[0-9]{1,2}|[A-Za-z])[.)])[ \t]+", "$1\n")
    text = F.regexp_replace(text, _ENDS, "$1\n")
    text = F.regexp_replace(F.lower(text), "[^a-z0-9\r\n]+", " ")
    text = F.trim(F.regexp_replace(text, " ?[\r\n][ \r\n]*", "\n"))
    # Of a sentence that begins with a slot, the slot is on one line, so that it takes in no other sentence.
    word = "[a-z0-9]+"
    first, other = (f"{word}(?:{gap}{word}){{0,{SLOT - 1}}}?" for gap in (" ", "[ \n]"))
    for _, sentence in WIDER:
        fixed = [_broken(normalised(p)) for p in sentence.split("{}")]
        if len(fixed) > 1:
            pieces = [fixed[0] or first]
            for i, part in enumerate(fixed[1:]):
                pieces += [other] * (i > 0 or bool(fixed[0])) + [part] * bool(part)
            text = F.regexp_replace(
                text, f"(?<![^\n]){'[ \n]'.join(pieces)}(?![^\n])", normalised(sentence.replace("{}", ""))
            )
    return text


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    sentences = _sentences()
    longest_first = "|".join(map(_broken, sorted(sentences, key=lambda k: (-len(k), k))))
    found = F.regexp_extract_all(_lines(text), F.lit(f"(?<![^\n])(?:{longest_first})(?![^\n])"), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(_map(sentences), F.translate(s, "\n", " ")))
    return F.when(F.lower(text).rlike(CUES), ids).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licences, n_licences of every document.

    Sentences end at a line's end or at . ! ? : before a blank, and may be broken
    over lines, with comment marks or numbers before them. Their identifiers,
    in order and without unknown sentences between, are matched from left to right
    against the rules, the first that fits taken; identifiers that no rule takes are
    passed over. Licences are listed once each, in order of appearance, joined by
    one space. All of it is built-in functions on a single row: no shuffle.

    Null text is empty: no sentences, no licences. Rows with equal or null ids give
    a row each; an empty table gives none; other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(whole_text()).alias("ids"))
    line = F.concat(F.array_join("ids", " "), F.lit(" "))
    matched = F.when(F.size("ids") > 0, F.regexp_extract_all(line, F.lit(rf"\b(?:{_pattern(_rules())})"), F.lit(0)))
    names = F.array_distinct(F.transform(matched, lambda m: F.try_element_at(_map(_licence_of(_rules())), m)))
    return found.select(
        "doc_id", F.array_join("ids", " ").alias("sentence_ids"),
        F.coalesce(F.array_join(names, " "), F.lit("")).alias("licences"),
        F.coalesce(F.size(F.filter(names, lambda n: n.isNotNull())), F.lit(0)).cast("long").alias("n_licences"),
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    sentences = ", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in known().items())
    rules = ", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in _licence_of().items())
    return f"""
WITH known(plain, id) AS (VALUES {sentences}), rules(ids, licence) AS (VALUES {rules}),
lookup AS (SELECT map(list(plain), list(id)) AS m FROM known),
named AS (SELECT map(list(ids), list(licence)) AS m FROM rules),
pieces AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS p
  FROM documents
),
ids AS (
  SELECT doc_id, list_filter(
    list_transform(p, lambda x: m[trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL
  ) AS ids FROM pieces, lookup
),
matched AS (
  SELECT doc_id, ids, list_transform(
    regexp_extract_all(array_to_string(ids, ' ') || ' ', {_sql(_pattern())}), lambda x: m[x]
  ) AS names FROM ids, named
),
once AS (
  SELECT doc_id, ids, list_filter(names, lambda n, i: list_position(names, n) = i) AS names FROM matched
)
SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
  coalesce(array_to_string(names, ' '), '') AS licences, CAST(len(names) AS BIGINT) AS n_licences
FROM once
"""
