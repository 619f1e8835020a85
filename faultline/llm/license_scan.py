"""Licence recognition by sentences and rules, in SQL functions alone.

A text is cut into sentences, each normalised (lower case, runs of other than
letters and digits become one blank, the many ways to say "licensed under" one)
and looked up among known licence sentences. The identifiers, in order, are
matched against ordered licence rules: a rule names sentences that must follow
one another, with at most GAP other known sentences between, and earlier rules
win over later ones that match inside the same identifiers.

Sentences, their numbers and the rules all derive from NOTICES and NAMES.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_GNU_END = """

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} for more details.

You should have received a copy of the GNU {licence} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""


def _gnu(licence: str, terms: str, what: str = "program", mark: str = ":") -> str:
    return f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {licence} {terms}" + _GNU_END.format(what=what, licence=licence)


def _later(version: str, mark: str = ",") -> str:
    return f"as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."


#: Licences, their usual notices, and what the sentences hold that tell the licence by themselves, alone or one after another (none: the whole notice does).
NOTICES: tuple[tuple[str, str, tuple[str | tuple[str, ...], ...]], ...] = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ('Version 2.0 (the "License")',)),
    ("GPL-3.0-or-later", _gnu("General Public License", _later("3")), ("version 3",)),
    ("GPL-2.0-or-later", _gnu("General Public License", _later("2", ";"), mark=";"), (("General Public License as published", "either version 2"),)),
    ("GPL-2.0-or-later", _gnu("General Public License", _later("2")), ("version 2",)),
    ("GPL-3.0-only", _gnu("General Public License", "as published by the Free Software Foundation, version 3."), ("version 3",)),
    ("GPL-2.0-only", _gnu("General Public License", "version 2 as published by the Free Software Foundation.", mark=";"), ("version 2",)),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", _later("3")), ("version 3",)),
    ("LGPL-2.1-or-later", _gnu("Lesser General Public License", _later("2.1", ";"), "library", ";"), (("Lesser General Public License as published", "either version 2.1"),)),
    ("LGPL-2.1-or-later", _gnu("Lesser General Public License", _later("2.1")), ("version 2.1",)),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", _later("3")), ("version 3",)),
    ("AGPL-3.0-only", _gnu("Affero General Public License", "as published by the Free Software Foundation, version 3."), ("version 3",)),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("to deal in the Software without restriction",)),
    ("BSD-3-Clause", _BSD + """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_END, ()),
    ("BSD-3-Clause", _BSD + """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", ()),
    ("BSD-2-Clause", _BSD + _BSD_END, ()),
    ("BSD-2-Clause", _BSD, ()),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", ("and this permission notice appear in all copies",)),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ("Mozilla Public License",)),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""", ("Eclipse Public License",)),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt""", ("Boost Software License",)),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""", ("person or organization",)),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""", ("Permission is granted to anyone",)),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered",)),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.""", ("dedicated all copyright", "CC0 Public Domain")),
)

#: Names of licences, normalised, as they stand after "licensed under" or alone in a heading.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license v3 or later", "gpl 3 0 or later", "gplv3 or later", "gpl v3 or later"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license v2 or later", "gpl 2 0 or later", "gplv2 or later", "gpl v2 or later"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "lgpl v3", "lgplv3", "lgpl 3 0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "agpl v3", "agplv3", "agpl 3 0"),
    "MIT": ("mit license", "mit licence", "mit", "expat license"),
    "BSD-3-Clause": ("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "3 clause bsd", "new bsd license", "modified bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "2 clause bsd", "simplified bsd license"),
    "ISC": ("isc license", "isc"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
    "Zlib": ("zlib license", "zlib"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0", "cc0", "creative commons zero v1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike 4 0"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives 4 0"),
}

#: A text without any of these has no known sentence: each sentence holds one.
HINT = r"(?i)licen|permission|redistribut|copyright|free software|unencumbered|merchantability|under"
#: Other known sentences that may stand between those of a rule.
GAP = 2
#: "v. 2.0" holds no end of a sentence.
VERSION, VERSION_JOINED = r"([\x20,][vV])\.\x20+([0-9])", (r"$1.$2", r"\1.\2")
#: What a sentence begins with before a licence's name, and what stands for it.
LEAD, UNDER = (
    r"^(?:(?:this|the|our|all) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|provided|made available) under (?:the terms of )?(?:the |an |a )?",
    "under ",
)
#: Ends of sentences. A period between digits or inside a name isn't one.
SPLIT = r"(?<=[.!?;:])[\x20\t]+|[.!?;:]?\s*\n\s*"
#: The same, but for single line ends: sentences that are wrapped over lines.
SPLIT_WRAPPED = r"(?<=[.!?;:])\s+|\s*\n\s*\n\s*"
#: Comment marks at the start of lines.
MARKS = r"(?m)^[\x20\t]*(?://+|#+|\*+|/\*+|--+)[\x20\t]*"


def _normal(sentence: str) -> str:
    return re.sub(LEAD, UNDER, re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" "))


def _sentences(notice: str) -> list[str]:
    return [x for part in re.split(SPLIT_WRAPPED, re.sub(VERSION, VERSION_JOINED[1], notice)) if (x := _normal(part))]


def _catalogue() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Known sentences with their numbers, and the ordered rules as (licence, pattern over identifiers): long sequences first."""
    numbers: dict[str, int] = {}

    def number(sentence: str) -> int:
        return numbers.setdefault(sentence, len(numbers) + 1)

    rules: dict[tuple[tuple[int, ...], ...], str] = {}
    for licence, notice, telling in NOTICES:
        whole = [number(x) for x in _sentences(notice)]
        rules.setdefault(tuple((i,) for i in whole), licence)
        for words in telling:
            marks = [_normal(w) for w in ((words,) if isinstance(words, str) else words)]
            rules.setdefault(tuple((next(number(x) for x in _sentences(notice) if mark in x),) for mark in marks), licence)
    for licence, names in NAMES.items():
        alone = [number(x) for name in names for x in (UNDER + name, *([name, "the " + name] if name.endswith(("license", "licence")) else []))]
        rules.setdefault((tuple(alone),), licence)
    between = f"(?::[0-9]+:){{0,{GAP}}}"
    ordered = sorted(rules.items(), key=lambda r: -len(r[0]))
    return numbers, [(licence, between.join("(?:" + "|".join(f":{i}:" for i in part) + ")" for part in parts)) for parts, licence in ordered]


SENTENCES, RULES = _catalogue()


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _identifiers(text: str, split: str) -> str:
    normal = f"regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ')), {_q(LEAD)}, {_q(UNDER)})"
    table = "map(" + ", ".join(f"{_q(k)}, ':{v}:'" for k, v in SENTENCES.items()) + ")"
    return f"array_join(transform(split({text}, {_q(split)}, -1), s -> try_element_at({table}, {normal})), '')"


def _licences(ids: str) -> str:
    """SQL: array of (licence, first) for the rules that match the identifiers, each match taken out before later rules look."""
    rules = "array(" + ", ".join(f"struct({_q(n)} as licence, {_q(p)} as pattern)" for n, p in RULES) + ")"
    return (
        f"if({ids} = '', cast(array() as array<struct<first:int,licence:string>>), aggregate({rules}, named_struct('ids', {ids}, 'out', cast(array() as array<struct<first:int,licence:string>>)), (acc, r) -> "
        f"if(acc.ids rlike r.pattern, named_struct('ids', regexp_replace(acc.ids, r.pattern, '-'), 'out', concat(acc.out, array(named_struct('first', regexp_instr({ids}, r.pattern), 'licence', r.licence)))), acc), acc -> array_sort(acc.out)))"
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every column of ``docs``, with licence_sentences (numbers in order, between colons) and licences (names, in order of first match, each once).

    Sentences wrapped over lines are recognised as well. A null or empty text
    has neither; repeated rows stay; columns named like the results are
    replaced, any others stay, whatever their names; an empty table gives an
    empty result.
    """
    names = [c for c in docs.columns if c not in ("licence_sentences", "licences")]
    t, a, b = unused(docs.columns, "t", "a", "b")
    bare = F.regexp_replace(F.regexp_replace(F.col(f"`{text}`"), F.lit(MARKS), F.lit("")), F.lit(VERSION), F.lit(VERSION_JOINED[0]))
    d = docs.select(*(F.col(f"`{c}`") for c in names), F.when(F.col(f"`{text}`").rlike(HINT), bare).alias(t))
    by_line, wrapped = (F.when(F.col(t).isNotNull(), F.expr(_identifiers(t, s))).otherwise("") for s in (SPLIT, SPLIT_WRAPPED))
    d = d.withColumn(a, by_line).withColumn(b, wrapped)
    d = d.withColumn("licence_sentences", F.when(F.length(b) > F.length(a), F.col(b)).otherwise(F.col(a)))
    both = f"array_distinct(concat(transform({_licences(a)}, x -> x.licence), transform({_licences(b)}, x -> x.licence)))"
    return d.withColumn("licences", F.expr(both)).drop(t, a, b)
