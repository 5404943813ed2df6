"""License scan by sentence rules, in DataFrame expressions only.

A text is cut into sentences, each is normalised (lower case, runs of other characters than
letters and digits to one space, names of holders to one word) and looked up among known
licence sentences; what remains is the ordered list of sentence identifiers. A licence is
recognised where one of its rules, a list of identifiers, stands in that list in order and
without gaps. Sentences are cut in two ways, since a line end may end one or not: at every
line end, and at empty lines only (comment marks at line starts are passed over), so wrapped
licence texts are read as well as headers without a full stop. Both lists are held against
the rules; the one with more known sentences is returned, the first if they are level.
Nothing is shuffled: the known sentences and rules are literals.

A reservation of rights is a known sentence, but no licence. Rules ask for the sentence that
tells a licence from its relatives: two clauses of redistribution followed by the disclaimer
or by the clause on names.

Defined cases: null or empty text has no sentence; a sentence that is not known is passed
over; a licence named twice is named once; repeated rows each get their own result; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, as the licences have them.
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-head-you": 'to you under the Apache License, Version 2.0 (the "License");',
    "apache2-use": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache2-definitions": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd3-short": "Licensed under the BSD 3-Clause License.",
    "bsd2-short": "Licensed under the BSD 2-Clause License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-short": "Licensed under the GNU General Public License, version 3.",
    "gpl2-short": "Licensed under the GNU General Public License, version 2.",
    "gpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-notice-rest": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "version 2 of the License.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-short": "Licensed under the GNU Lesser General Public License, version 3.",
    "lgpl3-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-short": "Licensed under the GNU Affero General Public License, version 3.",
    "agpl3-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-form-cut": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-rest": "2.0.",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-obtain-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ccby4": "Licensed under CC BY 4.0.",
    "ccbysa4": "Licensed under CC BY-SA 4.0.",
    "ccbync4": "Licensed under CC BY-NC 4.0.",
    "ccbyncsa4": "Licensed under CC BY-NC-SA 4.0.",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "Released under CC0 1.0.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "rights": "All rights reserved.",
}
#: Licences by rules of sentence identifiers, in order.
RULES = {
    "0BSD": [["0bsd-grant", "isc-asis"]],
    "AGPL-3.0": [["agpl3-short"], ["agpl3-notice"]],
    "Apache-2.0": [["apache2-short"], ["apache2-head", "apache2-use"], ["apache2-head-you", "apache2-use"], ["apache2-use", "apache2-copy", "apache2-asis"], ["apache2-use", "apache2-copy-url", "apache2-asis"], ["apache2-use", "apache2-copy-https", "apache2-asis"], ["apache2-terms", "apache2-definitions"], ["apache2-title"]],
    "BSD-2-Clause": [["bsd2-short"], ["bsd-source", "bsd-binary", "bsd-asis"]],
    "BSD-3-Clause": [["bsd3-short"], ["bsd-source", "bsd-binary", "bsd-names"]],
    "BSD-4-Clause": [["bsd-source", "bsd-binary", "bsd-advertising"]],
    "CC-BY-4.0": [["ccby4"], ["ccby4-work"]],
    "CC-BY-NC-4.0": [["ccbync4"], ["ccbync4-work"]],
    "CC-BY-NC-SA-4.0": [["ccbyncsa4"]],
    "CC-BY-SA-4.0": [["ccbysa4"], ["ccbysa4-work"]],
    "CC0-1.0": [["cc0"], ["cc0-waiver"]],
    "GPL-2.0": [["gpl2-short"], ["gpl2-notice", "gpl2-version"], ["gpl2-notice", "gpl2-only"]],
    "GPL-3.0": [["gpl3-work"], ["gpl3-short"], ["gpl3-notice"], ["gpl3-notice-rest"]],
    "ISC": [["isc-grant", "isc-asis"], ["isc-grant-and", "isc-asis"]],
    "LGPL-2.1": [["lgpl21-notice", "lgpl21-version"]],
    "LGPL-3.0": [["lgpl3-short"], ["lgpl3-notice"]],
    "MIT": [["mit-short"], ["mit-licensed"], ["mit-grant", "mit-notice"]],
    "MPL-2.0": [["mpl2-form"], ["mpl2-form-cut", "mpl2-rest"], ["mpl2-obtain"], ["mpl2-obtain-https"]],
    "Unlicense": [["unlicense", "unlicense-anyone"]],
}
#: Where a licence names its holder, and what is read there.
HOLDERS = (
    (r"^neither the name of .{1,300} nor the names of (its|their|other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"^this software is provided by .{1,300} as is and any", "this software is provided by the copyright holders and contributors as is and any"),
    (r"^.{1,300} licenses this file to you under the apache", "to you under the apache"),
    (r"^to the extent possible under law .{1,300} has waived all", "to the extent possible under law the author has waived all"),
    (r"^(this library|this file|this software) is distributed in the hope", "this program is distributed in the hope"),
)
#: A text without any of these stems holds no known sentence that a rule begins with.
STEMS = r"(?i)licen[sc]|cc0|copyright|warrant|rights\W+reserved|redistribut|hereby\W+granted|unencumbered|creative\W+commons"


def _normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def normalised(sentence: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))
    for pattern, name in HOLDERS:
        out = F.regexp_replace(out, pattern, name)
    return out


def sentences(text: Column) -> Column:
    """Cut after a closing mark that white space follows, and at line ends."""
    return F.split(F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n"), r"\n")


def wrapped_sentences(text: Column) -> Column:
    """Cut after a closing mark that white space follows, and at lines that are empty but for comment marks."""
    lines = F.regexp_replace(text, r"(?m)^[\x20\t]*+(?:[#*;%|>-]++|//++|/\*++|\*/|<!--|-->|(?i:dnl|rem)(?=\s))?[\x20\t]*+", "")
    whole = F.regexp_replace(F.regexp_replace(lines, r"\r", ""), r"\n{2,}+", "\u0001")
    return F.split(F.regexp_replace(F.regexp_replace(whole, r"\n", " "), r"([.!?;:])[\x20\x09-\x0D]+", "$1\u0001"), "\u0001")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sequence (identifiers in order), licenses (sorted), both joined by commas."""
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (_normal(v), k)])
    none = F.array().cast("array<string>")

    def ids(parts: Column) -> Column:
        found = F.transform(F.filter(parts, lambda s: F.length(s) > 3), lambda s: F.try_element_at(known, normalised(s)))
        return F.when(F.col("text").rlike(STEMS), F.filter(found, lambda i: i.isNotNull())).otherwise(none)

    d = docs.select("doc_id", ids(sentences(F.col("text"))).alias("lines"), ids(wrapped_sentences(F.col("text"))).alias("wrapped"))
    line, wrapped = (F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")) for c in ("lines", "wrapped"))

    def met(rules: list[list[str]]) -> Column:
        found = F.lit(False)
        for rule in rules:
            own = F.lit("," + ",".join(rule) + ",")
            found |= F.contains(line, own) | F.contains(wrapped, own)
        return found

    got = F.array_sort(F.filter(F.array(*[F.when(met(rules), F.lit(name)) for name, rules in RULES.items()]), lambda x: x.isNotNull()))
    best = F.when(F.size("wrapped") > F.size("lines"), F.col("wrapped")).otherwise(F.col("lines"))
    return d.select("doc_id", F.size(best).cast("long").alias("n_known"), F.array_join(best, ",").alias("sequence"), F.array_join(got, ",").alias("licenses"))
