"""License scans: normalised sentences become identifiers, and their sequences are matched against ordered rules."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import ascii_lower

# Sentences of public licences and notices, normalised (lower case, words only), by identifier.
TEXTS: dict[str, tuple[str, ...]] = {
    "mit-title": ("the mit license", "mit license"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mit-liability": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-as-is": (
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    "isc-liability": (
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "apache-2-compliance": ("you may not use this file except in compliance with the license",),
    "apache-2-copy": (
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    ),
    "as-is-distributed": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "apache-2-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "apache-2-definitions": ("license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",),
    "apache-2-copyright-grant": (
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ),
    "gpl-free-software": ("this program is free software",),
    "gpl-3-redistribute": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-2-redistribute": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-3-only-redistribute": ("you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",),
    "gpl-2-only-redistribute": ("you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",),
    "agpl-3-redistribute": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license or at your option any later version",
    ),
    "lgpl-free-software": ("this library is free software",),
    "lgpl-3-redistribute": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "lgpl-2-1-redistribute": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "gpl-see": ("see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"),
    "gpl-title-3": ("gnu general public license version 3 29 june 2007",),
    "gpl-title-2": ("gnu general public license version 2 june 1991",),
    "lgpl-title-3": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl-title-3": ("gnu affero general public license version 3 19 november 2007",),
    "cc-by-nc-4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa-4": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "this work is released under cc0 1 0", "this work is dedicated to the public domain"),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-anyone": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "bsd-redistribution": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-advertising": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-as-is": (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "bsd-liability": (
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "zlib-as-is": ("this software is provided as is without any express or implied warranty",),
    "zlib-liability": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib-origin": ("the origin of this software must not be misrepresented you must not claim that you wrote the original software",),
    "zlib-altered": ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",),
    "zlib-notice": ("this notice may not be removed or altered from any source distribution",),
    "bsl-1-grant": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v",),
    "mpl-2-copy": (
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    "epl-1": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    ),
    "epl-2": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    ),
    "all-rights": ("all rights reserved",),
}
#: How notices begin, and the names of licences in them, by identifier.
BEGIN = (
    "licensed under the", "released under the", "distributed under the", "available under the", "this project is licensed under the", "this work is licensed under the", "this program is licensed under the",
    "this software is licensed under the", "this software is released under the", "this file is licensed under the", "this code is licensed under the", "this library is licensed under the",
)
NAMED: dict[str, tuple[str, ...]] = {
    "mit-released": ("mit license",),
    "apache-2-licensed": ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license"),
    "gpl-3-licensed": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gplv3 license"),
    "gpl-2-licensed": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gplv2 license"),
    "lgpl-3-licensed": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0"),
    "lgpl-2-1-licensed": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"),
    "agpl-3-licensed": ("gnu affero general public license version 3", "gnu affero general public license v3 0"),
    "bsd-2-licensed": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "bsd-3-licensed": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "mpl-2-licensed": ("mozilla public license 2 0", "mozilla public license version 2 0"),
    "epl-2-licensed": ("eclipse public license 2 0", "eclipse public license version 2 0"),
    "isc-licensed": ("isc license",),
    "zlib-licensed": ("zlib license",),
    "bsl-1-licensed": ("boost software license version 1 0",),
}
#: Identifiers of the public list of licences, as they stand after "SPDX-License-Identifier:".
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "WTFPL",
)


def _spdx_id(licence: str) -> str:
    return "spdx-" + licence.lower().replace(".", "-")


SENTENCES: dict[str, tuple[str, ...]] = (
    TEXTS
    | {name: tuple(f"{begin} {named}" for begin in BEGIN for named in known) for name, known in NAMED.items()}
    | {_spdx_id(x): ("spdx license identifier " + x.lower().replace("-", " ").replace(".", " "),) for x in SPDX}
)

#: (licence, rule, sentence identifiers in order): the first rule that matches takes its sentences before later ones look.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "apache-2-text", ("apache-2-definitions", "apache-2-copyright-grant")),
    ("Apache-2.0", "apache-2-header-full", ("apache-2-licensed", "apache-2-compliance", "apache-2-copy", "as-is-distributed", "apache-2-see")),
    ("Apache-2.0", "apache-2-header", ("apache-2-licensed", "apache-2-compliance", "apache-2-copy", "as-is-distributed")),
    ("MIT", "mit-text", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", "mit-full", ("mit-grant", "mit-notice")),
    ("ISC", "isc-text", ("isc-grant", "isc-as-is", "isc-liability")),
    ("0BSD", "0bsd-text", ("0bsd-grant", "isc-as-is", "isc-liability")),
    ("ISC", "isc-grant", ("isc-grant",)),
    ("BSD-4-Clause", "bsd-4", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", "bsd-3-text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", "bsd-3", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "bsd-2-text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", "bsd-2", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Zlib", "zlib-text", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", "zlib-grant", ("zlib-grant",)),
    ("BSL-1.0", "bsl-1-text", ("bsl-1-grant",)),
    ("Unlicense", "unlicense-text", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", "unlicense-line", ("unlicense-free",)),
    ("GPL-3.0-or-later", "gpl-3-notice", ("gpl-free-software", "gpl-3-redistribute", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", "gpl-3-header", ("gpl-free-software", "gpl-3-redistribute")),
    ("GPL-2.0-or-later", "gpl-2-notice", ("gpl-free-software", "gpl-2-redistribute", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", "gpl-2-header", ("gpl-free-software", "gpl-2-redistribute")),
    ("GPL-3.0-only", "gpl-3-only-header", ("gpl-free-software", "gpl-3-only-redistribute")),
    ("GPL-2.0-only", "gpl-2-only-header", ("gpl-free-software", "gpl-2-only-redistribute")),
    ("AGPL-3.0-or-later", "agpl-3-header", ("gpl-free-software", "agpl-3-redistribute")),
    ("LGPL-3.0-or-later", "lgpl-3-header", ("lgpl-free-software", "lgpl-3-redistribute")),
    ("LGPL-3.0-or-later", "lgpl-3-program", ("gpl-free-software", "lgpl-3-redistribute")),
    ("LGPL-2.1-or-later", "lgpl-2-1-header", ("lgpl-free-software", "lgpl-2-1-redistribute")),
    ("LGPL-2.1-or-later", "lgpl-2-1-program", ("gpl-free-software", "lgpl-2-1-redistribute")),
    ("AGPL-3.0-only", "agpl-3-title", ("agpl-title-3",)),
    ("LGPL-3.0-only", "lgpl-3-title", ("lgpl-title-3",)),
    ("GPL-3.0-only", "gpl-3-title", ("gpl-title-3",)),
    ("GPL-2.0-only", "gpl-2-title", ("gpl-title-2",)),
    ("MPL-2.0", "mpl-2-header", ("mpl-2", "mpl-2-copy")),
    ("EPL-2.0", "epl-2-header", ("epl-2",)),
    ("EPL-1.0", "epl-1-header", ("epl-1",)),
    *((x, f"{_spdx_id(x)}-line", (_spdx_id(x),)) for x in SPDX),
    ("GPL-3.0-only", "gpl-3-line", ("gpl-3-licensed",)),
    ("GPL-2.0-only", "gpl-2-line", ("gpl-2-licensed",)),
    ("LGPL-3.0-only", "lgpl-3-line", ("lgpl-3-licensed",)),
    ("LGPL-2.1-only", "lgpl-2-1-line", ("lgpl-2-1-licensed",)),
    ("AGPL-3.0-only", "agpl-3-line", ("agpl-3-licensed",)),
    ("Apache-2.0", "apache-2-line", ("apache-2-licensed",)),
    ("MIT", "mit-line", ("mit-released",)),
    ("MIT", "mit-title", ("mit-title",)),
    ("BSD-2-Clause", "bsd-2-line", ("bsd-2-licensed",)),
    ("BSD-3-Clause", "bsd-3-line", ("bsd-3-licensed",)),
    ("ISC", "isc-line", ("isc-licensed",)),
    ("Zlib", "zlib-line", ("zlib-licensed",)),
    ("BSL-1.0", "bsl-1-line", ("bsl-1-licensed",)),
    ("EPL-2.0", "epl-2-line", ("epl-2-licensed",)),
    ("CC-BY-NC-4.0", "cc-by-nc-4-line", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", "cc-by-sa-4-line", ("cc-by-sa-4",)),
    ("CC-BY-4.0", "cc-by-4-line", ("cc-by-4",)),
    ("CC0-1.0", "cc0-line", ("cc0",)),
    ("MPL-2.0", "mpl-2-line", ("mpl-2",)),
    ("MPL-2.0", "mpl-2-licensed", ("mpl-2-licensed",)),
    ("LicenseRef-all-rights-reserved", "all-rights", ("all-rights",)),
)

# Sentences end at line ends, and at . ! ? ; or : before white space.
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def hints() -> list[str]:
    """A few words of which every known sentence has one, the commonest first: a text with none of them holds no sentence."""
    left, chosen = [frozenset(s.split()) for known in SENTENCES.values() for s in known], []
    while left:
        counts = Counter(w for words in left for w in words if len(w) > 2 and w not in ("the", "and", "for", "this", "under"))
        chosen.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        left = [words for words in left if chosen[-1] not in words]
    return chosen


#: In marked texts: what ends a sentence for certain; and line ends, ; and :, which may stand within one.
HARD, SOFT = "\x01", "\x02"


#: What becomes what, one after the other: comment words and numbers of list items at a line's start go, lines without words
#: and sentences' ends are HARD, other line ends, ; and : SOFT, and between words is a space.
STEPS = (
    (r"(^|\n)[^a-z0-9\n]*(?:dnl|rem)\b", "$1"),
    (r"(^|\n)[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)][ \t]+", "$1"),
    (r"\n(?:[^a-z0-9\n]*\n)+", HARD),
    (r"[.!?]" + WHITE, HARD),
    (r"[;:]" + WHITE + r"|\n", SOFT),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r"[ \x02]*\x01[ \x01\x02]*", HARD),
    (r" *\x02[ \x02]*", SOFT),
)


def marked_words(body: Column) -> Column:
    """The words of a lower-cased text, one space between them, with HARD and SOFT in place of ends."""
    marked = F.translate(body, HARD + SOFT, "  ")
    for pattern, put in STEPS:
        marked = F.regexp_replace(marked, pattern, put)
    return F.trim(marked)


def _longest_first() -> list[str]:
    return sorted((s for known in SENTENCES.values() for s in known), key=lambda s: (-len(s), s))


def known_sentences(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order: from an end to an end, over line ends if need be."""
    any_hint = "|".join(hints())
    body = ascii_lower(text)
    ids = F.create_map(*(F.lit(x) for name, known in SENTENCES.items() for s in known for x in (s, name)))
    pattern = r"(?<![^\x01\x02])(?:" + "|".join(s.replace(" ", r"[ \x02]") for s in _longest_first()) + r")(?![^\x01\x02])"
    found = F.regexp_extract_all(marked_words(body), F.lit(pattern), F.lit(0))
    return F.when(body.rlike(any_hint), F.transform(found, lambda s: ids[F.translate(s, SOFT, " ")])).otherwise(F.array().cast("array<string>"))


def match_rules(sequence: Column, rules: tuple = RULES) -> list[tuple[str, str, Column]]:
    """(licence, rule, whether it matches) for a sequence of identifiers written as <a><b>..."""
    found = []
    for licence, rule, ids in rules:
        run = "".join(f"<{i}>" for i in ids)
        found.append((licence, rule, F.contains(sequence, F.lit(run))))
        sequence = F.replace(sequence, F.lit(run), F.lit("|"))
    return found


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """doc_id, n_known, sentences, rules and licenses of each row; the lists are comma-joined.

    sentences: identifiers of the known sentences in the text's order. A sentence is compared whole, by its words, so one
    that only contains a known one does not count; it may be wrapped over lines, behind comment signs, and begin or end
    at any line end; ; and : may stand within it too, as in the GPL's headers. rules: those that match, in their order; a rule matches a run of its
    identifiers, unknown sentences between them aside, that no earlier rule has taken. licenses: theirs, sorted, each
    once. Null and empty texts have none: empty strings. Repeated rows stay, null ids too; an empty table gives no rows;
    other columns are not carried. Each row is read by itself, so nothing is shuffled.
    """
    listed = docs.select(F.col(doc_id).alias("doc_id"), known_sentences(F.coalesce(F.col(text), F.lit(""))).alias("ids"))
    matched = match_rules(F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")), rules)
    which = F.array_compact(F.array(*(F.when(hit, F.lit(rule)) for _, rule, hit in matched)))
    licences = F.array_compact(F.array(*(F.when(hit, F.lit(licence)) for licence, _, hit in matched)))
    return listed.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentences"),
        F.array_join(which, ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(licences)), ",").alias("licenses"),
    )


def scan_sql(rules: tuple = RULES) -> str:
    """The same rows in DuckDB's SQL, which finds sentences another way: it cuts texts into their parts between ends, joins
    every run of parts that no HARD end divides into words, and looks these up; of runs that overlap the first and then the
    longest counts."""
    known = ", ".join(f"('{s}', '{name}')" for name, all_of in SENTENCES.items() for s in all_of)
    most = max(len(s.split()) for all_of in SENTENCES.values() for s in all_of)
    marked = f"translate(body, '{HARD}{SOFT}', '  ')"
    for pattern, put in STEPS:
        marked = f"regexp_replace({marked}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    hits, runs = [], []
    for licence, rule, ids in rules:
        hits.append(f"WHEN '{rule}' THEN '{licence}'")
        runs.append((rule, "".join(f"<{i}>" for i in ids)))
    # One step for each rule: whether it matches, and the sequence without what it took.
    steps = ", ".join(f"('{rule}', '{run}', {i})" for i, (rule, run) in enumerate(runs, 1))
    return f"""
        WITH RECURSIVE known AS (SELECT * FROM (VALUES {known}) t(words, id)), rules AS (SELECT * FROM (VALUES {steps}) t(rule, run, i)),
        bodies AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        near AS (SELECT r, trim({marked}) AS marked FROM bodies WHERE regexp_matches(body, '{"|".join(hints())}')),
        hard AS (SELECT r, generate_subscripts(p, 1) AS h, unnest(p) AS piece FROM (SELECT r, string_split(marked, '{HARD}') AS p FROM near)),
        parts AS (SELECT r, h, string_split(piece, '{SOFT}') AS p FROM hard),
        starts AS (SELECT r, h, p, unnest(range(1, len(p) + 1)) AS a FROM parts),
        runs AS (SELECT r, h, a, b, array_to_string(p[a:b], ' ') AS words FROM (SELECT r, h, p, a, unnest(range(a, least(len(p), a + {most}) + 1)) AS b FROM starts)),
        found AS (SELECT r, h, a, max(b) AS b, arg_max(id, b) AS id FROM runs JOIN known USING (words) GROUP BY r, h, a),
        chosen AS (SELECT r, h, a, b, id FROM found f WHERE a = (SELECT min(a) FROM found g WHERE g.r = f.r AND g.h = f.h)
            UNION ALL SELECT f.r, f.h, f.a, f.b, f.id FROM chosen c JOIN found f ON f.r = c.r AND f.h = c.h AND f.a = (SELECT min(a) FROM found g WHERE g.r = c.r AND g.h = c.h AND g.a > c.b)),
        listed AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY h, a) AS ids, '<' || string_agg(id, '><' ORDER BY h, a) || '>' AS sequence FROM chosen GROUP BY r),
        taken AS (SELECT r, sequence, 0 AS i, CAST([] AS VARCHAR[]) AS hit FROM listed
            UNION ALL SELECT r, replace(sequence, run, '|'), t.i + 1, CASE WHEN contains(sequence, run) THEN list_append(hit, rule) ELSE hit END FROM taken t JOIN rules ON rules.i = t.i + 1),
        matched AS (SELECT r, hit, list_sort(list_distinct(list_transform(hit, lambda x: CASE x {" ".join(hits)} END))) AS licences FROM taken WHERE i = {len(rules)})
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentences, coalesce(array_to_string(hit, ','), '') AS rules, coalesce(array_to_string(licences, ','), '') AS licenses
        FROM bodies LEFT JOIN listed USING (r) LEFT JOIN matched USING (r)"""
