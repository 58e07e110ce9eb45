"""Licence scan by sentences: known sentences become identifiers, ordered rules match their sequences.

A text is cut into sentences; a sentence in normal form (lower case, letters and digits only) is
looked up in a fixed table.  The identifiers of a document, in order, with a break wherever other
sentences stand between, are matched against rules in the order of the rule list at every place,
so a whole licence text wins over its first sentence.  Only built-in functions are used, nothing is
shuffled, and the table is a literal of a few dozen entries.

Defined cases: null and empty texts match nothing; each row is scanned by itself, so null and
repeated ids are allowed and repeated rows give one result each; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import keyed

# Sentences of public licences, in normal form.
SENTENCES = {
    "a1": "licensed under the apache license version 2 0",
    "a2": "licensed under the apache license version 2 0 the license",
    "a3": "you may not use this file except in compliance with the license",
    "a4": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "a5": "unless required by applicable law or agreed to in writing software distributed under the license is "
          "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "a6": "see the license for the specific language governing permissions and limitations under the license",
    "m1": "released under the mit license",
    "m2": "licensed under the mit license",
    "m3": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
          "documentation files the software to deal in the software without restriction including without limitation "
          "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
          "permit persons to whom the software is furnished to do so subject to the following conditions",
    "m4": "the above copyright notice and this permission notice shall be included in all copies or substantial "
          "portions of the software",
    "m5": "the software is provided as is without warranty of any kind express or implied including but not limited to "
          "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "g1": "this work is licensed under the gnu general public license version 3",
    "g2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
          "public license as published by the free software foundation either version 3 of the license or at your "
          "option any later version",
    "g3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
          "public license as published by the free software foundation either version 2 of the license or at your "
          "option any later version",
    "g4": "this program is distributed in the hope that it will be useful but without any warranty without even the "
          "implied warranty of merchantability or fitness for a particular purpose",
    "g5": "see the gnu general public license for more details",
    "c1": "licensed under cc by nc 4 0",
    "c2": "licensed under cc by 4 0",
    "c3": "licensed under cc by sa 4 0",
    "c4": "this work is licensed under a creative commons attribution 4 0 international license",
    "b1": "redistribution and use in source and binary forms with or without modification are permitted provided that "
          "the following conditions are met",
    "r1": "all rights reserved",
}
# Pieces of the unchanged public notices, as the splitter cuts them: at ``: `` and ``; ``, not after an address.
_SHARE, _BY = "you can redistribute it and or modify it under the terms of the gnu ", "as published by the free software foundation"
_LATER = " of the license or at your option any later version"
SENTENCES |= {
    "a7": f"{SENTENCES['a4']} {SENTENCES['a5']}",
    "a8": f"{SENTENCES['a4']} {SENTENCES['a5']}".replace("http www", "https www"),
    "h1": f"{_SHARE}general public license {_BY}", "h2": f"{_SHARE}lesser general public license {_BY}",
    "h3": f"{_SHARE}affero general public license {_BY}",
    "i1": f"either version 2{_LATER}", "i2": f"either version 2 1{_LATER}", "i3": f"either version 3{_LATER}",
    "j1": f"{_SHARE}general public license {_BY} either version 2{_LATER}",
    "j2": f"{_SHARE}general public license {_BY} either version 3{_LATER}",
    "j3": f"{_SHARE}lesser general public license {_BY} either version 2 1{_LATER}",
    "j4": f"{_SHARE}lesser general public license {_BY} either version 3{_LATER}",
    "j5": f"{_SHARE}affero general public license {_BY} either version 3{_LATER}",
    "k1": "this program is distributed in the hope that it will be useful but without any warranty",
    "k2": "this library is distributed in the hope that it will be useful but without any warranty",
    "k3": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "k4": "see the gnu lesser general public license for more details",
    "k5": "see the gnu affero general public license for more details",
    "b2": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
          "disclaimer",
    "b3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
          "following disclaimer in the documentation and or other materials provided with the distribution",
    "b4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission",
    "s1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
          "granted provided that the above copyright notice and this permission notice appear in all copies",
    "p1": "this source code form is subject to the terms of the mozilla public license v",
}
# Rule, and the sentences that it needs one after the other; the first rule that fits wins.
RULES = (
    ("apache-2.0-notice", "a2,a3,a4,a5,a6"), ("mit-text", "m3,m4,m5"), ("gpl-3.0-or-later-notice", "g2,g4,g5"),
    ("gpl-2.0-or-later-notice", "g3,g4,g5"), ("apache-2.0", "a1"), ("apache-2.0", "a2"), ("mit", "m1"), ("mit", "m2"),
    ("mit", "m3"), ("gpl-3.0", "g1"), ("gpl-3.0-or-later", "g2"), ("gpl-2.0-or-later", "g3"), ("cc-by-nc-4.0", "c1"),
    ("cc-by-4.0", "c2"), ("cc-by-sa-4.0", "c3"), ("cc-by-4.0", "c4"), ("bsd", "b1"), ("all-rights-reserved", "r1"),
)
_GNU = (("gpl-3.0-or-later", ("j2", "h1,i3"), "k1", "g5"), ("gpl-2.0-or-later", ("j1", "h1,i1"), "k1", "g5"),
        ("lgpl-2.1-or-later", ("j3", "h2,i2"), "k2", "k4"), ("lgpl-3.0-or-later", ("j4", "h2,i3"), "k2", "k4"),
        ("agpl-3.0-or-later", ("j5", "h3,i3"), "k1", "k5"))
RULES = (
    ("apache-2.0-notice", "a2,a3,a7,a6"), ("apache-2.0-notice", "a2,a3,a8,a6"),
    *[(f"{rule}-notice", f"{grant},{hope},k3,{see}") for rule, grants, hope, see in _GNU for grant in grants],
    ("bsd-3-clause", "b1,b2,b3,b4"), ("bsd-2-clause", "b1,b2,b3"), *RULES,
    *[(rule, grant) for rule, grants, _, _ in _GNU for grant in grants], ("isc", "s1"), ("mpl-2.0", "p1"),
)
STOPS = r"[.!?;:]+[\x20\t]+"
LINES = r"\n+|" + STOPS
ORDER = "(?:" + "|".join(dict.fromkeys(needs for _, needs in RULES)) + ")"
HINT = "licen|rights reserved|permission|redistribut|free software"  # every rule has one of them
# Shorter pieces are no known sentence; they neither match nor break a sequence.
LEAST = min(map(len, SENTENCES.values()))


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _sequence(text: Column, cut: str) -> Column:
    """Identifiers of the sentences in order; ``-`` for a sentence that is not known."""
    known = F.create_map(*[F.lit(x) for key, sentence in SENTENCES.items() for x in (sentence, key)])
    parts = F.filter(F.split(text, cut, -1), lambda s: F.length(s) >= LEAST)
    return F.array_join(F.transform(parts, lambda s: F.coalesce(F.try_element_at(known, normal_form(s)), F.lit("-"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a licence: ``doc_id`` and its distinct ``rules``, first those found over line ends.

    Sentences are read twice: over line ends, as licence texts are wrapped, and line by line, as a
    notice may stand under text without a full stop.
    """
    rows = keyed(docs, id_col, text_col).filter(F.lower("text").rlike(HINT)).select(
        "doc_id", _sequence(F.replace("text", F.lit("\n"), F.lit(" ")), STOPS).alias("_over"),
        _sequence(F.col("text"), LINES).alias("_lines"))
    names = F.create_map(*[F.lit(x) for rule, needs in RULES for x in (needs, rule)])
    found = F.concat(*[F.regexp_extract_all(c, F.lit(ORDER), F.lit(0)) for c in ("_over", "_lines")])
    rules = F.array_distinct(F.transform(found, lambda f: F.try_element_at(names, f)))
    return rows.select("doc_id", rules.alias("rules")).filter(F.size("rules") > 0)
