"""Licence scans by sentence rules.

A text becomes one line of normalised words (lower case for A-Z, everything but letters and digits
to one blank) in which ``/`` stands for a line break and ``|`` for a full stop, colon, semicolon,
exclamation or question mark before a blank. Comment marks fall away, so a sentence may run over
lines. Found in it, in order and with repeats, is the text's identifier sequence:

- sentences of licence texts and headers, from one mark to the next, by ``TEXTS``;
- notices (`licensed under`, `under the terms of` and the like, `is X licensed`), SPDX lines,
  `License: X` lines and titles that name a licence, by ``NAMES``. Several names joined by `or`,
  `and` or `with` give an identifier each. A notice after `not`, `never` and the like is none.

A rule matches when its identifiers occur in the sequence in a row, unknown sentences between them
ignored. Rules are tried in order; each licence is reported once.

The table is fixed, a few hundred entries made from the lists below, whatever the input. It is
folded into one pattern by shared beginnings; only what the pattern finds is looked up. All native,
in one scan without a shuffle. Texts of any length are scanned whole; lists and blanks of any length
are walked in loops, and no place is searched on for longer than a sentence's bound. Nulls: a null text has no sentences and no licences. Rows are judged
alone, so ties and repeated rows get equal results; an empty table gives no rows. Other columns play
no part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, whole

_MIT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so")
_ISC = "permission to use copy modify and {}distribute this software for any purpose with or without fee is hereby granted"
_KEPT = " provided that the above copyright notice and this permission notice appear in all copies"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
           "disclaimer in the documentation and or other materials provided with the distribution")
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"

# Signs that the words at a * may take: what bounds the search from each place.
ANY_WORDS = 600

# Sentences of licence texts, normalised, with their identifiers; * is any words of one sentence, up to ANY_WORDS signs.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    _MIT + " subject to the following conditions": "mit-grant",
    _MIT: "mit0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial "
    "portions of the software": "mit-keep",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied": "apache2-basis",
    "apache license version 2 0 january 2004": "apache2-title",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    _BSD: "bsd-grant",
    _SOURCE: "bsd-source",
    _BINARY: "bsd-binary",
    "neither the name of * nor the names of * contributors " + _ENDORSE: "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written "
    "permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertise",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed": "bsd-disclaimer",
    _ISC.format("or ") + _KEPT: "isc-grant",
    _ISC.format("") + _KEPT: "isc-grant",
    _ISC.format("or "): "0bsd-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
    "binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-preamble",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to "
    "ensure cooperation with the community in the case of network server software": "agpl3-preamble",
    "mozilla public license version 2 0": "mpl2-title",
    "this source code form is subject to the terms of the mozilla public license v | 2 0": "mpl2-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
    "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the "
    "following": "bsl1-grant",
    "boost software license version 1 0 august 17th 2003": "bsl1-title",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions": "zlib-grant",
    "do what the fuck you want to public license version 2 december 2004": "wtfpl-title",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as "
    "long as the name is changed": "wtfpl-copy",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to "
    "the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
}


def _gnu(long: str, short: str, version: str) -> list[str]:
    """Names of a version of a GNU licence, as in notices, headers and SPDX lines."""
    bare = version.removesuffix(" 0")
    says = [f"{m}{v}" for m in ("", "v", "v ", "v | ", "version ") for v in {bare, version}]
    whole_names = [f"gnu {long}", long, f"gnu {short}", short]
    out = [f"{n} {s}" for n in whole_names for s in says] + [f"{n}v{v}" for n in (short, f"gnu {short}") for v in {bare, version}]
    out += [f"{n}{v}" for n in (short, f"gnu {short}") for v in {bare, version}]
    for n in whole_names:
        out += [f"version {v} of the {n}" for v in {bare, version}]
        for stop in ("", " |"):
            out += [f"{n} as published by the free software foundation{stop} {e}version {v}" for e in ("", "either ") for v in {bare, version}]
    return out


def _versions(names: list[str], version: str) -> list[str]:
    bare = version.removesuffix(" 0")
    return [f"{n} {m}{v}" for n in names for m in ("", "v", "v ", "v | ", "version ") for v in {bare, version}]


_LESSER = ("lesser general public license", "library general public license")
_APACHE = ["apache license", "apache software license", "apache public license", "apache"]
_MOZILLA = ["mozilla public license", "mpl"]
_CC = {"by": "attribution", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by sa": "attribution sharealike",
       "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}


def _cc(kind: str) -> list[str]:
    """A Creative Commons licence without its version."""
    told = _CC[kind]
    spelled = {told, told.replace("noncommercial", "non commercial"), told.replace("noderivatives", "no derivatives"),
               told.replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives"),
               told.replace("sharealike", "share alike"), told.replace("noncommercial", "non commercial").replace("sharealike", "share alike")}
    return [f"cc {kind}", f"creative commons {kind}", *(f"creative commons {t}" for t in sorted(spelled))]


# Licence, stem of its identifiers and names. The first four stand in the order of their rules.
NAMES: dict[str, tuple[str, list[str]]] = {
    "Apache-2.0": ("apache2", _versions(_APACHE, "2 0") + ["apache2", "asl 2 0"]),
    "GPL-3.0": ("gpl3", _gnu("general public license", "gpl", "3 0")),
    "MIT": ("mit", ["mit", "mit license", "mit x11", "mit expat", "x11", "x11 license", "expat", "expat license", "mit x11 license", "mit expat license"]),
    "CC-BY-NC-4.0": ("cc-by-nc4", _versions(_cc("by nc"), "4 0") + [f"{n} license 4 0" for n in _cc("by nc")]),
    "AGPL-3.0": ("agpl3", _gnu("affero general public license", "agpl", "3 0")),
    "LGPL-3.0": ("lgpl3", _gnu(_LESSER[0], "lgpl", "3 0")),
    "LGPL-2.1": ("lgpl21", _gnu(_LESSER[0], "lgpl", "2 1")),
    "LGPL-2.0": ("lgpl2", _gnu(_LESSER[1], "lgpl", "2 0")),
    "GPL-2.0": ("gpl2", _gnu("general public license", "gpl", "2 0")),
    "GPL-1.0": ("gpl1", _gnu("general public license", "gpl", "1 0")),
    "MPL-2.0": ("mpl2", _versions(_MOZILLA, "2 0")),
    "MPL-1.1": ("mpl11", _versions(_MOZILLA, "1 1")),
    "Apache-1.1": ("apache11", _versions(_APACHE, "1 1")),
    "BSD-4-Clause": ("bsd4", ["bsd 4 clause", "4 clause bsd", "original bsd", "four clause bsd"]),
    "BSD-3-Clause": ("bsd3", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "three clause bsd", "revised bsd", "bsd 3"]),
    "BSD-2-Clause": ("bsd2", ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "two clause bsd", "bsd 2"]),
    "0BSD": ("0bsd", ["0bsd", "bsd zero clause", "zero clause bsd"]),
    "MIT-0": ("mit0", ["mit 0", "mit no attribution"]),
    "ISC": ("isc", ["isc"]),
    "Unlicense": ("unlicense", ["unlicense"]),
    "Zlib": ("zlib", ["zlib", "zlib libpng"]),
    "BSL-1.0": ("bsl1", ["bsl 1 0", *_versions(["boost software license"], "1 0"), "boost software license", "boost"]),
    "WTFPL": ("wtfpl", ["wtfpl", "do what the fuck you want to public license"]),
    "EPL-2.0": ("epl2", _versions(["eclipse public license", "epl"], "2 0")),
    "EPL-1.0": ("epl1", _versions(["eclipse public license", "epl"], "1 0")),
    "EUPL-1.2": ("eupl12", _versions(["european union public license", "european union public licence", "eupl"], "1 2")),
    "CDDL-1.0": ("cddl1", _versions(["common development and distribution license", "cddl"], "1 0")),
    "Artistic-2.0": ("artistic2", _versions(["artistic license", "artistic"], "2 0")),
    "OFL-1.1": ("ofl11", _versions(["sil open font license", "open font license", "ofl"], "1 1")),
    "CC0-1.0": ("cc0", ["cc0", *_versions(["cc0", "creative commons zero", "creative commons cc0"], "1 0"), "cc0 1 0 universal",
                        "creative commons zero", "creative commons cc0"]),
}
for _kind in _CC:
    for _v in ("4 0", "3 0", "2 5", "2 0", "1 0"):
        _licence = f"CC-{_kind.upper().replace(' ', '-')}-{_v.replace(' ', '.')}"
        _stem = f"cc-{_kind.replace(' ', '-')}{_v.replace(' ', '').removesuffix('0')}"
        NAMES.setdefault(_licence, (_stem, _versions(_cc(_kind), _v) + [f"{n} license {_v}" for n in _cc(_kind)]))
    NAMES[f"CC-{_kind.upper().replace(' ', '-')}"] = (f"cc-{_kind.replace(' ', '-')}", _cc(_kind))
# Named without a version.
NAMES |= {
    "AGPL": ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"]),
    "LGPL": ("lgpl", [f"{g}{n}" for g in ("gnu ", "") for n in (*_LESSER, "lgpl")]),
    "GPL": ("gpl", ["gnu general public license", "general public license", "gnu gpl", "gpl"]),
    "MPL": ("mpl", _MOZILLA), "Apache": ("apache", _APACHE), "EPL": ("epl", ["eclipse public license", "epl"]),
    "BSD": ("bsd", ["bsd"]), "Artistic": ("artistic", ["artistic license"]), "OFL": ("ofl", ["sil open font license", "open font license"]),
}

# Ordered rules: licence and the identifiers that must follow each other.
RULES = (
    ("Apache-2.0", ("apache2-notice", "apache2-use")),
    ("Apache-2.0", ("apache2-title",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl3-title",)), ("GPL-3.0", ("gpl3-preamble",)), ("GPL-2.0", ("gpl2-title",)),
    ("AGPL-3.0", ("agpl3-title",)), ("AGPL-3.0", ("agpl3-preamble",)), ("LGPL-3.0", ("lgpl3-title",)), ("LGPL-2.1", ("lgpl21-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("BSD-4-Clause", ("bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("MIT-0", ("mit0-grant",)), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-grant",)), ("Unlicense", ("unlicense-free",)), ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-grant",)), ("BSL-1.0", ("bsl1-title",)), ("WTFPL", ("wtfpl-title",)), ("WTFPL", ("wtfpl-copy",)), ("CC0-1.0", ("cc0-deed",)),
)
_ORDER = {licence: k for k, licence in enumerate(NAMES)}
RULES = tuple(sorted((*RULES, *((licence, (f"{stem}-notice",)) for licence, (stem, _) in NAMES.items())), key=lambda r: _ORDER[r[0]]))


_NAMED: dict[str, str] = {}
for _stem, _names in NAMES.values():
    for _name in _names:
        _NAMED.setdefault(_name.replace("licence", "license"), f"{_stem}-notice")
_GAP = r"(?: /)* "


def _pattern(keys) -> str:
    """All keys as one pattern by shared beginnings, the longest first; words may stand on several lines."""
    tree: dict = {}
    for key in keys:
        at = tree
        for w in key.split(" "):
            at = at.setdefault(w, {})
        at[""] = {}

    def say(at: dict, gap: str) -> str:
        branches = [{"*": f"[^|]{{1,{ANY_WORDS}}}?", "|": r"\|"}.get(w, w) + say(x, _GAP) for w, x in sorted(at.items()) if w]
        if not branches:
            return ""
        body = gap + (branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})")
        return f"(?:{body})?" if "" in at else body

    return say(tree, "")


def _spaced(pattern: str) -> str:
    return pattern.replace(" ", _GAP)


# Repeats of groups are possessive: they are walked in a loop, where others recurse once for each repeat.
_NAME = _pattern(_NAMED) + f"(?:{_GAP}(?:international|unported|license)(?= ))*+(?= )"
_LIST = _NAME + _spaced("(?: (?:and or|or|and|with)(?: (?:the|under)(?= ))*+ ") + _NAME + ")*+"
_TERMS = "the terms(?: and conditions)? of"
_VERB = _spaced(
    "(?:(?:licensed|released|distributed|redistributed|available|published|provided|issued|offered|shared|relicensed|covered|governed)"
    f" (?:under|by|subject to)|(?:under|subject to) {_TERMS})(?: {_TERMS})?")
_ARTICLES = _spaced(r"(?: (?:either(?: of)?|both|a|an|the|\|)(?= ))*+ ")
# No negation up to four words before a notice.
_DENIED = "(?<! (?:not|never|cannot|nor|neither|without|longer|t) " + "(?:[^ |]{1,20} )?" * 3 + ")"
_AT_START = "|".join((
    f"(?:(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}}) )?{_pattern(TEXTS)}(?= [/|])",
    rf"spdx license identifier(?: \|)? {_LIST}",
    rf"license(?: \|)?(?: osi approved)?(?: \|)? (?:{_LIST}|{_NAME})(?= [/|])",
    f"(?:the )?(?=[^/|]* license |unlicense ){_NAME}(?: mit| isc)?(?= [/|])"))
FOUND = f"(?<= )(?:(?=[acdgiloprsu])(?:(?={_VERB} ){_DENIED}{_VERB}{_ARTICLES}{_LIST}|(?:is|are) {_NAME} licensed(?= ))|(?<=[/|] )(?:{_AT_START}))"


def _line(text):
    """Words of the text between blanks, with marks for line breaks and ends of sentences."""
    x = F.translate(whole(text), UPPER + "/|\n", LOWER + ",,/")
    x = F.regexp_replace(x, r"(?<![^/])[\x20\x09]*(?:[;:!.]+|rem|dnl)(?=[\x20\x09])", "")
    x = F.regexp_replace(x, r"[.;:!?](?=[\x20\x09\r/]|$)", " | ")
    x = F.regexp_replace(F.concat(F.lit("| "), F.replace(F.replace(x, F.lit("/"), F.lit(" / ")), F.lit("licence"), F.lit("license")), F.lit(" |")), r"[^a-z0-9\x{80}-\x{10FFFF}/|]+", " ")
    return x


def _identifiers(found):
    """Identifiers of one place that FOUND has found."""
    plain = lambda key: key.replace("| ", "")
    fixed = {plain(k): own for k, own in TEXTS.items() if "*" not in k}
    names = {plain(k): own for k, own in _NAMED.items()}
    table = lambda entries: F.from_json(F.lit(json.dumps(entries)), "map<string,string>")
    x = F.regexp_replace(found, "[ /|]+", " ")
    sentence = F.regexp_replace(x, f"^(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}}) (?={_pattern(TEXTS)}$)", "")
    own = F.try_element_at(table(fixed), sentence)
    for key, name in TEXTS.items():
        if "*" in key:
            own = F.coalesce(own, F.when(sentence.rlike(f"^{key.replace('*', '.+')}$"), F.lit(name)))
    parts = F.regexp_extract_all(x, F.lit(f"(?<![^ ])(?:{_pattern(names)})(?![^ ])"), F.lit(0))
    return F.when(own.isNotNull(), F.array(own)).otherwise(F.transform(parts, lambda n: F.try_element_at(table(names), n)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, identifiers (sequence of known sentences) and licenses of every row."""
    found = F.regexp_extract_all(_line(F.col("text")), F.lit(FOUND), F.lit(0))
    places = docs.select("doc_id", found.alias("_found"))
    rows = places.select("doc_id", F.when(F.size("_found") > 0, F.flatten(F.transform("_found", _identifiers))).otherwise(
        F.array().cast("array<string>")).alias("identifiers"))
    line = F.concat(F.lit("|"), F.array_join("identifiers", "|"), F.lit("|"))
    rules = F.from_json(F.lit(json.dumps([{"licence": n, "ids": f"|{'|'.join(ids)}|"} for n, ids in RULES])), "array<struct<licence:string,ids:string>>")
    hits = F.transform(F.filter(rules, lambda r: line.contains(r["ids"])), lambda r: r["licence"])
    licenses = F.when(F.size("identifiers") > 0, F.array_distinct(hits)).otherwise(
        F.array().cast("array<string>"))
    return rows.select("doc_id", "identifiers", licenses.alias("licenses"))
