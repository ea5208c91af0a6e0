"""Operator 3: license scan by ordered signature rules, in DataFrame functions only.

Text is lower-cased (A-Z) and cut into words: runs of anything but ASCII characters other than letters and digits. Each rule is
a regex over words around one keyword. A text without any keyword is not looked at again (a null text counts as empty);
otherwise each keyword's place gets a context as wide as the longest rule, marked with @, and the rules of that keyword whose
other word the context holds are matched there. So the cost of hundreds of rules follows the keywords in a text, not its length.

Rules are ordered: a detection is suppressed if one of a rule that comes earlier contains its interval of words. Labels of the
base phrases are reported even where a longer detection suppresses them. Rules without a label ("not licensed under X") only suppress.
A + behind a digit, which is no word, is kept as a mark at the word before it ("GPL-2.0+", "GPLv2+"); it changes neither words nor places.

Results for every row: id, n_words, hits (all detections: label, start, end, order, weight, base), kept (those not suppressed),
n_base, first_word, last_word, base_labels, labels, score (largest weight of kept detections, 0 without any). Rows with null or
repeated ids are rows of their own; other columns don't matter.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands for a + at the end of a word, and where one is.
PLUS = "\ue000"
PLUSES = rf"([0-9])\+({GAP[:-1]}|$)"

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label, the words before "license", a word that they hold, the short name, versions.
FAMILIES = (
    ("apache", "apache(?: software)?", "apache", "apache", ("1.0", "1.1", "2.0")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "(?:gnu )?affero general public", "affero", "agpl", ("1.0", "3.0")),
    ("gpl", "(?:gnu )?general public", "general", "gpl", ("1.0", "2.0", "3.0")),
    ("gfdl", "(?:gnu )?free documentation", "documentation", "gfdl", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla public", "mozilla", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public", "eclipse", "epl", ("1.0", "2.0")),
    ("cddl", "common development and distribution", "distribution", "cddl", ("1.0", "1.1")),
    ("eupl", "european union public", "european", "eupl", ("1.0", "1.1", "1.2")),
    ("osl", "open software", "software", "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free", "academic", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", "artistic", "artistic", ("1.0", "2.0")),
    ("bsl", "boost software", "boost", "bsl", ("1.0",)),
    ("ofl", "(?:sil )?open font", "font", "ofl", ("1.0", "1.1")),
    ("php", "php", "php", "php", ("3.0", "3.01")),
    ("zpl", "zope public", "zope", "zpl", ("1.1", "2.0", "2.1")),
    ("lppl", "latex project public", "latex", "lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("apsl", "apple public source", "apple", "apsl", ("1.0", "1.1", "1.2", "2.0")),
    ("cpl", "common public", "common", "cpl", ("1.0",)),
    ("ecl", "educational community", "educational", "ecl", ("1.0", "2.0")),
)
# Families whose short name with a version tells them where no "license" stands.
SHORT = ("lgpl", "agpl", "gpl", "gfdl", "mpl", "epl", "cddl", "eupl", "ofl", "lppl")
# Licenses without versions: label, the words before "license", a word that they hold, the SPDX words.
PLAIN = (
    ("mit", "mit", "mit", "mit"), ("mit", "expat", "expat", None), ("x11", "x11", "x11", "x11"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd", "bsd 4 clause"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0 clause bsd|0bsd)", "bsd", "0bsd"), ("bsd", "bsd(?: style)?", "bsd", None),
    ("isc", "isc", "isc", "isc"), ("zlib", "zlib(?: libpng)?", "zlib", "zlib"), ("unlicense", None, None, "unlicense"),
    ("wtfpl", "do what the fuck you want to public", "fuck", "wtfpl"), ("openssl", "openssl", "openssl", "openssl"), ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("vim", "vim", "vim", "vim"), ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", "ncsa"), ("python", "python(?: software foundation)?", "python", "psf 2 0"),
    ("ruby", "ruby", "ruby", "ruby"), ("curl", "curl", "curl", "curl"), ("beerware", "beer ?ware", "beer", "beerware"), ("json", "json", "json", "json"), ("ms-pl", "microsoft public", "microsoft", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft", "ms rl"), ("bsl-1.1", "business source", "business", "busl 1 1"), ("sspl-1.0", "server side public", "server", "sspl 1 0"), ("elastic-2.0", "elastic", "elastic", "elastic 2 0"),
    ("ipl-1.0", "ibm public", "ibm", "ipl 1 0"), ("sleepycat", "sleepycat", "sleepycat", "sleepycat"), ("tcl", "tcl(?: tk)?", "tcl", "tcl"), ("w3c", "w3c(?: software(?: notice and)?)?", "w3c", "w3c"),
)
# Creative Commons terms (short and long) and versions.
TERMS = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Sentences of license texts and addresses: label, words before the keyword, keyword, words after it, weight.
TEXTS = (
    ("bsl-1.0", "", "permission", " is hereby granted free of charge to any person or organization obtaining a copy", 0.95),
    ("ncsa", "", "permission", " is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", 0.95),
    ("ofl", "", "permission", " is hereby granted free of charge to any person obtaining a copy of the font software", 0.95),
    ("mit", "", "permission", " is hereby granted free of charge to any person obtaining a copy(?: of this software)?", 0.95),
    ("isc", "", "permission", " to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 0.95),
    ("0bsd", "", "permission", " to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 0.95),
    ("postgresql", "", "permission", " to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 0.95),
    ("historical", "", "permission", " to use copy modify and distribute this software and its documentation for any purpose", 0.8),
    ("bsd-3-clause", "", "neither", " the names? of (?:[^ ]+ ){1,9}(?:contributors|organization) may be used to endorse or promote products derived", 0.95),
    ("bsd-4-clause", "all ", "advertising", " materials mentioning features or use of this software must display", 0.95),
    ("bsd", "", "redistribution", " and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "", "redistributions", " of source code must retain the above copyright notice", 0.8),
    ("bsd", "", "redistributions", " in binary form must reproduce the above copyright notice", 0.8),
    ("zlib", "", "altered", " source versions must be plainly marked as such", 0.95),
    ("unlicense", "this is free and ", "unencumbered", " software released into the public domain", 0.95),
    ("wtfpl", "you just do what the ", "fuck", " you want to", 0.9),
    ("beerware", "you can buy me a ", "beer", " in return", 0.95),
    ("json", "the software shall be used for good not ", "evil", "", 0.95),
    ("public-domain", "(?:released into|placed in|placed into|dedicated to|is in) the public ", "domain", "", 0.7),
    ("apache-2.0", "apache org ", "licenses", " license 2 0", 0.95),
    ("gpl-2.0", "gnu org (?:licenses|copyleft) (?:old licenses )?", "gpl", " 2 0", 0.9),
    ("gpl-3.0", "gnu org (?:licenses|copyleft) ", "gpl", " 3 0", 0.9),
    ("lgpl-2.1", "gnu org (?:licenses|copyleft) (?:old licenses )?", "lgpl", " 2 1", 0.9),
    ("lgpl-3.0", "gnu org (?:licenses|copyleft) ", "lgpl", " 3 0", 0.9),
    ("agpl-3.0", "gnu org licenses ", "agpl", " 3 0", 0.9),
    ("mit", "opensource org ", "licenses", " mit(?: license)?", 0.9),
    ("bsd-2-clause", "opensource org ", "licenses", " bsd 2 clause", 0.9),
    ("bsd-3-clause", "opensource org ", "licenses", " bsd 3 clause", 0.9),
    ("bsd", "opensource org ", "licenses", " bsd license", 0.8),
    ("isc", "opensource org ", "licenses", " isc", 0.9),
    ("apache-2.0", "opensource org ", "licenses", " apache 2 0", 0.9),
    ("bsl-1.0", "boost org ", "license", " 1 0", 0.9),
    ("cc0-1.0", "creativecommons org ", "publicdomain", " zero 1 0", 0.95),
    ("cc0-1.0", "creative commons zero v?1 0 universal(?: public domain)? ", "license", "", 0.95),
    ("cc0-1.0", "", "cc0", " 1 0(?: universal)?", 0.9),
    ("cc0-1.0", "", "cc0", "", 0.7),
    ("mpl-2.0", "this source code form is subject to the terms of the ", "mozilla", " public license v 2 0", 0.95),
    ("proprietary", "", "proprietary", " and confidential", 0.6),
    ("proprietary", "all rights reserved (?:[^ ]+ ){0,6}", "license", "", 0.5),
    ("unlicense", "(?:the )?", "unlicense", "", 0.8),
    ("wtfpl", "(?:the )?", "wtfpl", "", 0.8),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) ", "bsd", "", 0.7),
    ("bsd-3-clause", "", "bsd", " 3 clause", 0.7),
    ("bsd-2-clause", "(?:simplified|2 clause|two clause) ", "bsd", "", 0.7),
    ("bsd-2-clause", "", "bsd", " 2 clause", 0.7),
    ("bsd", "(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?", "bsd", "", 0.6),
)

LICENSE = "(?:license|licence)"
LEAD = "(?:(?:released|distributed|available|licensed|provided|covered) under (?:the |an? )?(?:(?:terms|conditions)(?: and conditions)? of (?:the |an? )?)?)?"
FSF = "(?: as published by the free software foundation)?(?: either)?"
LATER_WORDS = " (?:or|and) (?:at your option )?(?:any )?(?:later|newer|greater|higher)(?: versions?)?"
LATER = f"(?:{PLUS}|{LATER_WORDS})"
SPDX = " (?:licen[sc]e )?identifier "
# First words of identifiers that may be operands of "or" and "and".
OPERANDS = "mit|apache|[al]?gpl(?:v[123])?|mpl|epl|cddl|eupl|osl|afl|artistic|bsl|ofl|php|zpl|bsd|isc|zlib|unlicense|wtfpl|openssl|postgresql|ncsa|cc0|0bsd"
#: What follows an operand's first word up to the next operand.
REST = f"(?: v?[0-9]+)?(?: [0-9]+)?{PLUS}?(?: clause| only| or later)?(?: licen[sc]e)? (?:or|and) (?:the )?"
#: An operand that begins with a keyword.
FIRST = "(?:[al]?gpl|mpl|epl|cddl|eupl|bsd|cc0|apache [12])"
UNDER = " under (?:either )?(?:the |an? )?(?:terms of (?:the )?)?"
# Families whose version may stand before the name.
NUMBERED = ("apache", "lgpl", "agpl", "gpl", "gfdl", "mpl")


def _versions(v: str) -> tuple[tuple[str, bool], ...]:
    """Words of a version number, and whether a digit must not follow; .0 may be left out."""
    major, minor = v.split(".")
    start = f"(?: version| ver| v)? v?{major}"
    return ((f"{start} {minor}", False), (start, True)) if minor == "0" else ((f"{start} {minor}", False),)


@lru_cache(maxsize=1)
def rules() -> tuple[dict, ...]:
    """The ordered table: label, mark (how the keyword begins), need (a word the context must hold), pattern, weight, base.

    ``last`` is true where no one-digit number may follow.
    """
    out: list[dict] = []

    def add(label: str, before: str, anchor: str, after: str, need: str, weight: float, base: bool = False, last: bool = False) -> None:
        mark = "@licen" if anchor == LICENSE else f"@{anchor}" if anchor.isalnum() else "@"
        out.append({"label": label, "mark": mark, "need": need, "core": f"{before}@{anchor}{after}", "last": last, "pattern": f"(?<= ){before}@{anchor}{after}(?= {'(?:[^0-9]|[1-9][0-9]|$)' if last else ''})", "weight": weight, "base": base})

    denied = f"(?:licen[sc]e|{OPERANDS})(?: version)?(?: v?[0-9]+)?(?: [0-9]+)?{PLUS}?"
    add("", "not ", "licensed", f" under (?:[^ ]+ ){{0,5}}?{denied}", "not", 0.0)
    for label, _, _, short, versions in FAMILIES:  # SPDX lines
        for v in versions:
            spdx = f"{SPDX}{short} {v.replace('.', ' ')}"
            add(f"{label}-{v}-or-later", "", "spdx", f"{spdx}(?: or later|{PLUS})", short, 1.0)
            add(f"{label}-{v}", "", "spdx", f"{spdx}(?: only)?", short, 1.0)
    for label, _, _, spdx in PLAIN:
        if spdx:
            add(label, "", "spdx", f"{SPDX}{spdx}", spdx.split()[0], 1.0)
    for short, _ in TERMS:
        for v in CC_VERSIONS:
            add(f"cc-{short}-{v}", "", "spdx", f"{SPDX}cc {short.replace('-', ' ')} {v.replace('.', ' ')}", " cc ", 1.0)
    add("cc0-1.0", "", "spdx", f"{SPDX}cc0 1 0", "cc0", 1.0)
    for label, before, anchor, after, weight in TEXTS[:8]:  # whole sentences, longer than any name in them
        add(label, before, anchor, after, "granted" if "granted" in after else "documentation", weight)
    for label, name, need, _, versions in FAMILIES:  # named with a version; longer numbers first
        for v in versions:
            for number, _ in _versions(v):
                add(f"{label}-{v}-or-later", f"{LEAD}(?:the )?{name} ", LICENSE, f"{FSF}{number}(?: of the {LICENSE})?{LATER}", need, 0.95)
                add(f"{label}-{v}-or-later", f"{LEAD}(?:the )?{name}{number}{LATER} ", LICENSE, "", need, 0.95)
        if label in NUMBERED:
            for later in (True, False):
                for v in versions:
                    for number, _ in _versions(v):
                        before = f"(?:either )?{number[len('(?: version| ver| v)? '):].replace('v?', 'version ', 1)}"
                        if later:
                            add(f"{label}-{v}-or-later", f"{before} of the {name} ", LICENSE, LATER_WORDS, need, 0.95)
                            add(f"{label}-{v}-or-later", f"{before}{LATER} of the {name} ", LICENSE, "", need, 0.95)
                        else:
                            add(f"{label}-{v}", f"{before} of the {name} ", LICENSE, "", need, 0.95)
        for last in (False, True):
            for v in versions:
                for number, end in _versions(v):
                    if end is last:
                        add(f"{label}-{v}", f"{LEAD}(?:the )?{name} ", LICENSE, f"{FSF}{number}(?: only)?", need, 0.95, last=last)
                        add(f"{label}-{v}", f"{LEAD}(?:the )?{name}{number} ", LICENSE, "", need, 0.9)
    for short, long in TERMS:
        for v in CC_VERSIONS:
            number = v.replace(".", " ")
            add(f"cc-{short}-{v}", LEAD, "cc", f" {short.replace('-', ' ')} {number}(?: licen[sc]e)?", short.split("-")[-1], 0.9)
            add(f"cc-{short}-{v}", f"{LEAD}creative commons {long} {number}(?: international| unported| generic)?(?: public)? ", LICENSE, "", "commons", 0.95)
            add(f"cc-{short}-{v}", "creativecommons org ", "licenses", f" {short.replace('-', ' ')} {number}", "creativecommons", 0.95)
    for label, before, anchor, after, weight in TEXTS[8:]:
        words = f" {before} {after} ".replace("(?:", "(").split()
        add(label, before, LICENSE if anchor == "license" else anchor, after, max((w for w in words if w.isalnum()), key=len, default=""), weight)
    for label, _, _, short, versions in FAMILIES:  # short names
        if short in SHORT:
            for v in versions:
                for number, _ in _versions(v):
                    add(f"{label}-{v}-or-later", f"{LEAD}(?:gnu )?", short, f"(?: {LICENSE})?{number}{LATER}", "", 0.85)
            for last in (False, True):
                for v in versions:
                    for number, end in _versions(v):
                        if end is last:
                            add(f"{label}-{v}", f"{LEAD}(?:gnu )?", short, f"(?: {LICENSE})?{number}", "", 0.85, last=last)
            if short.endswith("gpl"):
                add(label, f"{LEAD}(?:gnu )?", short, f"(?: {LICENSE})?", "", 0.6)
    for label, name, need, spdx in PLAIN:
        if name:
            add(label, f"{LEAD}(?:the )?{name} ", LICENSE, "", need, 0.9)
        if spdx:
            add(label, "", LICENSE, f" {spdx}", spdx.split()[0], 0.7)
    for label, _, _, short, versions in FAMILIES:
        for v in versions:
            add(f"{label}-{v}", "", LICENSE, f" {short} {v.replace('.', ' ')}", f" {short} ", 0.8)
    for short, long in reversed(TERMS):  # more terms first
        add(f"cc-{short}", f"{LEAD}creative commons {long} ", LICENSE, "", "commons", 0.8)
        add(f"cc-{short}", LEAD, "cc", f" {short.replace('-', ' ')}", short.split("-")[-1], 0.6)
    add("cc", f"{LEAD}creative commons ", LICENSE, "", "commons", 0.6)
    for label, name, need, _, _ in FAMILIES:
        add(label, f"{LEAD}(?:the )?{name} ", LICENSE, "", need, 0.7)
    for phrase, label in BASE:
        before, _, anchor = phrase.rpartition(" ")
        add(label, f"{before} ", anchor, "", before.split()[0], 0.7, True)
    for label, _, _, short, versions in FAMILIES[:1]:  # bare identifiers
        for v in versions:
            number = f" v?{v.replace('.', ' ')}"
            add(f"{label}-{v}", f"{LEAD}(?:the )?", short, f"(?: software)?{number}", "", 0.6)
    add("mulanpsl-2.0", f"{LEAD}(?:the )?mulan ", "psl", "(?: v)? v?2(?: 0)?", "mulan", 0.85)
    add("mulanpsl-2.0", f"{LEAD}(?:the )?", "mulanpsl", " 2 0", "", 0.85)
    add("public-domain", "public ", "domain", "", "public", 0.4)
    ids = [(label, spdx) for label, _, _, spdx in PLAIN if spdx and label != "json"]
    ids += [(f"{label}-{v}", f"{short} {v.replace('.', ' ')}") for label, _, _, short, versions in FAMILIES if short not in SHORT and label != "apache" for v in versions]
    for label, spdx in ids:  # "licensed under X", "X licensed", operands behind the first
        need = f" {spdx.split()[0]} "
        add(label, "", "licensed", f"{UNDER}{spdx}", need, 0.7)
        add(label, f"{spdx} ", "licensed", "", need, 0.7)
        add(label, "", f"(?:spdx{SPDX}(?:{OPERANDS})|licensed{UNDER}(?:{OPERANDS})|{FIRST})", f"{REST}(?:(?:{OPERANDS}){REST})?{spdx}", need, 0.7)
    add("apache", "", "licensed", f"{UNDER}apache", " apache ", 0.6)
    add("apache", "apache ", "licensed", "", " apache ", 0.6)
    for label in ("mit", "isc", "zlib"):  # a first operand that is no keyword
        add(label, f"{label} (?:or|and) (?:the )?", FIRST, "", f" {label} ", 0.6)
    other = "(?:(?:[^u ]|u[^n ]|un[^d ])[^ ]*|un?) "  # no second "under"
    add("unknown", f"(?:released|distributed|available|licensed) under (?:{other}){{0,6}}", LICENSE, "", "under", 0.4)
    add("unknown", "", "licensed", " under", "under", 0.3)
    return tuple(out)


def _reach(core: str) -> int:
    """The most words that a rule takes on one side of its keyword; words of all alternatives count."""
    sides = re.sub(r"\(\?:\[\^ \]\+ \)\{\d,(\d)\}", lambda m: " " * int(m[1]), core).split("@")
    return max(side.count(" ") for side in sides)


#: Words of context on either side of a keyword: what the longest rule takes and the word after it.
REACH = max(_reach(r["core"]) for r in rules()) + 1

#: What marks a keyword among the words.
KEYWORD = (
    rf"^(?:licen[cs]e|licensed|licenses|spdx|apache|psl|mulanpsl|cc0?|[al]?gpl|[al]?gplv[123]{PLUS}?|gfdl|mpl|epl|cddl|eupl|ofl|lppl|permission|neither|advertising|redistributions?|altered|unencumbered"
    r"|fuck|beer|evil|domain|publicdomain|mozilla|proprietary|unlicense|wtfpl|bsd)$"
)
#: A text without any of these has no keyword of a rule; those of the second list must also stand as GATE has them.
HINTS = ("license", "licence", "spdx", "gpl", "gfdl", "cddl", "eupl", "lppl", "wtfpl", "publicdomain", "unencumbered", "proprietary", "redistribution", "mulan")
FAINT_HINTS = ("cc", "apache", "mpl", "epl", "ofl", "bsd", "permission", "neither", "advertising", "altered", "fuck", "beer", "evil", "domain")
GATE = (
    r"(?<![0-9a-z])(?:apache(?:[^0-9a-z]+software)?[^0-9a-z]+v?[12])|(?<![0-9a-z])(?:cc0?|mpl|epl|ofl|bsd)(?![0-9a-z])|permission[^0-9a-z]+(?:is|to)[^0-9a-z]|neither[^0-9a-z]+the[^0-9a-z]+name|advertising[^0-9a-z]+materials"
    r"|altered[^0-9a-z]+source|the[^0-9a-z]+fuck|a[^0-9a-z]+beer|not[^0-9a-z]+evil|public[^0-9a-z]+domain"
)


def _promising(text: Column) -> Column:
    def check(low: Column) -> Column:
        some = lambda hints: reduce(or_, (F.contains(low, F.lit(h)) for h in hints))
        return some(HINTS) | (some(FAINT_HINTS) & low.rlike(GATE))

    return F.exists(F.array(F.lower(text)), check)


def _rule_table() -> Column:
    """The rules as one constant array."""
    own = [{k: v for k, v in r.items() if k not in ("core", "last")} | {"order": i} for i, r in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(own)), "array<struct<label:string,mark:string,need:string,pattern:string,weight:double,base:boolean,order:int>>")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``; see above."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm = F.translate(F.regexp_replace(F.regexp_replace("text", PLUSES, f"$1{PLUS}$2"), GAP, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.when(_promising(F.col("text")), F.split(F.trim(norm), " "))
    out = own.select("id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), words.alias("words"))
    # gplv3 and the like count as gpl v3; places stay those of the words
    place = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(KEYWORD), i)), lambda i: i.isNotNull())
    out = out.withColumn("places", F.coalesce(place, F.array().cast("array<int>")))
    context = F.transform(
        "places",
        lambda i: F.concat(
            F.lit(" "),
            F.when(i > 0, F.concat(F.array_join(F.slice("words", F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), " "), F.lit(" "))).otherwise(""),
            F.lit("@"),
            F.regexp_replace(F.array_join(F.slice("words", i + 1, REACH + 1), " "), "^([al]?gpl)(v[123])", "$1 $2"),
            F.lit(" "),
        ),
    )
    glued = F.transform("places", lambda i: F.get("words", i).rlike(f"v[123]{PLUS}?$"))
    out = out.select("id", "n_words", F.arrays_zip(F.col("places").alias("place"), context.alias("text"), glued.alias("glued")).alias("contexts"), _rule_table().alias("rules"))

    def detections(c: Column) -> Column:
        hit = F.filter("rules", lambda r: F.contains(c["text"], r["mark"]) & F.contains(c["text"], r["need"]) & F.rlike(c["text"], r["pattern"]))

        def span(r: Column) -> Column:
            found = F.regexp_substr(c["text"], r["pattern"])
            before = F.substring_index(found, "@", 1)
            # a short name that was cut in two for its context is still one word
            glued = F.when(c["glued"] & F.contains(found, F.lit("gpl v")), 1).otherwise(0)
            start = c["place"] - _spaces(before)
            return F.struct(r["label"].alias("label"), start.alias("start"), (start + _spaces(found) + 1 - glued).alias("end"), r["order"].alias("order"), r["weight"].alias("weight"), r["base"].alias("base"))

        return F.transform(hit, span)

    out = out.select("id", "n_words", F.transform("contexts", detections).alias("by_place"))
    near = 2 * REACH + 1

    def surviving(own: Column, k: Column) -> Column:
        low = F.greatest(k - near, F.lit(0))
        others = F.flatten(F.slice("by_place", low + 1, F.lit(2 * near + 1)))
        return F.filter(own, lambda h: ~F.exists(others, lambda g: (g["order"] < h["order"]) & (g["start"] <= h["start"]) & (g["end"] >= h["end"])))

    out = out.withColumn("kept", F.flatten(F.transform("by_place", surviving))).withColumn("hits", F.flatten("by_place")).drop("by_place")
    base = F.filter("hits", lambda h: h["base"])
    out = out.withColumn("base", base)
    starts = F.transform("base", lambda h: h["start"].cast("long"))
    labels = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda h: h["label"])))
    return out.select(
        "id", "n_words", "hits", "kept", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), F.array_sort(F.array_remove(F.array_union(labels("base"), labels("kept")), "")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda h: h["weight"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same scan as SQL for DuckDB over ``documents``: the rules as a table joined with the marked contexts."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    whole = lambda r: f" ({r['core']}) {'(?:[^0-9]|[1-9][0-9]|$)' if r['last'] else ''}"
    table = ", ".join(f"({i}, {quote(r['label'])}, {quote(r['mark'])}, {quote(r['need'])}, {quote(whole(r))}, {r['weight']}, {str(r['base']).lower()})" for i, r in enumerate(rules()))
    return rf"""
        WITH rules(ord, label, mark, need, pattern, weight, base) AS (VALUES {table}),
        w AS (SELECT doc_id, regexp_extract_all(translate(regexp_replace(coalesce(text, ''), {quote(PLUSES)}, '\1{PLUS}\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(list_filter(range(1, len(ws) + 1), lambda i: regexp_matches(ws[i], {quote(KEYWORD)}))) AS i FROM w),
        c AS (SELECT doc_id, i - 1 AS place, regexp_matches(ws[i], 'v[123]{PLUS}?$') AS glued, ' ' || CASE WHEN i > 1 THEN array_to_string(ws[greatest(i - {REACH}, 1):i - 1], ' ') || ' ' ELSE '' END || '@'
          || regexp_replace(array_to_string(ws[i:i + {REACH}], ' '), '^([al]?gpl)(v[123])', '\1 \2') || ' ' AS ctx FROM p),
        m AS (SELECT doc_id, place, glued, r.*, regexp_extract(ctx, r.pattern, 1) AS hit FROM c JOIN rules r ON contains(ctx, mark) AND contains(ctx, need) AND regexp_matches(ctx, r.pattern)),
        h AS (SELECT *, place - (length(split_part(hit, '@', 1)) - length(replace(split_part(hit, '@', 1), ' ', ''))) AS s, length(hit) - length(replace(hit, ' ', '')) + 1
          - CASE WHEN glued AND contains(hit, 'gpl v') THEN 1 ELSE 0 END AS size FROM m),
        k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND g.ord < h.ord AND g.s <= h.s AND g.s + g.size >= h.s + h.size)),
        b AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h WHERE base GROUP BY doc_id),
        l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h WHERE base UNION SELECT doc_id, label FROM k WHERE label <> '') GROUP BY doc_id),
        x AS (SELECT doc_id, CAST(max(weight) AS DOUBLE) AS score FROM k GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id)"""
