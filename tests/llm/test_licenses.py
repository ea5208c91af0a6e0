"""License scan against a plain reading of base phrases, and rule order."""

import random
import re

from notices import NOTICES

from siftwell.llm import licenses as li
from siftwell.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, places, labels = WORD.findall(low), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.id: r for r in li.scan(df).collect()}


def test_base_phrases(spark):
    rng = random.Random(1)
    bag = ["MIT", "License", "license,", "apache", "general", "PUBLIC", "gnu", "é", "İ", "mıt", "x`y", "licence", "mit license", "v2", "2.0", "\x00", "K", "cc", "gplv3"]
    rows = [(i, rng.choice((" ", "\n", "--")).join(rng.choice(bag) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "license"), (903, "mit license " * 3000), (904, "word " * 20000 + "Apache License")]
    got = scanned(spark, rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == plain(t), t
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1


def test_rules_in_order(spark):
    cases = {
        1: ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
        2: ("licensed under the GNU General Public License, version 3 or any later version", {"gpl", "gpl-3.0-or-later"}),
        3: ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
        4: ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        5: ("GNU Lesser General Public License v2.1", {"gpl", "lgpl-2.1"}),
        6: ("This is gplv3 code", {"gpl-3.0"}),
        7: ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
        8: ("Released under the MIT License.", {"mit"}),
        9: ("nothing of the kind", set()),
        10: ("3-clause BSD license", {"bsd-3-clause"}),
    }
    got = scanned(spark, [(i, t) for i, (t, _) in cases.items()])
    for i, (t, want) in cases.items():
        assert want <= set(got[i].labels), (t, got[i].labels)
    assert "bsd" not in got[10].labels  # contained in the interval of an earlier rule
    assert "cc-by-nc" not in got[4].labels
    assert len(li.rules()) > 200


def test_nulls_and_table(spark):
    df = spark.createDataFrame([(None, "MIT license", 1), (7, None, 2), (7, "x", 3)], "doc_id long, text string, words int")
    assert sorted((r.id or 0, r.n_base) for r in li.scan(df).collect()) == [(0, 1), (7, 0), (7, 0)]
    assert li.scan(df.where("false")).count() == 0
    out = queries.op3_license_scan(spark, "/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in out.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])


def longest(tree):
    """Most spaces that a parsed regex takes."""
    total = 0
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            total += arg == 32
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            own = longest(arg[2])
            total += own and int(arg[1]) * own
        elif name == "SUBPATTERN":
            total += longest(arg[-1])
        elif name == "BRANCH":
            total += max(map(longest, arg[1]))
    return total


def test_context_holds_every_rule():
    for r in li.rules():
        assert max(longest(re._parser.parse(x)) for x in r["core"].split("@")) < li.REACH, r


def test_standard_headers(spark):
    later = "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    start = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    cases = {
        1: ("General Public", "3", "gpl-3.0"), 2: ("General Public", "2", "gpl-2.0"), 3: ("Lesser General Public", "3", "lgpl-3.0"), 4: ("Lesser General Public", "2.1", "lgpl-2.1"),
        5: ("Library General Public", "2", "lgpl-2.0"), 6: ("Affero General Public", "3", "agpl-3.0"),
    }
    got = scanned(spark, [(i, f"{start}{name} {later.format(v)} It comes without any warranty.") for i, (name, v, _) in cases.items()])
    for i, (_, _, label) in cases.items():
        assert f"{label}-or-later" in got[i].labels and label not in got[i].labels, got[i].labels


def sample(tree, pick):
    """A text that a parsed regex matches; ``pick`` chooses among alternatives and counts."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, first = arg[0]
            out += "x" if str(kind) == "NEGATE" else chr(first[0] if str(kind) == "RANGE" else first)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(arg[2], pick) for _ in range(pick((arg[0], min(int(arg[1]), arg[0] + 2)))))
        elif name == "SUBPATTERN":
            out += sample(arg[-1], pick)
        elif name == "BRANCH":
            out += sample(pick(arg[1]), pick)
        else:
            raise AssertionError(name)
    return out


def test_notices_by_hand(spark):
    got = scanned(spark, [(i, t) for i, (t, _) in enumerate(NOTICES)])
    wrong = [(t, want, ",".join(got[i].labels)) for i, (t, want) in enumerate(NOTICES) if ",".join(got[i].labels) != want]
    assert len(NOTICES) > 100 and not wrong, wrong


def test_no_rule_is_dead(spark):
    """Shortest and longest readings of every rule, between other words, are detections of that rule over just those words."""
    rows, want = [], {}
    for order, r in enumerate(li.rules()):
        for k, pick in enumerate((lambda x: x[0], lambda x: x[-1])):
            words = sample(re._parser.parse(r["core"]), pick).replace("@", "").split()
            rows.append((2 * order + k, f"so {' '.join(words)} end"))
            want[2 * order + k] = (order, 1, 1 + len(words))
    got = scanned(spark, rows)
    dead = [(li.rules()[o], dict(rows)[i]) for i, (o, s, e) in want.items() if (o, s, e) not in {(h.order, h.start, h.end) for h in got[i].hits}]
    assert not dead, dead[:5]
