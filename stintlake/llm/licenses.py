"""License scans by ordered signature rules, in DataFrame functions only.

A rule is tried only on texts that hold one of its keywords, and keywords only on texts that hold
one of a few stems. Every alternative of a rule holds a keyword and every match a stem, so neither
drops a match. Detections are intervals; one that lies inside another of a higher rank is
suppressed.
"""

import json
from dataclasses import dataclass
from functools import reduce
from itertools import count, groupby
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import let, table

#: A word: digits, letters A-Z in either case, and all characters beyond ASCII.
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Names of licenses: label, keywords (every way to write the name holds one of them), and how the
# name is written in lower case with single spaces. Each gives a rule for every way in WAYS to
# state a license.
NAMES = """
mit | mit,expat | (?:the )?(?:mit|expat)(?: \\(expat\\))?
mit-0 | mit no attribution,mit-0 | mit no attribution|mit-0
apache-2.0 | apache | apache(?: software)? licen[cs]e,?(?: version| v\\.?)? ?2(?:\\.0)?|apache-2\\.0|apache 2(?:\\.0)?
apache-1.1 | apache | apache(?: software)? licen[cs]e,?(?: version| v\\.?)? ?1\\.1|apache-1\\.1
apache-1.0 | apache | apache(?: software)? licen[cs]e,?(?: version| v\\.?)? ?1\\.0|apache-1\\.0
apache-any | apache | apache(?: software)? licen[cs]e
gpl-1.0 | gpl,general public licen | (?:gnu )?(?:gpl|general public licen[cs]e),?(?: version| v\\.?)? ?1(?:\\.0)?|gplv1
gpl-2.0 | gpl,general public licen | (?:gnu )?(?:gpl|general public licen[cs]e),?(?: version| v\\.?)? ?2(?:\\.0)?|gplv2
gpl-3.0 | gpl,general public licen | (?:gnu )?(?:gpl|general public licen[cs]e),?(?: version| v\\.?)? ?3(?:\\.0)?|gplv3
gpl-any | gpl,general public licen | gnu gpl|gnu general public licen[cs]e
lgpl-2.0 | lgpl,general public licen | (?:gnu )?(?:lgpl|(?:library|lesser) general public licen[cs]e),?(?: version| v\\.?)? ?2\\.0
lgpl-2.1 | lgpl,general public licen | (?:gnu )?(?:lgpl|lesser general public licen[cs]e),?(?: version| v\\.?)? ?2\\.1|lgplv2\\.1
lgpl-3.0 | lgpl,general public licen | (?:gnu )?(?:lgpl|lesser general public licen[cs]e),?(?: version| v\\.?)? ?3(?:\\.0)?|lgplv3
lgpl-any | lgpl,general public licen | gnu lgpl|gnu (?:library|lesser) general public licen[cs]e
agpl-3.0 | agpl,affero | (?:gnu )?(?:agpl|affero general public licen[cs]e),?(?: version| v\\.?)? ?3(?:\\.0)?|agplv3
agpl-any | agpl,affero | gnu agpl|(?:gnu )?affero general public licen[cs]e
gfdl-1.1 | free documentation | gnu free documentation licen[cs]e,?(?: version)? 1\\.1
gfdl-1.2 | free documentation | gnu free documentation licen[cs]e,?(?: version)? 1\\.2
gfdl-1.3 | free documentation | gnu free documentation licen[cs]e,?(?: version)? 1\\.3
gfdl-any | free documentation | gnu free documentation licen[cs]e
bsd-2-clause | bsd | (?:simplified |freebsd |2-clause |two-clause )bsd|bsd[- ]2(?:-clause)?
bsd-3-clause | bsd | (?:new |modified |revised |3-clause |three-clause )bsd|bsd[- ]3(?:-clause)?
bsd-4-clause | bsd | (?:original |4-clause |four-clause )bsd|bsd[- ]4(?:-clause)?
bsd-any | bsd | bsd(?:-style)?
0bsd | 0bsd,zero-clause | 0bsd|zero-clause bsd
isc | isc | isc
mpl-1.0 | mpl,mozilla | (?:mpl|mozilla public licen[cs]e),?(?: version| v\\.?)? ?1\\.0
mpl-1.1 | mpl,mozilla | (?:mpl|mozilla public licen[cs]e),?(?: version| v\\.?)? ?1\\.1
mpl-2.0 | mpl,mozilla | (?:mpl|mozilla public licen[cs]e),?(?: version| v\\.?)? ?2(?:\\.0)?
mpl-any | mozilla | mozilla public licen[cs]e
epl-1.0 | epl,eclipse | (?:epl|eclipse public licen[cs]e)(?: -|,)?(?: version| v\\.?)? ?1\\.0
epl-2.0 | epl,eclipse | (?:epl|eclipse public licen[cs]e)(?: -|,)?(?: version| v\\.?)? ?2\\.0
epl-any | eclipse | eclipse public licen[cs]e
cddl-1.0 | cddl,common development | (?:cddl|common development and distribution licen[cs]e),?(?: version| v\\.?)? ?1\\.0
cddl-1.1 | cddl,common development | (?:cddl|common development and distribution licen[cs]e),?(?: version| v\\.?)? ?1\\.1
cpl-1.0 | common public | common public licen[cs]e(?:,? version)?(?: 1\\.0)?
eupl-1.1 | eupl,european union | (?:eupl|european union public licen[cs]e),?(?: version| v\\.?)? ?1\\.1
eupl-1.2 | eupl,european union | (?:eupl|european union public licen[cs]e),?(?: version| v\\.?)? ?1\\.2
artistic-1.0 | artistic | artistic licen[cs]e,?(?: version)? 1\\.0
artistic-2.0 | artistic | artistic licen[cs]e,?(?: version)? 2\\.0
artistic-any | artistic | artistic licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e(?:,? version)?(?: 1\\.0)?
zlib | zlib | zlib(?:/libpng)?
libpng | libpng | libpng
openssl | openssl | openssl
python-2.0 | python | python(?: software foundation)?
php-3.01 | php | php
ruby | ruby | ruby
vim | vim | vim
w3c | w3c | w3c(?: software)?
x11 | x11 | x11
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
ofl-1.1 | open font | sil open font licen[cs]e(?:,? version)?(?: 1\\.1)?
odbl-1.0 | database,odbl | open (?:data commons open )?database licen[cs]e(?: \\(odbl\\))?(?: v?1\\.0)?|odbl(?:-1\\.0)?
odc-by-1.0 | attribution,odc-by | open data commons attribution licen[cs]e|odc-by
pddl-1.0 | pddl,public domain dedication | open data commons public domain dedication|pddl(?:-1\\.0)?
ogl-uk-3.0 | open government | open government licen[cs]e(?: v3\\.0)?
ms-pl | microsoft,ms-pl | microsoft public licen[cs]e|ms-pl
ms-rl | microsoft,ms-rl | microsoft reciprocal licen[cs]e|ms-rl
cecill-2.1 | cecill | cecill(?: v?2\\.1)?
postgresql | postgresql | postgresql
upl-1.0 | universal | universal permissive licen[cs]e(?: v?1\\.0)?
osl-3.0 | open software | open software licen[cs]e(?: v?\\.? ?3\\.0)?
afl-3.0 | academic | academic free licen[cs]e(?: v?\\.? ?3\\.0)?
ncsa | ncsa | (?:university of illinois/)?ncsa(?: open source)?
cc0-1.0 | cc0,creative commons zero | cc0(?:[ -]1\\.0)?|creative commons zero
cc-by-4.0 | cc by,cc-by | cc[ -]by[ -]4\\.0|cc[ -]by
cc-by-3.0 | cc by,cc-by | cc[ -]by[ -]3\\.0
cc-by-2.0 | cc by,cc-by | cc[ -]by[ -]2\\.[05]
cc-by-sa-4.0 | cc by,cc-by | cc[ -]by-sa[ -]4\\.0|cc[ -]by-sa
cc-by-sa-3.0 | cc by,cc-by | cc[ -]by-sa[ -]3\\.0
cc-by-nc-4.0 | cc by,cc-by | cc[ -]by-nc[ -]4\\.0|cc[ -]by-nc
cc-by-nd-4.0 | cc by,cc-by | cc[ -]by-nd[ -]4\\.0|cc[ -]by-nd
cc-by-nc-sa-4.0 | cc by,cc-by | cc[ -]by-nc-sa[ -]4\\.0|cc[ -]by-nc-sa
cc-by-nc-nd-4.0 | cc by,cc-by | cc[ -]by-nc-nd[ -]4\\.0|cc[ -]by-nc-nd
cc-by-any | creative commons | creative commons attribution(?: \\d\\.\\d)?(?: international| unported)?
cc-by-sa-any | creative commons | creative commons attribution[- ]share[- ]?alike(?: \\d\\.\\d)?(?: international| unported)?
cc-by-nc-any | creative commons | creative commons attribution[- ]non-?commercial(?: \\d\\.\\d)?(?: international| unported)?
cc-by-nd-any | creative commons | creative commons attribution[- ]no[- ]?deriv(?:ative)?s(?: \\d\\.\\d)?(?: international| unported)?
"""

#: Ways to state a license: rank, confidence, keywords of the way, pattern around the name.
WAYS = (
    (4, 1.0, ("spdx-license-identifier:",), r"spdx-license-identifier: ?(?:{name})(?: licen[cs]e)?"),
    (
        3,
        0.95,
        ("ed under ", "available under "),
        r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed) under"
        r"(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? (?:{name})(?: licen[cs]e)?",
    ),
    (
        2,
        0.8,
        ("licen", "see the", "subject to the", "terms of the"),
        r"(?:licen[cs]e ?:|see the|subject to the|terms of the) ?(?:{name})(?: licen[cs]e)?",
    ),
    (1, 0.5, (" licen",), r"(?:{name}) licen[cs]e"),
)

# Rules that name no license by the list above: label, keywords, rank, confidence, pattern.
TEXTS = """
mit | permission is hereby | 5 | 1.0 | permission is hereby granted, free of charge, to any person obtaining a copy
isc | permission to use | 5 | 1.0 | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
bsd-any | redistribution and use | 5 | 1.0 | redistribution and use in source and binary forms, with or without modification
zlib | as-is | 5 | 1.0 | this software is provided 'as-is', without any express or implied warranty
unlicense | public domain | 5 | 1.0 | this is free and unencumbered software released into the public domain
gpl-any | you can redistribute it | 5 | 1.0 | you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
lgpl-any | you can redistribute it | 5 | 1.0 | you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl-any | you can redistribute it | 5 | 1.0 | you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e
apache-2.0 | in compliance with the licen | 5 | 1.0 | you may not use this file except in compliance with the licen[cs]e
mpl-2.0 | mozilla | 5 | 1.0 | this source code form is subject to the terms of the mozilla public licen[cs]e
bsl-1.0 | boost | 5 | 1.0 | distributed under the boost software licen[cs]e, version 1\\.0
apache-2.0 | apache.org | 4 | 1.0 | https?://(?:www\\.)?apache\\.org/licenses/license-2\\.0
gpl-any | gnu.org | 4 | 0.9 | https?://(?:www\\.)?gnu\\.org/licenses/gpl
lgpl-any | gnu.org | 4 | 0.9 | https?://(?:www\\.)?gnu\\.org/licenses/lgpl
agpl-any | gnu.org | 4 | 0.9 | https?://(?:www\\.)?gnu\\.org/licenses/agpl
mit | opensource.org | 4 | 1.0 | https?://(?:www\\.)?opensource\\.org/licenses?/mit
bsd-3-clause | opensource.org | 4 | 1.0 | https?://(?:www\\.)?opensource\\.org/licenses?/bsd-3-clause
bsd-2-clause | opensource.org | 4 | 1.0 | https?://(?:www\\.)?opensource\\.org/licenses?/bsd-2-clause
cc0-1.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/publicdomain/zero/1\\.0
cc-by-4.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by/4\\.0
cc-by-3.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by/3\\.0
cc-by-sa-4.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by-sa/4\\.0
cc-by-sa-3.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by-sa/3\\.0
cc-by-nc-4.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by-nc/4\\.0
cc-by-nd-4.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by-nd/4\\.0
cc-by-nc-sa-4.0 | creativecommons.org | 4 | 1.0 | https?://creativecommons\\.org/licenses/by-nc-sa/4\\.0
mpl-2.0 | mozilla.org | 4 | 1.0 | https?://(?:www\\.)?mozilla\\.org/(?:en-us/)?mpl/2\\.0
epl-2.0 | eclipse.org | 4 | 1.0 | https?://(?:www\\.)?eclipse\\.org/legal/epl-2\\.0
ofl-1.1 | scripts.sil.org | 4 | 1.0 | https?://scripts\\.sil\\.org/ofl
public-domain | public domain | 2 | 0.8 | (?:is|are|released|placed|dedicated)(?: in| into| to)? the public domain
proprietary | all rights reserved | 1 | 0.6 | all rights reserved
proprietary | confidential | 2 | 0.7 | proprietary and confidential
copyright | copyright | 0 | 0.3 | copyright (?:\\(c\\) |© )?(?:19|20)\\d\\d
"""


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keywords: tuple[str, ...]  # every match holds one of these
    context: tuple[str, ...]  # and one of these
    rank: int
    confidence: float
    pattern: str

    @property
    def keyword(self) -> str:
        """What every match holds: the only keyword, or nothing where there are several."""
        return self.keywords[0] if len(self.keywords) == 1 else ""


def _cells(lines: str) -> list[list[str]]:
    rows = (x.split(" | ") for x in lines.replace("\\\\", "\\").strip().splitlines())
    return [[cell.strip() for cell in row] for row in rows]


def signature_rules() -> list[Rule]:
    """All rules in their order. Longer names of a family stand with higher ranks or longer
    matches, so that they win over the family's general name."""
    number = count()
    rules = []
    for label, words, name in _cells(NAMES):
        keywords = tuple(words.split(","))
        for rank, confidence, context, way in WAYS:
            pattern = way.replace("{name}", name)
            rules.append(Rule(next(number), label, keywords, context, rank, confidence, pattern))
    for label, words, rank, confidence, pattern in _cells(TEXTS):
        keywords = tuple(words.split(","))
        rules.append(
            Rule(next(number), label, keywords, keywords, int(rank), float(confidence), pattern)
        )
    return rules


def stems(rules: list[Rule]) -> tuple[str, ...]:
    """The contexts of the rules without those that hold another: every match holds one."""
    words = {w for r in rules for w in r.context}
    return tuple(sorted(w for w in words if not any(x != w and x in w for x in words)))


#: Every text that a rule can match holds one of these, lower-cased with single spaces.
STEMS = stems(signature_rules())


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTER + "+")).cast("long")


def _phrase_places(text: Column, phrase: str) -> Column:
    """(n, first, last) of the places where the phrase's words stand consecutively."""
    words = phrase.split()
    pattern = rf"(?i)(?<!{LETTER}){GAP.join(words)}(?!{LETTER})"
    return let(
        F.split(text, pattern, -1),
        lambda parts: let(
            F.transform(parts, lambda p: _words(p)),
            lambda counts: F.struct(
                (F.size(parts) - 1).cast("long").alias("n"),
                F.when(F.size(parts) > 1, counts[0]).alias("first"),
                F.when(
                    F.size(parts) > 1,
                    F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
                    + len(words) * (F.size(parts) - 2)
                    - F.get(counts, F.size(counts) - 1),
                ).alias("last"),
            ),
        ),
    )


RULE_GROUPS = (
    "array<struct<keywords:array<string>,rules:array<struct<number:int,label:string,"
    "context:array<string>,rank:int,confidence:double,pattern:string>>>>"
)


def _running(items: Column, start: Column, after, result, kind: str) -> Column:
    """result(state, item) of every item, where after(state, item) is the state of the next one.

    Items are gone through in blocks, about as many as a block has items. Arrays grow by copying,
    so results are collected block by block: n items cost n * sqrt(n) small copies, not n * n."""
    def block(state, part):
        return F.aggregate(
            part,
            F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda done, x: F.struct(
                after(done["state"], x).alias("state"),
                F.concat(done["out"], F.array(result(done["state"], x))).alias("out"),
            ),
        )

    def blocks(items):
        size = F.ceil(F.sqrt(F.size(items))).cast("int")
        return F.when(
            F.size(items) > 0,
            F.transform(F.sequence(F.lit(1), F.size(items), size), lambda i: F.slice(items, i, size)),
        ).otherwise(F.array(items))

    whole = F.aggregate(
        let(items, blocks),
        F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
        lambda done, part: let(
            block(done["state"], part),
            lambda b: F.struct(
                b["state"].alias("state"), F.concat(done["out"], F.array(b["out"])).alias("out")
            ),
        ),
    )
    return F.flatten(whole["out"])


def _detections(text: Column, rules: list[Rule]) -> Column:
    """Every match of every rule of which the text holds a keyword and a context: start, end, rank,
    rule number, label, confidence. The text is lower-cased, its white space single spaces, without
    the characters U+0001 and U+0002."""
    groups = [
        {
            "keywords": keywords,
            "rules": [
                {
                    "number": r.number, "label": r.label, "context": r.context, "rank": r.rank,
                    "confidence": r.confidence,
                    "pattern": rf"(?<![a-z0-9])(?:{r.pattern})(?![a-z0-9])",
                }
                for r in group
            ],
        }
        for keywords, group in groupby(rules, lambda r: r.keywords)
    ]
    # One constant for all rules, which Spark reads once; a literal each would be thousands.
    listed = F.from_json(F.lit(json.dumps(groups)), RULE_GROUPS)

    def intervals(rule: Column) -> Column:
        # One pass of the pattern: matches are set between two marks, which no rule reads.
        parts = F.split(F.regexp_replace(text, rule["pattern"], F.lit("\x01$0\x02")), "\x01", -1)
        lengths = let(
            parts,
            lambda p: F.transform(
                p, lambda x: F.struct(F.length(x).alias("all"), F.instr(x, "\x02").alias("mark"))
            ),
        )
        return let(
            lengths,
            lambda found: _running(
                F.slice(found, 2, F.size(found)),
                found[0]["all"],
                lambda at, x: at + x["all"] - 1,
                lambda at, x: F.struct(at.alias("start"), (at + x["mark"] - 1).alias("end")),
                "struct<start:int,end:int>",
            ),
        )

    def holds(words: Column) -> Column:
        return F.exists(words, lambda w: F.contains(text, w))

    named = F.filter(listed, lambda group: holds(group["keywords"]))
    held = F.filter(
        F.flatten(F.transform(named, lambda group: group["rules"])),
        lambda rule: holds(rule["context"]),
    )
    return F.flatten(
        F.transform(
            held,
            lambda rule: F.transform(
                intervals(rule),
                lambda s: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), rule["rank"].alias("rank"),
                    rule["number"].alias("number"), rule["label"].alias("label"),
                    rule["confidence"].alias("confidence"),
                ),
            ),
        )
    )


def _unmarked(text: Column) -> Column:
    """The text without the two marks; few texts hold one, the others are only searched."""
    held = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))
    return F.when(held, F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)


def _surviving(found: Column, ranks: list[int]) -> Column:
    """Without the detections that lie inside another: one of higher rank; or of equal rank and
    longer; or, for the same interval and rank, of an earlier rule. A longer one of lower rank
    suppresses only what is of its own rank or lower. In order of rules and places.

    One sweep: sorted by start, then the longest, the highest rank and the earliest rule first,
    whatever may suppress a detection stands before it. So it lies inside one just if, of those
    before it with its rank or a higher one, some end reaches its own."""
    kinds = "struct<start:int,back:int,under:int,number:int,label:string,confidence:double>"
    ordered = F.array_sort(
        F.transform(
            found,
            lambda x: F.struct(
                x["start"].alias("start"), (-x["end"]).alias("back"), (-x["rank"]).alias("under"),
                x["number"].alias("number"), x["label"].alias("label"),
                x["confidence"].alias("confidence"),
            ),
        )
    )

    def reach(ends, x):
        """The furthest end so far for each rank, of detections with that rank or a higher one."""
        return F.struct(
            *[
                F.when(-x["under"] >= rank, F.greatest(ends[f"r{rank}"], -x["back"]))
                .otherwise(ends[f"r{rank}"])
                .alias(f"r{rank}")
                for rank in ranks
            ]
        )

    def kept(ends, x):
        own = F.coalesce(*[F.when(-x["under"] == rank, ends[f"r{rank}"]) for rank in ranks])
        return F.when(own < -x["back"], x)

    nothing = F.struct(*[F.lit(-1).alias(f"r{rank}") for rank in ranks])
    swept = F.filter(_running(ordered, nothing, reach, kept, kinds), lambda x: x.isNotNull())
    by_rule = F.array_sort(
        F.transform(
            swept,
            lambda x: F.struct(
                x["number"].alias("number"), x["start"].alias("start"), (-x["back"]).alias("end"),
                (-x["under"]).alias("rank"), x["label"].alias("label"),
                x["confidence"].alias("confidence"),
            ),
        )
    )
    return F.transform(
        by_rule,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"),
            x["number"].alias("number"), x["label"].alias("label"),
            x["confidence"].alias("confidence"),
        ),
    )


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, detections.

    `labels` joins the base labels and those of the surviving detections; `score` is the greatest
    confidence of these, and at least 0.5 where a base phrase stands. Null or empty text: counts
    0, no labels, score 0, first and last null. Repeated rows: alike. No rows: none."""
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"))
    # Single spaces stay as they are, so most of a text is only read. No rule reads U+0001 to U+0003.
    low = F.regexp_replace(F.lower("text"), r"[\t-\r]\s*| \s+", " ")
    marked = let(
        low,
        lambda x: F.struct(
            (F.contains(x, F.lit("license")) | F.contains(x, F.lit("cc"))).alias("base"),
            F.when(reduce(or_, [F.contains(x, F.lit(s)) for s in stems(rules)]), x).alias("low"),
        ),
    )
    gated = read.withColumn("_gate", marked)
    phrases = F.when(
        F.col("_gate.base"),
        F.array(
            *[
                F.struct(F.lit(label).alias("label"), _phrase_places(F.col("text"), phrase).alias("at"))
                for phrase, label in BASE_PHRASES.items()
            ]
        ),
    )
    found = F.when(
        F.col("_gate.low").isNotNull(),
        let(
            _unmarked(F.col("_gate.low")),
            lambda x: let(
                _detections(x, rules), lambda d: _surviving(d, sorted({r.rank for r in rules}))
            ),
        ),
    )
    none = F.array().cast(
        "array<struct<start:int,end:int,rank:int,number:int,label:string,confidence:double>>"
    )
    scanned = gated.withColumn("_phrases", phrases).withColumn(
        "detections", F.coalesce(found, none)
    )
    placed = F.filter("_phrases", lambda p: p["at"]["n"] > 0)
    result = scanned.withColumn("_placed", placed)
    base = F.coalesce(
        F.transform("_placed", lambda p: p["label"]), F.array().cast("array<string>")
    )
    method = F.transform("detections", lambda d: d["label"])
    least = F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return result.select(
        "doc_id",
        _words(F.col("text")).alias("n_words"),
        F.coalesce(
            F.aggregate("_placed", F.lit(0).cast("long"), lambda a, p: a + p["at"]["n"]),
            F.lit(0).cast("long"),
        ).alias("n_base"),
        F.array_min(F.transform("_placed", lambda p: p["at"]["first"])).alias("first_word"),
        F.array_max(F.transform("_placed", lambda p: p["at"]["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",").alias("labels"),
        F.greatest(
            least,
            F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)),
        ).alias("score"),
        "detections",
    )


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
