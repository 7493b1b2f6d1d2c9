"""License scan: ordered signature rules over the words of a text, all inside Spark's own functions.

A text is folded to its words, one space between. Only texts with one of a few gate words go further; of the rules, only
those whose keyword stands in the text are tried. A rule's regular expression marks its matches in the text, and the
marked words give the intervals. Of overlapping detections, one whose words all lie in those of another is dropped; of
equal intervals the rule with the smaller priority number stays. The three base phrases are counted wherever they stand
and are never dropped.
"""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.columns import NO_WORD_LOWERED, WORD, let, lower_ascii, places


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched on whole words with one space between; ``keyword`` must stand in the text."""

    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    base: bool = False


BASE_RULES = [
    Rule("cc-by", 9, 0.5, "cc by", "cc by", True),
    Rule("gpl", 9, 0.5, "general public license", "general public license", True),
    Rule("reserved", 9, 0.5, "all rights reserved", "all rights reserved", True),
]

#: label, keyword, name as a regular expression over words
NAMES = """
apache-1.0|apache|apache( software)? licen[cs]e( version)? 1 0
apache-1.1|apache|apache( software)? licen[cs]e( version)? 1 1
apache-2.0|apache|apache( software)?( licen[cs]e)?( version| v)? (2 0|v2|2)( licen[cs]e)?
apache|apache|apache( software)? licen[cs]e
mit|mit|mit( expat| x11)? licen[cs]e
mit|expat|expat licen[cs]e
mit-0|mit|mit 0|mit no attribution( licen[cs]e)?
bsd-2-clause|bsd|(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( licen[cs]e)?
bsd-3-clause|bsd|(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( licen[cs]e)?
bsd-4-clause|bsd|(bsd 4 clause|4 clause bsd|original bsd|old bsd)( licen[cs]e)?
bsd-zero|bsd|(zero clause bsd|0bsd|bsd zero clause)( licen[cs]e)?
bsd|bsd|bsd( style)? licen[cs]e
gpl-1.0|general public|(gnu )?general public licen[cs]e( as published by the free software foundation)?( version| v)? 1( 0)?
gpl-2.0|general public|(gnu )?general public licen[cs]e( as published by the free software foundation)?( either)?( version| v)? (2( 0)?|v2)
gpl-2.0-or-later|general public|(gnu )?general public licen[cs]e( as published by the free software foundation)?( either)?( version| v)? 2( 0)?( of the licen[cs]e)? or (at your option )?any later version
gpl-3.0|general public|(gnu )?general public licen[cs]e( as published by the free software foundation)?( either)?( version| v)? (3( 0)?|v3)
gpl-3.0-or-later|general public|(gnu )?general public licen[cs]e( as published by the free software foundation)?( either)?( version| v)? 3( 0)?( of the licen[cs]e)? or (at your option )?any later version
gpl|gpl|gnu gpl|gpl licen[cs]e
gpl-2.0|gpl|(gnu )?(gpl v2|gplv2|gpl 2( 0)?)( only)?
gpl-3.0|gpl|(gnu )?(gpl v3|gplv3|gpl 3( 0)?)( only)?
gpl-2.0-or-later|gpl|(gnu )?(gpl 2 0|gpl v2|gplv2) or later
gpl-3.0-or-later|gpl|(gnu )?(gpl 3 0|gpl v3|gplv3) or later
lgpl-2.0|general public|(gnu )?(lesser|library) general public licen[cs]e( version| v)? 2( 0)?
lgpl-2.1|lesser|(gnu )?lesser general public licen[cs]e( version| v)? (2 1|v2 1)
lgpl-3.0|lesser|(gnu )?lesser general public licen[cs]e( version| v)? (3( 0)?|v3)
lgpl|lesser|(gnu )?lesser general public licen[cs]e
lgpl-2.1|lgpl|(gnu )?(lgpl v?2 1|lgplv2 1)
lgpl-3.0|lgpl|(gnu )?(lgpl v?3( 0)?|lgplv3)
agpl-3.0|affero|(gnu )?affero general public licen[cs]e( version| v)?( 3( 0)?| v3)?
agpl-3.0|agpl|(gnu )?(agpl v?3( 0)?|agplv3)
agpl-1.0|affero|affero general public licen[cs]e( version| v)? 1( 0)?
gfdl-1.1|free documentation|(gnu )?free documentation licen[cs]e( version| v)? 1 1
gfdl-1.2|free documentation|(gnu )?free documentation licen[cs]e( version| v)? 1 2
gfdl-1.3|free documentation|(gnu )?free documentation licen[cs]e( version| v)? 1 3
gfdl|free documentation|(gnu )?free documentation licen[cs]e
mpl-1.0|mozilla|mozilla public licen[cs]e( version| v)? 1 0
mpl-1.1|mozilla|mozilla public licen[cs]e( version| v)? 1 1
mpl-2.0|mozilla|mozilla public licen[cs]e( version| v)? 2( 0)?
mpl|mozilla|mozilla public licen[cs]e
mpl-2.0|mpl|mpl v?2( 0)?
epl-1.0|eclipse|eclipse public licen[cs]e( version| v)? 1( 0)?
epl-2.0|eclipse|eclipse public licen[cs]e( version| v)? 2( 0)?
epl|eclipse|eclipse public licen[cs]e
edl-1.0|eclipse|eclipse distribution licen[cs]e( version| v)?( 1 0)?
cpl-1.0|common public|common public licen[cs]e( version| v)?( 1 0)?
cddl-1.0|common development|common development and distribution licen[cs]e( cddl)?( version| v)?( 1 0)?
cddl-1.1|common development|common development and distribution licen[cs]e( cddl)?( version| v)? 1 1
cddl-1.0|cddl|cddl( 1 0)?
eupl-1.1|european union|european union public licen[cs]e( version| v)? 1 1
eupl-1.2|european union|european union public licen[cs]e( version| v)?( 1 2)?
isc|isc|isc licen[cs]e
zlib|zlib|zlib( libpng)? licen[cs]e
libpng|libpng|libpng licen[cs]e
bsl-1.0|boost|boost software licen[cs]e( version| v)?( 1 0)?
busl-1.1|business source|business source licen[cs]e( version| v)?( 1 1)?
artistic-1.0|artistic|artistic licen[cs]e( version| v)? 1( 0)?
artistic-2.0|artistic|artistic licen[cs]e( version| v)? 2( 0)?
artistic|artistic|artistic licen[cs]e
psf-2.0|python software|python software foundation licen[cs]e( version| v)?( 2)?
postgresql|postgresql|postgresql licen[cs]e
openssl|openssl|openssl licen[cs]e
php-3.01|php|php licen[cs]e( version| v)?( 3 01)?
ruby|ruby|ruby licen[cs]e
unlicense|unlicense|(the )?unlicense( licen[cs]e)?
wtfpl|wtfpl|wtfpl( licen[cs]e)?
beerware|beer|beer ?ware licen[cs]e
ofl-1.1|open font|(sil )?open font licen[cs]e( version| v)?( 1 1)?
ofl-1.0|open font|(sil )?open font licen[cs]e( version| v)? 1 0
odbl-1.0|open database|open database licen[cs]e( odbl)?( version| v)?( 1 0)?
odc-by-1.0|open data commons|open data commons attribution licen[cs]e( version| v)?( 1 0)?
pddl-1.0|open data commons|open data commons public domain dedication( and licen[cs]e)?( 1 0)?
cc0-1.0|cc0|cc0( 1 0)?( universal)?( public domain dedication)?
cc-by|creative commons|creative commons attribution( licen[cs]e)?
cc-by-sa|creative commons|creative commons attribution share ?alike( licen[cs]e)?
cc-by-nc|creative commons|creative commons attribution non ?commercial( licen[cs]e)?
cc-by-nd|creative commons|creative commons attribution no ?deriv(ative)?s( licen[cs]e)?
cc-by-nc-sa|creative commons|creative commons attribution non ?commercial share ?alike( licen[cs]e)?
cc-by-nc-nd|creative commons|creative commons attribution non ?commercial no ?deriv(ative)?s( licen[cs]e)?
creative-commons|creative commons|creative commons( public)? licen[cs]e
public-domain|public domain|(in|into|to) the public domain|public domain dedication
ms-pl|microsoft|microsoft public licen[cs]e( ms pl)?
ms-rl|microsoft|microsoft reciprocal licen[cs]e( ms rl)?
apsl-2.0|apple|apple public source licen[cs]e( version| v)?( 2 0)?
afl-3.0|academic free|academic free licen[cs]e( version| v)?( 3 0)?
osl-3.0|open software|open software licen[cs]e( version| v)?( 3 0)?
ecl-2.0|educational community|educational community licen[cs]e( version| v)?( 2 0)?
upl-1.0|universal permissive|universal permissive licen[cs]e( version| v)?( 1 0)?
sspl-1.0|server side public|server side public licen[cs]e( version| v)?( 1)?
elastic-2.0|elastic|elastic licen[cs]e( version| v)?( 2 0)?
vim|vim|vim licen[cs]e
tcl|tcl|tcl tk licen[cs]e|tcl licen[cs]e
ijg|independent jpeg|independent jpeg group licen[cs]e
ncsa|ncsa|(university of illinois )?ncsa( open source)? licen[cs]e
w3c|w3c|w3c( software( notice)?( and)?)? licen[cs]e
qpl-1.0|q public|q public licen[cs]e( version| v)?( 1 0)?
cecill-2.1|cecill|cecill( licen[cs]e)?( version| v)?( 2 1)?
bigscience-openrail|rail|(bigscience )?(bloom )?(openrail( m)?|rail licen[cs]e)
llama|llama|llama( 2| 3)? community licen[cs]e( agreement)?
"""

#: Other notices: label, keyword, weight, pattern.
NOTICES = """
copyright|copyright|0.4|copyright( c)? (19|20)[0-9][0-9]
copyright|copyright|0.4|copyright( c)? by
copyright|copyrighted|0.4|copyrighted material
reserved|rights reserved|0.5|(all|some|no) rights reserved
warranty-disclaimer|without warrant|0.5|without warrant(y|ies)( or conditions)? of any kind
warranty-disclaimer|as is|0.4|provided (by .{1,40} )?as is
warranty-disclaimer|merchantability|0.5|(implied )?warrant(y|ies) of merchantability
mit|permission is hereby granted|0.9|permission is hereby granted free of charge to any person obtaining a copy
isc|permission to use copy|0.9|permission to use copy modify and or distribute this software for any purpose
bsd|redistribution and use|0.9|redistribution and use in source and binary forms
bsd-3-clause|neither the name|0.9|neither the name of
zlib|altered source|0.9|altered source versions must be plainly marked
apache-2.0|you may not use this file|0.9|you may not use this file except in compliance with the license
gpl|free software|0.8|this (program|library|software) is free software
mpl-2.0|source code form|0.9|this source code form is subject to the terms of the mozilla public license
proprietary|proprietary|0.6|proprietary (and )?confidential|confidential and proprietary|proprietary licen[cs]e
proprietary|may not be reproduced|0.7|may not be reproduced( or distributed)?
proprietary|distribute|0.6|do not (copy or )?distribute
no-commercial-use|commercial|0.6|(non ?commercial use only|not for commercial use|no commercial use)
dual-licensed|dual|0.6|dual licen[cs]ed
"""

_CC_KINDS = {"by": "by", "by-sa": "by sa", "by-nc": "by nc", "by-nd": "by nd", "by-nc-sa": "by nc sa", "by-nc-nd": "by nc nd"}
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
_GRANT = r"(licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|governed)( to you)? (under|by|through|with)( the)?( terms of)?( the)?"


def build_rules() -> list[Rule]:
    """All rules, the base ones first. A named license gives a grant under it, its bare name, and its identifier."""
    rules = list(BASE_RULES)
    for line in NAMES.strip().splitlines():
        label, keyword, name = line.split("|", 2)
        rules.append(Rule(label, 1, 0.95, keyword, f"{_GRANT} ({name})"))
        rules.append(Rule(label, 3, 0.7, keyword, name))
    for label in dict.fromkeys(r.label for r in rules if not r.base):
        identifier = label.replace("-", " ").replace(".", " ")
        rules.append(Rule(label, 0, 1.0, "spdx license identifier", f"spdx license identifier {identifier}"))
    for kind, spaced in _CC_KINDS.items():
        rules.append(Rule(f"cc-{kind}", 3, 0.7, f"cc {spaced}", f"(creative commons )?cc {spaced}"))
        for version in _CC_VERSIONS:
            spoken = version.replace(".", " ")
            rules.append(Rule(f"cc-{kind}-{version}", 2, 0.9, f"cc {spaced} {spoken}", f"(creative commons )?cc {spaced} {spoken}( international| unported)?( licen[cs]e)?"))
            rules.append(Rule(f"cc-{kind}-{version}", 0, 1.0, f"licenses {spaced} {spoken}", f"creativecommons org licenses {spaced} {spoken}"))
    for line in NOTICES.strip().splitlines():
        label, keyword, weight, pattern = line.split("|", 3)
        rules.append(Rule(label, 4, float(weight), keyword, pattern))
    return rules


RULES = build_rules()
#: Every match of a rule has one of these words, or beginnings of words; texts without them have no detection.
GATES = [
    "licen", "unlicen", "general public", "rights reserved", "cc by", "cc0", "creative commons", "creativecommons", "apache", "mit 0", "mit no attribution",
    "bsd", "0bsd", "freebsd", "gpl", "lgpl", "agpl", "mpl", "cddl", "wtfpl", "open data commons", "public domain", "cecill", "openrail",
    "copyright", "without warrant", "provided", "warrant", "permission is hereby", "permission to use", "redistribution and use",
    "neither the name", "altered source", "you may not", "free software", "source code form", "proprietary", "confidential and", "may not be reproduced",
    "do not copy or", "do not distribute", "commercial", "noncommercial", "dual licen",
]
#: The gate on raw text: words may be apart by any characters that are not word characters.
GATE = r"(?i)(^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(" + "|".join(g.replace(" ", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+") for g in GATES) + ")"

_OPEN, _CLOSE = "\x01", "\x02"
_RULE_TYPE = "array<struct<label:string,priority:int,weight:double,keyword:string,pattern:string,base:boolean>>"


def folded(text: Column) -> Column:
    """The words in lower case with one space between, and a space at either end."""
    spaced = F.regexp_replace(lower_ascii(text), NO_WORD_LOWERED, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def detections(fold: Column, rules: Column) -> Column:
    """Sorted (start, minus last, priority, label, weight, base) structs of all matches; words count from 0."""

    def of_rule(rule: Column) -> Column:
        whole = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
        marked = F.split(F.trim(F.regexp_replace(fold, whole, F.lit(f"{_OPEN}$0{_CLOSE}"))), F.lit(" "))

        def intervals(words: Column) -> Column:
            both = F.arrays_zip(
                places(words, lambda w: w.startswith(_OPEN)).alias("start"), places(words, lambda w: w.endswith(_CLOSE)).alias("last")
            )
            return F.transform(
                both,
                lambda p: F.struct(
                    p["start"].alias("start"), (-p["last"]).alias("minus_last"), rule["priority"].alias("priority"),
                    rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
                ),
            )

        return let(marked, intervals)

    near = F.filter(rules, lambda r: fold.contains(r["keyword"]))
    return F.array_sort(F.flatten(F.transform(near, of_rule)))


def _resolved(found: Column) -> Column:
    """One pass over the sorted detections: what is not inside an earlier, wider or better one stays."""
    start = F.struct(
        F.lit(-1).alias("reach"),
        F.array().cast("array<string>").alias("labels"),
        F.array().cast("array<string>").alias("base_labels"),
        F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"),
        F.lit(0.0).alias("score"),
    )

    def step(acc: Column, d: Column) -> Column:
        stays = d["base"] | (-d["minus_last"] > acc["reach"])
        begin = d["start"].cast("long")
        return F.struct(
            F.when(d["base"], acc["reach"]).otherwise(F.greatest(acc["reach"], -d["minus_last"])).alias("reach"),
            F.when(stays & ~F.array_contains(acc["labels"], d["label"]), F.array_append(acc["labels"], d["label"])).otherwise(acc["labels"]).alias("labels"),
            F.when(d["base"] & ~F.array_contains(acc["base_labels"], d["label"]), F.array_append(acc["base_labels"], d["label"])).otherwise(acc["base_labels"]).alias("base_labels"),
            (acc["n_base"] + d["base"].cast("long")).alias("n_base"),
            F.when(d["base"], F.least(acc["first_word"], begin)).otherwise(acc["first_word"]).alias("first_word"),
            F.when(d["base"], F.greatest(acc["last_word"], begin)).otherwise(acc["last_word"]).alias("last_word"),
            F.when(stays, F.greatest(acc["score"], d["weight"])).otherwise(acc["score"]).alias("score"),
        )

    return F.aggregate(found, start, step)


def scan(documents: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``documents`` with n_words and ``licenses``: labels, base_labels (sorted, distinct), n_base, first_word, last_word,
    score (the largest weight of a detection that stays, 0 without one) and the sorted detections themselves.

    Every row is worked on by itself, without a shuffle: repeated rows come back as often, extra columns are kept, and
    columns of the input named like the two are replaced. A null text is an empty one: no words, no detection. Time is
    linear in the text for each rule that its keyword lets through.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    listed = F.from_json(F.lit(json.dumps([asdict(r) for r in rules or RULES])), _RULE_TYPE)
    gated = given.rlike(GATE) if rules is None else F.lit(True)
    nothing = F.array().cast("array<struct<start:int,minus_last:int,priority:int,label:string,weight:double,base:boolean>>")
    found = F.when(gated, let(folded(given), lambda fold: detections(fold, listed))).otherwise(nothing)
    result = let(
        found,
        lambda all_found: let(
            _resolved(all_found),
            lambda r: F.struct(
                F.array_sort(r["labels"]).alias("labels"), F.array_sort(r["base_labels"]).alias("base_labels"), r["n_base"].alias("n_base"),
                r["first_word"].alias("first_word"), r["last_word"].alias("last_word"), r["score"].alias("score"), all_found.alias("detections"),
            ),
        ),
    )
    return documents.withColumn("n_words", F.regexp_count(given, F.lit(WORD)).cast("long")).withColumn("licenses", result)
