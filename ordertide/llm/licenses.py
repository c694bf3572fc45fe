"""License scans by ordered signature rules, in DataFrame functions only.

A text is brought to its words (A-Z in lower case, each word between single spaces).
Rules are regular expressions over that form, each with a priority and keywords: a rule
runs only where one of its keywords occurs, and texts without any gate word run none.
Detections are intervals of words. One that lies inside an interval of higher priority, or
of equal priority and greater length, or of equal interval and an earlier rule, is
suppressed: a sweep over the sorted intervals keeps how far those of each priority reach.

Matches are marked in the text, whose words then tell their numbers, so the work grows with
the words and not with the matches times themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    keys: tuple[str, ...]
    pattern: str  # over words between single spaces; it takes the space before its first word


#: Phrases whose every place counts, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, words of the SPDX identifier, pattern of the name (without the word license), page of the text.
LICENSES = (
    ("0bsd", "0bsd", r"(?:zero clause bsd|0bsd)", "0bsd"),
    ("afl-3.0", "afl 3 0", r"academic free(?: license)? (?:v|version )?3(?: 0)?", "afl 3 0"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public(?: license)?(?: (?:v|version )?3(?: 0)?)?", "agpl 3 0"),
    ("apache-1.1", "apache 1 1", r"apache(?: software)?(?: license)? (?:v|version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache 2 0", r"apache(?: software)?(?: license)? (?:v|version )?2(?: 0)?", "apache 2 0"),
    ("artistic-1.0", "artistic 1 0", r"artistic(?: license)? (?:v|version )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic 2 0", r"artistic(?: license)? (?:v|version )?2(?: 0)?", "artistic 2 0"),
    ("blueoak-1.0.0", "blueoak 1 0 0", r"blue oak model(?: license)?(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd-1-clause", "bsd 1 clause", r"bsd (?:1|one) clause", "bsd 1 clause"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)", "bsd 4 clause"),
    ("bsl-1.0", "bsl 1 0", r"boost software(?: license)?(?: (?:v|version )?1(?: 0)?)?", "bsl 1 0"),
    ("bsl-1.1", "busl 1 1", r"business source(?: license)?(?: (?:v|version )?1 1)?", "busl 1 1"),
    ("cc-by-3.0", "cc by 3 0", r"(?:cc by 3(?: 0)?|creative commons attribution 3(?: 0)?)", "by 3 0"),
    ("cc-by-4.0", "cc by 4 0", r"(?:cc by 4(?: 0)?|creative commons attribution 4(?: 0)?)", "by 4 0"),
    ("cc-by-nc", "cc by nc(?: [0-9] [0-9])?", r"(?:cc by nc|creative commons attribution non ?commercial)", "by nc"),
    ("cc-by-nc-nd", "cc by nc nd(?: [0-9] [0-9])?", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)", "by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa(?: [0-9] [0-9])?", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "by nc sa"),
    ("cc-by-nd", "cc by nd(?: [0-9] [0-9])?", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)", "by nd"),
    ("cc-by-sa", "cc by sa(?: [0-9] [0-9])?", r"(?:cc by sa|creative commons attribution share ?alike)", "by sa"),
    ("cc0-1.0", "cc0 1 0", r"(?:cc0(?: 1 0)?|creative commons zero)", "cc0"),
    ("cddl-1.0", "cddl 1 [01]", r"common development and distribution(?: license)?", "cddl 1 0"),
    ("cecill-2.1", "cecill 2 1", r"cecill(?: free software)?(?: license)?", "cecill 2 1"),
    ("cpl-1.0", "cpl 1 0", r"common public(?: license)?(?: (?:v|version )?1(?: 0)?)?", "cpl 1 0"),
    ("ecl-2.0", "ecl 2 0", r"educational community(?: license)?", "ecl 2 0"),
    ("epl-1.0", "epl 1 0", r"eclipse public(?: license)? (?:v|version )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "epl 2 0", r"eclipse public(?: license)? (?:v|version )?2(?: 0)?", "epl 2 0"),
    ("eupl-1.2", "eupl 1 2", r"european union public(?: licence| license)?(?: (?:v|version )?1 2)?", "eupl 1 2"),
    ("gfdl-1.3", "gfdl 1 [123](?: only| or later)?", r"gnu free documentation(?: license)?(?: (?:v|version )?1 [123])?", "fdl"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", r"(?:gnu )?general public license (?:v|version )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", r"(?:gnu )?(?:general public license|gpl) ?(?:v|version )?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", r"(?:gnu )?(?:general public license|gpl) ?(?:v|version )?3(?: 0)?", "gpl 3 0"),
    ("hpnd", "hpnd", r"historical permission notice and disclaimer", "hpnd"),
    ("isc", "isc", r"isc", "isc"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", r"(?:gnu )?(?:lesser|library) general public(?: license)? (?:v|version )?2 ?[01]?", "lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", r"(?:gnu )?lesser general public(?: license)? (?:v|version )?3(?: 0)?", "lgpl 3 0"),
    ("lppl-1.3c", "lppl 1 3c", r"latex project public(?: license)?", "lppl 1 3c"),
    ("mit", "mit", r"(?:mit|expat)", "mit"),
    ("mit-0", "mit 0", r"mit no attribution", "mit 0"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public(?: license)? (?:v|version )?1(?: 1)?", "mpl 1 1"),
    ("mpl-2.0", "mpl 2 0", r"mozilla public(?: license)? (?:v|version )?2(?: 0)?", "mpl 2 0"),
    ("ms-pl", "ms pl", r"microsoft public", "ms pl"),
    ("ms-rl", "ms rl", r"microsoft reciprocal", "ms rl"),
    ("mulanpsl-2.0", "mulanpsl 2 0", r"mulan psl(?: v2)?", "mulanpsl 2 0"),
    ("ncsa", "ncsa", r"(?:university of illinois|ncsa)(?: open source)?", "ncsa"),
    ("odbl-1.0", "odbl 1 0", r"open database", "odbl 1 0"),
    ("odc-by-1.0", "odc by 1 0", r"open data commons attribution", "odc by 1 0"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?open font(?: license)?(?: (?:v|version )?1 1)?", "ofl 1 1"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("osl-3.0", "osl 3 0", r"open software(?: license)?(?: (?:v|version )?3(?: 0)?)?", "osl 3 0"),
    ("php-3.01", "php 3 01", r"php(?: license)? (?:v|version )?3(?: 01)?", "php 3 01"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("psf-2.0", "psf 2 0", r"python software foundation", "psf 2 0"),
    ("python-2.0", "python 2 0", r"python(?: license)? 2 0", "python 2 0"),
    ("qpl-1.0", "qpl 1 0", r"q public", "qpl 1 0"),
    ("ruby", "ruby", r"ruby", "ruby"),
    ("sspl-1.0", "sspl 1 0", r"server side public", "sspl 1 0"),
    ("unicode-dfs", "unicode dfs 2016", r"unicode", "unicode dfs 2016"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense"),
    ("upl-1.0", "upl 1 0", r"universal permissive", "upl 1 0"),
    ("vim", "vim", r"vim", "vim"),
    ("w3c", "w3c", r"w3c software(?: notice and)?", "w3c"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public", "wtfpl"),
    ("x11", "x11", r"x11", "x11"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("zpl-2.1", "zpl 2 1", r"zope public", "zpl 2 1"),
)

#: Words of which each form of a license's name holds one.
NAME_KEYS = {
    "0bsd": ("bsd",), "afl-3.0": ("academic free",), "agpl-3.0": ("affero",), "apache-1.1": ("apache",), "apache-2.0": ("apache",), "artistic-1.0": ("artistic",),
    "artistic-2.0": ("artistic",), "blueoak-1.0.0": ("blue oak",), "bsd-1-clause": ("bsd",), "bsd-2-clause": ("bsd",), "bsd-3-clause": ("bsd",), "bsd-4-clause": ("bsd",),
    "bsl-1.0": ("boost software",), "bsl-1.1": ("business source",), "cc-by-3.0": ("cc by", "creative commons"), "cc-by-4.0": ("cc by", "creative commons"),
    "cc-by-nc": ("cc by", "creative commons"), "cc-by-nc-nd": ("cc by", "creative commons"), "cc-by-nc-sa": ("cc by", "creative commons"), "cc-by-nd": ("cc by", "creative commons"),
    "cc-by-sa": ("cc by", "creative commons"), "cc0-1.0": ("cc0", "creative commons"), "cddl-1.0": ("common development",), "cecill-2.1": ("cecill",), "cpl-1.0": ("common public",),
    "ecl-2.0": ("educational community",), "epl-1.0": ("eclipse public",), "epl-2.0": ("eclipse public",), "eupl-1.2": ("european union",), "gfdl-1.3": ("free documentation",),
    "gpl-1.0": ("general public",), "gpl-2.0": ("general public", "gpl"), "gpl-3.0": ("general public", "gpl"), "hpnd": ("historical permission",), "isc": ("isc",),
    "lgpl-2.1": ("general public",), "lgpl-3.0": ("general public",), "lppl-1.3c": ("latex project",), "mit": ("mit", "expat"), "mit-0": ("mit no attribution",),
    "mpl-1.1": ("mozilla public",), "mpl-2.0": ("mozilla public",), "ms-pl": ("microsoft public",), "ms-rl": ("microsoft reciprocal",), "mulanpsl-2.0": ("mulan psl",),
    "ncsa": ("university of illinois", "ncsa"), "odbl-1.0": ("open database",), "odc-by-1.0": ("open data commons",), "ofl-1.1": ("open font",), "openssl": ("openssl",),
    "osl-3.0": ("open software",), "php-3.01": ("php",), "postgresql": ("postgresql",), "psf-2.0": ("python software",), "python-2.0": ("python",), "qpl-1.0": ("q public",),
    "ruby": ("ruby",), "sspl-1.0": ("server side public",), "unicode-dfs": ("unicode",), "unlicense": ("the unlicense",), "upl-1.0": ("universal permissive",), "vim": ("vim",),
    "w3c": ("w3c software",), "wtfpl": ("want to public",), "x11": ("x11",), "zlib": ("zlib",), "zpl-2.1": ("zope public",),
}

#: Sentences of the licenses' own texts: label, keyword, pattern.
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", "apache org licenses", r"(?:http |https )?(?:www )?apache org licenses license 2 0"),
    ("gpl", "general public license", r"terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "either version 2", r"either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0", "either version 3", r"either version 3 of the license or (?:at your option )?any later version"),
    ("gpl", "gnu org licenses", r"gnu org licenses(?: gpl)?(?: html)?"),
    ("lgpl", "lesser general public", r"terms of the gnu lesser general public license"),
    ("agpl-3.0", "affero general public", r"terms of the gnu affero general public license"),
    ("mpl-2.0", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"),
    ("epl", "eclipse org legal", r"eclipse org legal epl"),
    ("bsl-1.0", "boost org license", r"boost org license 1 0 txt"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:is|are|been) (?:hereby )?(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("cc", "creativecommons org", r"creativecommons org licenses"),
    ("cc-by", "creative commons attribution", r"licensed under a creative commons attribution"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero"),
    ("ofl-1.1", "sil open font", r"this font software is licensed under the sil open font license"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential|proprietary license)"),
    ("no-redistribution", "redistribut", r"(?:may not be|do not|not be) (?:copied or )?redistributed?(?: without)?"),
    ("non-commercial", "commercial use", r"(?:non ?commercial use only|not for commercial use|no commercial use)"),
    ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
)

#: Every rule's text holds one of these words or word parts, or two words of the phrase cc by.
GATES = ("licen", "copyright", "reserved", "domain", "commons", "redistribut", "warrant", "spdx", "gpl", "gnu", "cc0", "commercial", "permission", "proprietary", "mozilla", "eclipse", "boost", "apache", "altered", "advertising", "opensource")

_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[Rule]:
    """All rules in order: for each license its tag, its page, its grant and its name, then the sentences."""
    made = []
    for label, tag, name, page in LICENSES:
        keys = NAME_KEYS[label]
        made.append(Rule(label, 5, 1.0, ("spdx",), rf"spdx license identifier {tag}"))
        made.append(Rule(label, 4, 0.9, ("opensource org",), rf"opensource org licenses? {page}(?: php| html)?"))
        made.append(Rule(label, 3, 0.9, keys, rf"licensed under (?:an? |the )?(?:terms of the )?{name}(?: licen[sc]e)?"))
        made.append(Rule(label, 2, 0.7, keys, rf"{name}(?: licen[sc]e|(?<=licen[sc]e|licen[sc]e [0-9]|licen[sc]e [0-9] [0-9]|licen[sc]e version [0-9]|licen[sc]e version [0-9] [0-9]))"))
    made += [Rule(label, 4, 0.8, (key,), pattern) for label, key, pattern in SENTENCES]
    made += [Rule(label, 1, 0.5, ("cc by",), name) for label, _, name, _ in LICENSES if name.startswith("(?:cc by")]
    return made


#: Marks of a match's begin and end; separators of words hold them, so no word does.
_BEGIN, _END = "\x01", "\x02"
_RULE = "label string, priority int, score double, keys array<string>, pattern string, number int"
PRIORITIES = 5


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _spans(norm: Column, pattern: Column) -> Column:
    """Intervals of words (start, end) where the pattern matches, left to right."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?s) ("), pattern, F.lit(")(?= )")), F.lit(f" {_BEGIN}$1{_END}"))

    def pairs(words: Column) -> Column:
        at = lambda mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        return F.zip_with(at(_BEGIN), at(_END), lambda a, b: F.struct((a - 1).alias("start"), b.alias("end")))

    # texts without a match aren't taken apart
    none = F.array().cast("array<struct<start:int,end:int>>")
    return _let(marked, lambda m: F.when(F.contains(m, F.lit(_BEGIN)), _let(F.split(m, " ", -1), pairs)).otherwise(none))


def _survivors(found: Column) -> Column:
    """Detections that no other one suppresses, in the order of their places.

    In the order of start, descending end, descending priority and number, what suppresses a
    detection comes before it, so it is hidden if one of its priority or a higher one has reached
    its end. Survivors are put together in runs, as appending to one array copies it each time.
    """
    row = lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("low"), d["number"].alias("number"), d.alias("d")
    )
    return _let(F.transform(F.array_sort(F.transform(found, row)), lambda x: x["d"]), _swept)


def _swept(found: Column) -> Column:
    """Those of the ordered detections that none before suppresses."""
    size = F.greatest(F.lit(16), F.ceil(F.cbrt(2 * F.size(found))).cast("int"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int")), lambda r: F.slice(found, (r * size + 1).cast("int"), size))
    reach = F.array_repeat(F.lit(-1), PRIORITIES)  # by priority, how far detections of it or a higher one go
    none = F.filter(found, lambda d: F.lit(False))

    def step(acc: Column, d: Column) -> Column:
        further = F.transform(acc["reach"], lambda x, i: F.when(i < d["priority"], F.greatest(x, d["end"])).otherwise(x))
        seen = F.element_at(acc["reach"], d["priority"]) >= d["end"]
        return F.struct(further.alias("reach"), F.when(seen, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    def of_run(acc: Column, run: Column) -> Column:
        done = F.aggregate(run, F.struct(acc["reach"].alias("reach"), none.alias("out")), step)
        return F.struct(done["reach"].alias("reach"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    swept = F.aggregate(runs, F.struct(reach.alias("reach"), F.slice(F.array(found), 1, 0).alias("out")), of_run)["out"]
    return F.when(F.size(found) > 1, F.flatten(swept)).otherwise(found)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, base (array of start, end, label), found and kept (arrays of start,
    end, label, priority, score, number; kept without the suppressed ones).

    Null text counts as empty. Rows are independent of each other; columns of these names
    are replaced, others pass through.
    """
    rest = [c for c in docs.columns if c not in ("n_words", "base", "found", "kept")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(low, F.lit(word))
    gate = gate | text.rlike(rf"(?i)cc{_SEP}+by")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, _SEP + "+", " ")), F.lit(" "))
    rows = docs.select(*rest, F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.when(gate, norm).alias("_norm"))

    n = F.col("_norm")

    def of_phrase(phrase: str, label: str) -> Column:
        return F.transform(_spans(n, F.lit(phrase)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*(of_phrase(*b) for b in BASE)))
    book = F.from_json(F.lit(json.dumps([r._asdict() | {"number": i} for i, r in enumerate(rules())])), f"array<struct<{_RULE.replace(' ', ':').replace(',:', ',')}>>")
    keys = F.from_json(F.lit(json.dumps(sorted({k for r in rules() for k in r.keys}))), "array<string>")
    present = F.filter(keys, lambda k: F.contains(n, k))

    def of_rule(r: Column) -> Column:
        return F.transform(_spans(n, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), r["number"].alias("number")))

    found = F.flatten(_let(present, lambda p: F.transform(F.filter(book, lambda r: F.arrays_overlap(r["keys"], p)), of_rule)))
    rows = rows.withColumn("base", F.when(n.isNotNull(), base)).withColumn("found", F.when(n.isNotNull(), found)).drop("_norm")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    return rows.withColumn("base", empty("base")).withColumn("found", empty("found")).withColumn("kept", _survivors(F.col("found")))
