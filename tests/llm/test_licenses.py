import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ordertide.llm import licenses as L
from ordertide.llm import op7

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words = words_of(text)
    base = [(i, label) for phrase, label in L.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    norm, found = f" {' '.join(words)} ", []
    for number, r in enumerate(L.rules()):
        for m in re.finditer(f" (?:{r.pattern})(?= )".replace("(?<=licen[sc]e|licen[sc]e [0-9]|licen[sc]e [0-9] [0-9]|licen[sc]e version [0-9]|licen[sc]e version [0-9] [0-9])", "(?:(?<=licen[sc]e)|(?<=licen[sc]e [0-9])|(?<=licen[sc]e [0-9] [0-9])|(?<=licen[sc]e version [0-9])|(?<=licen[sc]e version [0-9] [0-9]))"), norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), r, number))
    kept = [
        d
        for d in found
        if not any(e[0] <= d[0] and e[1] >= d[1] and (-e[2].priority, d[1] - d[0] - e[1] + e[0], e[3]) < (-d[2].priority, 0, d[3]) for e in found)
    ]
    starts = [i for i, _ in base]
    labels = sorted({label for _, label in base} | {d[2].label for d in kept})
    score = max([d[2].score for d in kept] + [0.5 if base else 0.0])
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in base})), ",".join(labels), score


TEXTS = [
    "", None, "...", "plain words", "The MIT License, and mit\nLICENSE mit  license",
    "GNU General Public License version 3 or GNU general public\tlicense", "gnu general publıc license",
    "CC BY 4.0; cc-by cc by-nc-sa", "CC0 1.0", "SPDX-License-Identifier: Apache-2.0", "x SPDX-License-Identifier: GPL-3.0-or-later y",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT license" * 3, "mit license " * 900,
    "Copyright (c) 2001 2002 X. All rights reserved.", "Mozilla Public License 2.0, BSD 3-clause license, ISC license, three clause bsd licence",
    "licensed under the terms of the Boost Software License 1.0", "K license mit é license émit license", "a http://opensource.org/licenses/MIT b", "gnu lesser general public license version 2.1",
]


def rows_of(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}


def test_odd_texts(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(op7.query(spark, str(tmp_path)))
    for i, t, _ in rows:
        assert got[i] == brute(t), t
    assert got[9][5] == "apache-2.0" and got[4][1] == 3


@pytest.mark.parametrize("mark", ["\u0085", "\u2028", "\u2029"])
def test_line_separators_are_gaps_too(spark, mark):
    texts = [f"a{mark}b the mit license and mit license", f"mit license {mark} x{mark} Apache License, Version 2.0; isc license", f"mit license{mark} mit license", f"{mark} spdx-license-identifier: MIT {mark} all rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        starts = [b.start for b in got[i].base]
        assert (got[i].n_words, len(starts), min(starts, default=None), max(starts, default=None)) == want[:4]
        assert ",".join(sorted({b.label for b in got[i].base} | {k.label for k in got[i].kept})) == want[5]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = rows_of(op7.query(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        assert got[r.doc_id] == brute(r.text)
    assert any(v[1] for v in got.values())


def test_gates_cover_the_rules():
    rules = L.rules()
    assert len(rules) > 200
    for r in rules:
        assert all(any(g in k for g in L.GATES) or k == "cc by" for k in r.keys) or any(g in r.pattern for g in L.GATES), r


@pytest.mark.parametrize("label,tag,name,page", L.LICENSES)
def test_names_hold_their_keys(label, tag, name, page):
    """Some word of the keys lies in each alternative of the pattern."""
    inside = name[3:-1].split("|") if re.fullmatch(r"\(\?:[^()]*(\([^()]*\)[^()]*)*\)", name) and "|" in name and name.count("(?:") == 1 else [name]
    for part in inside:
        plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", part)
        assert any(k in plain or k in part or all(w in part for w in k.split()) for k in L.NAME_KEYS[label]), part


def test_sweep_against_each_pair(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 50, 700):
        rows = []
        for number in range(n):
            start = rng.randrange(1 + n // 3)
            rows.append((start, start + rng.randrange(1, 9), "x", rng.randrange(1, 6), 0.5, number))
        schema = "id int, found array<struct<start:int,end:int,label:string,priority:int,score:double,number:int>>"
        got = spark.createDataFrame([(1, rows)], schema).select(L._survivors(F.col("found")).alias("k")).first().k
        rank = lambda d, e: (-e[3], d[1] - d[0] - e[1] + e[0], e[5]) < (-d[3], 0, d[5])
        want = [d for d in rows if not any(e[0] <= d[0] and e[1] >= d[1] and rank(d, e) for e in rows)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_time_follows_the_matches(spark):
    """Four times the matches take less than eight times as long, beyond what any table takes."""

    def taken(n):
        df = spark.createDataFrame([(1, "Licensed under the MIT License. All rights reserved. " * n)], "doc_id long, text string").cache()
        df.count()
        best = []
        for _ in range(2):
            began = time.perf_counter()
            assert L.scan(df).select(F.size("kept")).first()[0] == 2 * n
            best.append(time.perf_counter() - began)
        return min(best)

    fixed, few, many = taken(1), taken(4000), taken(16000)
    assert many - fixed < 8 * max(few - fixed, 0.5), (fixed, few, many)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(df).count() == 0


@pytest.mark.parametrize("phrase,label", L.BASE)
def test_base_stays_when_suppressed(spark, phrase, label):
    df = spark.createDataFrame([(1, f"licensed under the {phrase} 2.0")], "doc_id long, text string")
    assert [b.label for b in L.scan(df).first().base] == [label]
