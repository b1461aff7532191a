"""Operator 1: license scans by an exact set-similarity join.

For a template of L words a text is cut into blocks of about 1.5 L words, one every L / 2 words, whatever its lines are: a
notice of L words lies whole in one of them. Blocks and templates are sets of words, and a block matches a template if it holds
at least ``threshold`` of the template's words. The join is exact: words are put in one global order,
rarest first by their document frequency, and only blocks that share a word of both prefixes are
compared, after a length filter and a positional filter; the overlap itself is then counted.

Only JVM-side expressions are used. Words outside the templates' vocabulary can match nothing, so
the order is taken over that vocabulary (fixed by the templates, not by the data) and a block
becomes ``array_intersect(order, words)``: its template words, already in global order. A block that meets the threshold
holds a word of the template's prefix, so only blocks around such words are made.

Defined results: null text counts as empty; rows that repeat a doc_id are scanned on their own (keyed
by doc_id and text); other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import lower_ascii, row_key, table

#: Words of [0-9A-Za-z] and of code points above 0x7F; upper case is inside, so counting needs no lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = r"^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

#: Phrase and label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label and wording of license notices and of the opening and warranty texts of licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    (
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)
THRESHOLD = 0.9


def step_of(template: str) -> tuple[int, int]:
    """Step and length, in words, of the blocks in which a template is looked for: any run of words as long as the template lies in one."""
    length = len(template.split())
    step = max(1, length // 2)
    return step, length + step - 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0)


def phrase_places(text: Column, phrases=PHRASES) -> Column:
    """array<struct<at, label>>: every place where a phrase's words stand consecutively, counted in words."""
    found = words(text)

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")

        def here(word, i):
            test = word == parts[0]
            for k, part in enumerate(parts[1:], 1):
                test = test & (F.get(found, i + k) == part)
            return F.when(test, F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

        return F.filter(F.transform(found, here), lambda x: x.isNotNull())

    # A text without the phrase as characters has no such place: most texts are not cut into words here.
    may = "|".join(GAP.join(p.split(" ")) for p, _ in phrases)
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(text.rlike(f"(?i){may}"), F.concat(*[starts(p, x) for p, x in phrases])).otherwise(none)


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' vocabulary by document frequency over all texts, rarest first. One row per word reaches the driver."""
    there = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), words(F.col("text")))).alias("word"))
    counts = {r["word"]: r["n"] for r in there.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per block and template that meet the threshold: doc_id, key, start (of the block, in words), template, label, containment."""
    order = word_order(docs, sorted({w for _, t in templates for w in t.split()}))
    place = {w: k for k, w in enumerate(order)}
    index, opened = [], {}
    for number, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=place.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        step, length = step_of(text)
        for i, word in enumerate(tokens[: len(tokens) - need + 1]):
            opened.setdefault(word, []).append(F.struct(F.lit(number).alias("template"), F.lit(step).alias("step"), F.lit(length).alias("length")))
            index.append(F.struct(F.lit(word).alias("word"), F.lit(i).alias("i"), F.lit(number).alias("template"), F.lit(label).alias("label"),
                F.lit(tokens).alias("tokens"), F.lit(need).alias("need")))
    # One row per word of a template's prefix: its size is that of the templates.
    prefixes = docs.sparkSession.range(1).select(F.inline(F.array(*index)))
    # Only texts with a prefix word are cut into words, and only blocks around such words are made.
    rare = "|".join(sorted(opened, key=place.get))
    ws = docs.where(F.col("text").rlike(f"(?i)(?<![{INSIDE}])(?:{rare})(?![{INSIDE}])")).select("doc_id", "key", words(F.col("text")).alias("ws"))
    lead = F.create_map(*[x for w, kinds in opened.items() for x in (F.lit(w), F.array(*kinds))])
    hits = F.filter(F.transform("ws", lambda w, p: F.struct(w.alias("word"), p.alias("p"))), lambda h: h["word"].isin(list(opened)))

    def starts(hit: Column) -> Column:
        # The blocks that hold place p start at multiples of the step in (p - length, p].
        def of(t: Column) -> Column:
            low = F.greatest(F.lit(0).cast("long"), F.floor((hit["p"] - t["length"]) / t["step"]) + 1)
            return F.transform(F.sequence(low, F.floor(hit["p"] / t["step"])),
                lambda k: F.struct(t["template"].alias("template"), (k * t["step"]).cast("int").alias("start"), t["length"].alias("length")))

        return F.flatten(F.transform(F.element_at(lead, hit["word"]), of))

    def block(b: Column) -> Column:
        has = F.array_intersect(F.lit(order), F.slice("ws", b["start"] + 1, b["length"]))
        return F.struct(b["template"].alias("template"), b["start"].alias("start"), has.alias("has"))

    blocks = ws.select("doc_id", "key", F.inline(F.transform(F.array_distinct(F.flatten(F.transform(hits, starts))), block)))
    blocks = blocks.withColumn("size", F.size("has"))
    probes = blocks.select("*", F.posexplode("has").alias("j", "word"))
    rest = F.least(F.size("tokens") - F.col("i"), F.col("size") - F.col("j"))  # words that can still be shared, this one included
    joined = probes.join(F.broadcast(prefixes), ["word", "template"]).where((F.col("size") >= F.col("need")) & (rest >= F.col("need")))
    both = joined.withColumn("shared", F.size(F.array_intersect("has", "tokens"))).where(F.col("shared") >= F.col("need"))
    return both.select("doc_id", "key", "start", "template", "label", (F.col("shared") / F.size("tokens")).alias("containment")).distinct()


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): word count, places of the fixed phrases, labels of phrases and of matching blocks."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key("text"))
    places = phrase_places(F.col("text"))
    base = docs.select("doc_id", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), places.alias("places"))
    found = matches(docs, templates, threshold).groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    same = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["key"] == found["key"])
    both = base.join(found, same, "left").select(base["doc_id"], "n_words", "places", "found", "score")
    at, base_labels = F.col("places.at"), F.array_distinct("places.label")
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('{}', string_split('{}', ' '), {}, {})".format(label, " ".join(sorted(set(text.split()))), *step_of(text)) for label, text in TEMPLATES)
    lists = []
    for phrase, label in PHRASES:
        test = " and ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        lists.append(f"[{{'at': i - 1, 'label': '{label}'}} for i in range(1, len(ws) + 1) if {test}]")
    return f"""
with t(label, tokens, step, size) as (values {rows}),
d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
w as (select doc_id, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from d),
b as (select doc_id, len(ws) as n_words, {' || '.join(lists)} as places from w),
l as (select doc_id, label, tokens, ws[s + 1 : s + size] as part from (select *, unnest(range(0, len(ws), step)) as s from w, t)),
m as (select doc_id, label, len(list_intersect(tokens, part)) / len(tokens) as c from l where len(list_intersect(tokens, part)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
f as (select doc_id, list(distinct label) as found, max(c) as score from m group by doc_id)
select b.doc_id, cast(n_words as bigint) as n_words, cast(len(places) as bigint) as n_base,
 cast(list_min([x.at for x in places]) as bigint) as first_word, cast(list_max([x.at for x in places]) as bigint) as last_word,
 coalesce(array_to_string(list_sort(list_distinct([x.label for x in places])), ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct([x.label for x in places] || coalesce(found, []))), ','), '') as labels,
 coalesce(score, 0.0) as score
from b left join f using (doc_id)"""


SQL = _sql()
