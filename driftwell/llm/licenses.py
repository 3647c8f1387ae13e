"""License scans by exact set-similarity join (operator 3), in DataFrame operations only.

Blocks are the lines of a text and, as notices are wrapped, all runs of its
words across lines that are a little longer than the template. Templates are
the sentences of license notices; all are sets of words. A block matches if it
holds at least ``threshold`` of a template's words. Template words are put in one global order, rarest in the
corpus first; a match must then share a word within both prefixes, have
enough words, and have enough words left from the first shared position on.
Pairs that pass these filters are verified on the whole sets, so none is lost
and none is false.

Besides, places where a base phrase's words stand consecutively are counted
over the words of the whole text.

Null and empty texts have no words, empty labels, null positions and score 0.
Repeated rows give repeated results; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_of

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    # Short notices, without the words that differ between versions and clauses.
    *(("cc", f"Licensed under CC BY {version}") for version in ("4.0", "3.0", "2.5", "2.0", "1.0")),
    ("cc", "Licensed under a Creative Commons Attribution License"),
    ("cc", "CC0 1.0 Universal"),
    ("bsd", "Under the BSD License"),
    ("isc", "Under the ISC License"),
    ("mpl", "Under the Mozilla Public License"),
    ("mpl", "Licensed under MPL"),
    ("gpl", "Licensed under GPL"),
    ("agpl", "Under the GNU Affero General Public License"),
    ("agpl", "Licensed under AGPL"),
    ("lgpl", "Under the GNU Lesser General Public License"),
    ("lgpl", "Licensed under LGPL"),
]
THRESHOLD = 0.9
#: Words of a text whose runs are compared in one row.
RUN_STARTS = 256
#: Between words, in a text whose case still stands.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


def run_length(text: str) -> int:
    """Words of a run that is compared with a template: the template's, and a quarter or four besides."""
    n = len(re.findall(r"[0-9a-z]+", text.lower()))
    return n + max(4, n // 4)


def spaced(text: Column) -> Column:
    """The words of a text with one space before, between and after them; one space if there are none."""
    words = F.trim(F.regexp_replace(text, GAP, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_array(line: Column) -> Column:
    """Words of a line, A-Z lowered."""
    return F.split(F.trim(F.translate(F.regexp_replace(line, GAP, " "), UPPER, LOWER)), " ")


def phrase_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(key columns, n_words, n_base, first_word, last_word, base): places of the phrases."""
    rows = docs.withColumn("s", spaced(F.col("t")))
    for k, phrase in enumerate(phrases):
        cut = F.split("s", f"(?i)(?<= ){phrase}(?= )", -1)
        rows = rows.withColumn(f"c{k}", F.when(F.lower("s").contains(phrase.split()[-1]), cut))
        before_last = F.substring(F.col("s"), F.lit(1), F.length("s") - F.length(F.element_at(f"c{k}", -1)) - len(phrase))
        found = F.size(f"c{k}") > 1
        rows = (
            rows.withColumn(f"n{k}", F.when(found, F.size(f"c{k}") - 1).otherwise(0))
            .withColumn(f"f{k}", F.when(found, spaces(F.element_at(f"c{k}", 1)) - 1))
            .withColumn(f"l{k}", F.when(found, spaces(before_last) - 1))
        )
    some = [F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]
    return rows.select(
        "doc_id",
        "h",
        (spaces(F.col("s")) - 1).cast("long").alias("n_words"),
        sum(F.col(f"n{k}") for k in range(len(phrases))).cast("long").alias("n_base"),
        F.array_min(F.array(*(F.col(f"f{k}") for k in range(len(phrases))))).cast("long").alias("first_word"),
        F.array_max(F.array(*(F.col(f"l{k}") for k in range(len(phrases))))).cast("long").alias("last_word"),
        F.array_compact(F.array(*some)).alias("base"),
    )


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The template words by how often the corpus holds them, rarest first.

    One row for each template word reaches the driver, whatever the corpus holds.
    """
    found = (
        docs.select(F.explode(F.split(F.lower(spaced(F.col("t"))), " ")).alias("w"))
        .where(F.col("w").isin(words))
        .groupBy("w").count().collect()
    )
    seen = {r["w"]: r["count"] for r in found}
    return sorted(words, key=lambda w: (seen.get(w, 0), w))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(doc_id, h, label, containment, copies): every line, and every place of runs across lines, that holds enough of a template.

    The copies of a key are at least as many as the rows of ``docs`` that have it.
    """
    sets = [template_words(text) for _, text in templates]
    order = word_order(docs, sorted({w for s in sets for w in s}))
    rank = {w: k for k, w in enumerate(order, 1)}
    index, whole, probe = [], [], set()
    for k, (words, (label, text)) in enumerate(zip(sets, templates, strict=True)):
        ranks, need = sorted(rank[w] for w in words), math.ceil(threshold * len(words) - 1e-9)
        whole.append(f"({k}, '{label}', array({', '.join(map(str, ranks))}))")
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append(f"({k}, {r}, {at}, {len(ranks)}, {need}, {run_length(text)})")
            probe.add(order[r - 1])
    spark = docs.sparkSession
    prefixes = spark.sql(f"select * from values {', '.join(index)} as p(template, rank, at, size, need, run)")
    verify = spark.sql(f"select * from values {', '.join(whole)} as v(template, label, ranks)")
    vocabulary = F.array(*map(F.lit, order))
    likely = docs.where(F.arrays_overlap(F.split(F.lower(spaced(F.col("t"))), " "), F.array(*map(F.lit, sorted(probe)))))
    lines = (
        likely.select("doc_id", "h", F.posexplode(F.split("t", "\n", -1)).alias("line", "text"))
        .withColumn("own", F.array_intersect(word_array(F.col("text")), vocabulary))
        .where(F.size("own") > 0)
        .select("doc_id", "h", "line", F.array_sort(F.transform("own", lambda w: F.array_position(vocabulary, w).cast("int"))).alias("block"))
    )
    at, size, need = F.col("at"), F.col("size"), F.col("need")
    pairs = (
        lines.select("doc_id", "h", "line", "block", F.posexplode("block").alias("place", "rank"))
        .join(F.broadcast(prefixes), "rank")
        .where(F.size("block") >= need)
        .where(F.col("place") <= F.size("block") - need)
        .where(1 + F.least(size - at, F.size("block") - F.col("place")) - 1 >= need)
        .groupBy("doc_id", "h", "line", "template", "block", "need").agg(F.count("*").alias("copies"))
    )
    in_lines = pairs.join(F.broadcast(verify), "template").withColumn("shared", F.size(F.array_intersect("block", "ranks")))
    in_runs = run_matches(likely, order, prefixes, verify, max((run_length(text) for _, text in templates), default=1))
    return (
        in_lines.select("doc_id", "h", "label", "shared", "need", "ranks", "copies").unionByName(in_runs.withColumn("copies", F.lit(1).cast("long")))
        .where("shared >= need")
        .select("doc_id", "h", "label", (F.col("shared") / F.size("ranks")).alias("containment"), "copies")
    )


def run_matches(docs: DataFrame, order: list[str], prefixes: DataFrame, verify: DataFrame, longest: int) -> DataFrame:
    """(doc_id, h, label, shared, need, ranks): most words that a run around a template's prefix word shares with it.

    A text of several lines is cut into parts that overlap by the longest run, so that no run is lost and no row is
    longer than ``RUN_STARTS + longest`` words. A run that matches holds a prefix word, begins at most its length before
    that word, and may as well begin at a template's word.
    """
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(RUN_STARTS))
    places = F.transform("words", lambda w, k: F.struct(k.alias("at"), w.alias("w")))
    ranked = F.transform("own", lambda x: F.struct(x["at"].alias("at"), F.array_position(F.array(*map(F.lit, order)), x["w"]).cast("int").alias("rank")))
    parts = (
        docs.where(F.col("t").contains("\n"))
        .select("doc_id", "h", word_array(F.col("t")).alias("words"))
        .select("doc_id", "h", F.explode(F.transform(starts, lambda k: F.slice("words", k + 1, F.lit(RUN_STARTS + longest)))).alias("words"))
        .withColumn("own", F.filter(places, lambda x: x["w"].isin(order)))
        .where(F.size("own") > 0)
        .select("doc_id", "h", ranked.alias("part"))
    )
    hit, run = F.col("hit"), F.col("run")
    near = F.filter("part", lambda x: (x["at"] > hit - run) & (x["at"] < hit + run) & F.array_contains("ranks", x["rank"]))
    within = lambda a: F.filter("near", lambda x: (x["at"] >= a["at"]) & (x["at"] < a["at"] + run))
    sizes = F.transform(F.filter("near", lambda a: a["at"] <= hit), lambda a: F.size(F.array_distinct(F.transform(within(a), lambda x: x["rank"]))))
    return (
        parts.select("doc_id", "h", "part", F.inline("part").alias("hit", "rank"))
        .join(F.broadcast(prefixes), "rank")
        .where(F.size("part") >= F.col("need"))
        .join(F.broadcast(verify), "template")
        .withColumn("near", near)
        .where(F.size("near") >= F.col("need"))
        .select("doc_id", "h", "label", F.array_max(sizes).alias("shared"), "need", "ranks")
    )


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (doc_id, h, ...) left joined with ``found`` (doc_id, h, more, containment, matches), null ids meeting null ids.

    ``matches`` is at least the number of rows of a key. Keys of over 1/50,000 of all matches, and of over 1,000,
    are at most 50,000 and come by broadcast; their rows are then spread, so that no task gathers the equal rows of one id.
    """
    total = found.agg(F.sum("matches")).first()[0] or 0
    often = F.col("matches") > max(1000, total // 50_000)
    own = lambda df: df.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
    told = own(found).select("none", "id", "h", F.struct("more", "containment").alias("f"), "matches")
    common = told.where(often).select("none", "id", "h", F.col("f").alias("common"))
    marked = own(rows).join(F.broadcast(common), ["none", "id", "h"], "left")
    spread = marked.withColumn("spread", F.when(F.col("common").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(0))
    rare = told.where(~often).select("none", "id", "h", F.lit(0).cast("long").alias("spread"), "f")
    joined = spread.join(rare, ["none", "id", "h", "spread"], "left").withColumn("f", F.coalesce("common", "f"))
    return joined.select(*rows.columns, F.col("f.more").alias("more"), F.col("f.containment").alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: words, base phrase places, labels and score.

    The score is 1 with a base phrase, else the largest containment found, else 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    found = materialise(
        template_matches(rows, templates, threshold)
        .groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"), F.sum("copies").alias("matches"))
    )
    none = F.array().cast("array<string>")
    joined = with_found(phrase_places(rows, phrases), found)
    base = F.array_sort("base")
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches in each document."""
    return scan(table(spark, sf_dir, "documents"))


def oracle(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by comparing every line with every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lists = [template_words(text) for _, text in templates]
    values = ", ".join(f"('{label}', {words}, {math.ceil(threshold * len(words) - 1e-9)})" for (label, _), words in zip(templates, lists, strict=True))
    places, labels = [], []
    for phrase, label in phrases.items():
        parts = phrase.split()
        test = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"list_filter(range(len(w)), lambda i: {test})")
        labels.append(f"case when len({places[-1]}) > 0 then '{label}' end")
    return f"""
with d as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') as w from documents),
b as (select doc_id, len(w) as n_words, {' || '.join(places)} as pos,
  list_filter([{', '.join(labels)}], lambda x: x is not null) as base from d),
t(label, words, need) as (values {values}),
l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
k as (select doc_id, list_distinct(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{word}')) as w from l),
m as (select doc_id, list_distinct(list(label)) as more, max(len(list_intersect(w, words)) / len(words)) as c
  from k, t where len(list_intersect(w, words)) >= need group by doc_id)
select doc_id, n_words, len(pos) as n_base, list_min(pos) as first_word, list_max(pos) as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') as labels,
  case when len(pos) > 0 then 1.0::double else coalesce(c, 0)::double end as score
from b left join m using (doc_id)"""
