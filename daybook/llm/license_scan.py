"""Licence scans with a positional index of rare words.

Templates are openings and whole notices of public licences; a label may have several. Every word of a template is posted
with its place in it. The document frequency of each posted word is counted over all documents, and only words that few
documents have are looked up, all of them. A word of the file at place p that a template has at place q votes for the
template lying at p - q. A template is reported if its mandatory key phrase stands in the file word for word and the
votes for the same lie reach ``MIN_SHARE`` of the template's rare words.

Three fixed phrases are found by themselves, wherever their words stand consecutively (the base labels).

Only DataFrame operations are used. Texts are cut into words in the scan; what moves are places of rare words of the
files that have any. Templates are a parameter, so their postings are a bounded table and are broadcast.

Defined cases: null and empty texts have no words and no labels; texts of any length are scanned whole; a notice that repeats in a file gives its label once
and every place; a file may get several labels; rows that repeat are scanned alike, each for itself; with no documents
there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import bare, stage, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
MAX_DF_SHARE = 0.1
MIN_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.notice.lower())

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: Openings, statements and whole notices of public licences, each with the phrase it can't do without.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "www apache org licenses license 2 0"),
    Template("gpl-3.0", "Licensed under the GNU General Public License version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "Licensed under the GNU General Public License version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "free software foundation either version 3 of the license"),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "free software foundation either version 2 of the license"),
    Template("lgpl", "Licensed under the GNU Lesser General Public License version", "gnu lesser general public license"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version", "gnu lesser general public license as published"),
    Template("agpl-3.0", "Licensed under the GNU Affero General Public License version 3", "gnu affero general public license"),
    Template("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu affero general public license as published"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international"),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0 international"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "shall be included in all copies or substantial portions of the software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions of source code must retain the above copyright notice"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    Template("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mozilla org mpl 2 0"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("cc0-1.0", "has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license version 1 0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse public license"),
)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(bare(text), UPPER, LOWER), NOT_WORD, -1), "")


def phrase_places(w: Column, phrase: str) -> Column:
    """Where the words of the phrase stand consecutively, from 0. The search runs only where its longest word occurs."""
    parts = phrase.split()
    longest = max(parts, key=len)
    starts = F.transform(_positions(w, longest), lambda i: i - parts.index(longest))
    here = lambda i: F.slice(w, i + 1, len(parts)) == F.array(*[F.lit(p) for p in parts])
    return F.filter(F.filter(starts, lambda i: i >= 0), here)


def _positions(w: Column, word: str) -> Column:
    marked = F.transform(w, lambda x, i: F.when(x == word, i))
    return F.when(F.array_contains(w, word), F.array_compact(marked)).otherwise(F.array().cast("array<int>"))


def _lies(w: Column, k: int, t: Template) -> Column:
    """Where the first word of template k would stand, for each place of its key phrase."""
    return F.transform(phrase_places(w, t.key), lambda p: F.struct(F.lit(k).alias("template"), (p - t.key_at).alias("at")))


def word_ranks(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(word, idf): the templates' words that at most ``MAX_DF_SHARE`` of the documents have (five may in any case)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    counted = docs.select(F.explode(F.array_append(F.array_intersect(file_words(F.col("text")), known), F.lit(""))).alias("word")).groupBy("word").count()
    n = counted.where("word = ''").select(F.col("count").alias("n"))
    rare = counted.where("word <> ''").crossJoin(F.broadcast(n)).where(F.col("count") <= F.greatest(F.lit(5), F.lit(MAX_DF_SHARE) * F.col("n")))
    return rare.select("word", F.log((F.col("n") + 1) / (F.col("count") + 0.5)).alias("idf"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base (struct of label and places), found (array of structs label, start, share).

    docs: doc_id, text. A row each for every row of docs."""
    ranks = stage(word_ranks(docs, templates).coalesce(1), "licence-words")  # no more rows than the templates have words
    idf = {r["word"]: r["idf"] for r in ranks.collect()}
    rare = [(k, w, q) for k, t in enumerate(templates) for q, w in enumerate(t.words) if w in idf]
    keys = F.array(*[F.lit(w) for w in sorted(idf)]) if idf else F.array().cast("array<string>")
    spark = docs.sparkSession
    w = F.col("_w")
    base = F.array(*[F.struct(F.lit(label).alias("label"), phrase_places(w, phrase).alias("places")) for phrase, label in BASE])
    places = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("p"), x.alias("word"))), lambda h: F.array_contains("_own", h["word"]))
    lies = F.flatten(F.array(*[_lies(w, k, t) for k, t in enumerate(templates)]))
    files = docs.select("doc_id", file_words(F.col("text")).alias("_w")).withColumn("_own", F.array_intersect("_w", keys))
    files = files.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.filter(base, lambda b: F.size(b["places"]) > 0).alias("base"),
        F.when(F.size("_own") > 0, places).alias("hits"), F.when(F.size("_own") > 0, lies).alias("keys"),
    )
    files = stage(files.withColumn("row", F.monotonically_increasing_id()), "licence-files")
    posted = spark.createDataFrame(rare, "template int, word string, q int")
    with_key = files.where(F.size("keys") > 0)
    votes = with_key.select("row", F.inline("hits")).join(F.broadcast(posted), "word").select("row", "template", (F.col("p") - F.col("q")).alias("at"), F.lit(1).alias("vote"), F.lit(0).alias("key"))
    marks = with_key.select("row", F.inline("keys")).select("row", "template", "at", F.lit(0).alias("vote"), F.lit(1).alias("key"))
    laid = votes.unionByName(marks).groupBy("row", "template", "at").agg(F.sum("vote").alias("votes"), F.max("key").alias("key"))
    about = spark.createDataFrame([(k, t.label, sum(x in idf for x in t.words)) for k, t in enumerate(templates)], "template int, label string, of int")
    laid = laid.where("key = 1").join(F.broadcast(about), "template").withColumn("share", F.when(F.col("of") > 0, F.col("votes") / F.col("of")).otherwise(F.lit(1.0))).where(F.col("share") >= MIN_SHARE)
    # One lie for each label: at most as many as there are templates.
    best = laid.groupBy("row", "label").agg(F.max(F.struct("share", (-F.col("at")).alias("s"))).alias("b"))
    found = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", (-F.col("b.s")).alias("start"), F.col("b.share").alias("share")))).alias("found"))
    return files.select("row", "doc_id", "n_words", "base").join(found, "row", "left").drop("row")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.flatten(F.transform("base", lambda b: b["places"]))
    base = F.transform("base", lambda b: b["label"])
    own = F.coalesce(F.transform("found", lambda f: f["label"]), F.array().cast("array<string>"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))).alias("score"),
    )


def op7_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    posted = ", ".join(f"({k}, '{w}', {q})" for k, t in enumerate(templates) for q, w in enumerate(t.words))
    phrases = [("base", label, -1, phrase, 0) for phrase, label in BASE] + [("key", t.label, k, t.key, t.key_at) for k, t in enumerate(templates)]
    listed = ", ".join(f"('{kind}', '{label}', {k}, {phrase.split()!r}, {at})" for kind, label, k, phrase, at in phrases)
    return rf"""
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
w AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM t),
v(template, word, q) AS (VALUES {posted}), ph(kind, label, template, phrase, key_at) AS (VALUES {listed}),
places AS MATERIALIZED (SELECT w.r, kind, label, template, w.p, w.p - key_at AS lie FROM w JOIN ph ON w.word = phrase[1] JOIN t ON t.r = w.r WHERE t.w[w.p + 1:w.p + len(phrase)] = phrase),
n AS (SELECT count(*) AS n FROM t), df AS (SELECT word, count(DISTINCT r) AS c FROM w WHERE word IN (SELECT word FROM v) GROUP BY word),
idf AS (SELECT word FROM df, n WHERE c <= greatest(5, {MAX_DF_SHARE} * n)),
size AS (SELECT template, count(*) AS size FROM v JOIN idf USING (word) GROUP BY template),
votes AS (SELECT r, template, p - q AS lie, count(*) AS votes FROM w JOIN idf USING (word) JOIN v USING (word) GROUP BY ALL),
own AS (SELECT k.r, k.label, max(coalesce(votes / size, CASE WHEN size IS NULL THEN 1.0 ELSE 0.0 END)) AS share
        FROM (SELECT DISTINCT r, label, template, lie FROM places WHERE kind = 'key') k LEFT JOIN size USING (template) LEFT JOIN votes USING (r, template, lie) GROUP BY k.r, k.label),
held AS (SELECT * FROM own WHERE share >= {MIN_SHARE}),
labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM held UNION SELECT r, label FROM places WHERE kind = 'base') GROUP BY r),
base AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places WHERE kind = 'base' GROUP BY r),
best AS (SELECT r, least(1.0, max(share)) AS score FROM held GROUP BY r)
SELECT doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.b AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(labels.labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM t LEFT JOIN base USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)
"""
