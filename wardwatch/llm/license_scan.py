"""License phrases and notices by diagonal voting.

All rolling k-grams of a text's words (two words for phrases, five for
notices) are hashed and joined to the k-grams of the templates, a fixed table
that is broadcast.  A hit whose words are equal too votes for its diagonal,
the text position at which the template would begin; the votes of a diagonal
are one bit for each template position, so they are added up by ``bit_or``
before they are shuffled.

A phrase stands where all k-grams of its template meet on one diagonal: its
words are consecutive there.  A notice may have words put in or left out, so
the votes of neighbouring diagonals (up to ``DRIFT`` words further on) are
merged, and the span is verified: its k-grams, all of them equal word for
word, must cover ``COVERAGE`` of the template's words.  ``score`` is the
largest share of any template's words that is covered so.

Defined results: a null text counts as empty, without words, labels and
places, with score 0; null and repeated ids are kept, one row per input row;
equal rows have equal results; overlapping places all count; an empty table
gives an empty one; extra columns are ignored.  Built-in DataFrame functions
only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHRASE_GRAM, NOTICE_GRAM = 2, 5
DRIFT = 4
COVERAGE = 0.8
#: Votes are bits of a long, so templates have this many words at most.
MAX_TEMPLATE = 64

# The phrases and labels of the contract, and the opening words of public license notices.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "under the GNU General Public License, version 2"),
    ("gpl-3.0", "under the GNU General Public License, version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hash that stands for the line without a template; hits of it are told apart by their position too.
_END = -1
#: Letters beyond ASCII whose lower case is an ASCII letter; they stay letters of their own.
_NOT_ASCII = ("K", "İ")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATORS, text.lower()) if w]


def _gram(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(width)])


def template_positions(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(gram, template, label, phrase, width, full, place, said): one row per k-gram of a template; ``full`` is the template's number of words."""
    rows = []
    for number, (label, text, width) in enumerate([(*p, PHRASE_GRAM) for p in phrases] + [(*n, NOTICE_GRAM) for n in notices]):
        words = template_words(text)
        if not width <= len(words) <= MAX_TEMPLATE:
            raise ValueError(f"a template needs {width} to {MAX_TEMPLATE} words: {text!r}")
        rows += [(number, label, number < len(phrases), width, len(words), i, words[i : i + width]) for i in range(len(words) - width + 1)]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, width int, full int, place int, said array<string>")
    first = F.lit(0)
    return table.withColumn("gram", F.when(F.col("width") == PHRASE_GRAM, _gram(F.col("said"), first, PHRASE_GRAM)).otherwise(_gram(F.col("said"), first, NOTICE_GRAM)))


def _words(text: Column) -> Column:
    for letter in _NOT_ASCII:
        text = F.replace(text, F.lit(letter), F.lit("�"))
    return F.array_remove(F.split(F.lower(text), _SEPARATORS), "")


def _covered(votes: Column, width: Column) -> Column:
    """Bits of the template's words that the voting k-grams cover."""

    def spread(n: int) -> Column:
        bits = votes
        for j in range(1, n):
            bits = bits.bitwiseOR(F.shiftleft(votes, j))
        return bits

    return F.when(width == PHRASE_GRAM, spread(PHRASE_GRAM)).otherwise(spread(NOTICE_GRAM))


def diagonals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(row, doc_id, template, label, phrase, width, full, start, votes): the voted diagonals of each input row.

    Each row has one line more, with template -1 and its number of words as
    ``start``, so rows without votes stay.
    """
    at, words = F.col("at"), F.col("words")
    ends = docs.sparkSession.createDataFrame([(-1, None, False, 0, 0, 0, [], _END)], "template int, label string, phrase boolean, width int, full int, place int, said array<string>, gram long")
    templates = template_positions(docs.sparkSession, phrases, notices).unionByName(ends)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), _words(text).alias("words"))
    spots = rows.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at"))
    grams = F.when(at < F.size(words), F.array(_gram(words, at, PHRASE_GRAM), _gram(words, at, NOTICE_GRAM))).otherwise(F.array(F.lit(_END)))
    asked = spots.select("row", "doc_id", "words", "at", F.explode(grams).alias("gram"))
    hits = asked.join(F.broadcast(templates), "gram").where((F.slice(words, at + 1, F.col("width")) == F.col("said")) & ((F.col("template") < 0) == (at == F.size(words))))
    votes = hits.groupBy("row", "doc_id", "template", "label", "phrase", "width", "full", (at - F.col("place")).alias("start"))
    return votes.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("votes"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    near = Window.partitionBy("row", "template").orderBy("start").rangeBetween(0, drift)
    spans = diagonals(docs, id_col, text_col, phrases, notices).withColumn("merged", F.bit_or("votes").over(near))
    whole = F.bit_count("votes") == F.col("full") - F.col("width") + 1
    covered = F.bit_count(_covered(F.col("merged"), F.col("width"))) / F.col("full")
    place = F.when(F.col("phrase") & whole, F.col("start").cast("long"))
    found = F.when(F.when(F.col("phrase"), whole).otherwise(F.col("covered") >= coverage), F.col("label"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        spans.withColumn("covered", F.when(F.col("template") >= 0, covered))
        .withColumn("place", place)
        .groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("template") < 0, F.col("start"))).cast("long").alias("n_words"),
            F.count("place").alias("n_base"),
            F.min("place").alias("first_word"),
            F.max("place").alias("last_word"),
            listed(F.when(F.col("place").isNotNull(), F.col("label"))).alias("base_labels"),
            listed(found).alias("labels"),
            F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def oracle_sql() -> str:
    """The scan in DuckDB SQL: k-grams compared as lists of words, covered template words counted one by one."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(label, text, PHRASE_GRAM) for label, text in PHRASES] + [(label, text, NOTICE_GRAM) for label, text in NOTICES]
    values = ",\n  ".join(f"({i}, {quoted(label)}, {i < len(PHRASES)}, {width}, {quoted(text)})" for i, (label, text, width) in enumerate(rows))
    return rf"""
WITH said(n, label, phrase, width, text) AS (VALUES
  {values}),
t AS (SELECT n, label, phrase, width, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM said),
tg AS (SELECT n, label, phrase, width, len(w) AS whole, i AS place, w[i + 1:i + width] AS gram
       FROM (SELECT *, unnest(range(0, len(w) - width + 1)) AS i FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, width, i AS pos, w[i + 1:i + width] AS gram
       FROM (SELECT r, w, width, unnest(range(0, len(w) - width + 1)) AS i FROM d, (VALUES ({PHRASE_GRAM}), ({NOTICE_GRAM})) k(width))),
hits AS (SELECT DISTINCT r, n, label, phrase, tg.width, whole, pos - place AS start, place
         FROM dg JOIN tg ON dg.width = tg.width AND dg.gram = tg.gram),
spans AS (SELECT a.r, a.n, a.label, a.phrase, a.start, a.whole, count(DISTINCT h.place + j.j) AS covered,
                 count(DISTINCT h.place) FILTER (h.start = a.start) = a.whole - a.width + 1 AS full_
          FROM (SELECT DISTINCT r, n, label, phrase, width, whole, start FROM hits) a
          JOIN hits h ON h.r = a.r AND h.n = a.n AND h.start BETWEEN a.start AND a.start + {DRIFT}
          JOIN (SELECT unnest(range(0, {NOTICE_GRAM})) AS j) j ON j.j < a.width
          GROUP BY a.r, a.n, a.label, a.phrase, a.start, a.whole, a.width),
found AS (SELECT r, count(*) FILTER (phrase AND full_) AS n_base, min(start) FILTER (phrase AND full_) AS first_word,
                 max(start) FILTER (phrase AND full_) AS last_word,
                 list_sort(list(DISTINCT label) FILTER (phrase AND full_)) AS base,
                 list_sort(list(DISTINCT label) FILTER (CASE WHEN phrase THEN full_ ELSE covered >= {COVERAGE} * whole END)) AS labels,
                 max(covered / whole) AS score FROM spans GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)"""
