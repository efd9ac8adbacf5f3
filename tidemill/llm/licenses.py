"""License scan by diagonal voting, with DataFrame operations only.

All rolling word k-grams of all texts are joined to the places where the templates have
them. A match votes for the diagonal on which it lies (word in the text minus word in the
template); votes are added up by diagonal, diagonals next to each other are merged, and a
merged span is kept if the k-grams in it cover enough of the template. Short phrases are
found word by word beside that.

A text is read once. Its k-grams meet the templates where they are (the templates are
fixed and broadcast: some hundreds of rows); only one row for the text and one for each
match are shuffled, once, by a number of the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table

#: Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wordings of public licenses and of the lines that name them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

#: Words of a k-gram, diagonals between which there may be a gap, and the share of a template that a span must cover.
K, SLACK, COVERAGE = 5, 3, 0.8


def words_of(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    # the only two letters beyond ASCII whose small letter begins with one of ASCII
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _inner(parts: Column) -> Column:
    """Without the empty words that separators at either end leave."""
    first = (parts[0] == "").cast("int")
    last = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def _shifted(words: Column, k: int, n: Column) -> Column:
    """Each k words in a row, as structs: the lambdas that read them see nothing else of the text."""
    return F.arrays_zip(*(F.slice(words, i + 1, F.greatest(n - (k - 1), F.lit(0))).alias(f"w{i}") for i in range(k)))


def _phrase_starts(words: Column, n: Column, phrases: dict[str, str]) -> Column:
    """(start, label) of each place where a phrase stands; looked for where all of its words are."""
    def places(parts: list[str], label: str) -> Column:
        stands = lambda z: F.array(*(z[f"w{j}"] for j in range(len(parts)))) == F.array(*map(F.lit, parts))
        found = F.transform(_shifted(words, len(parts), n), lambda z, i: F.when(stands(z), F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))))
        has = [F.array_contains(words, w) for w in parts]
        return F.when(reduce(Column.__and__, has), F.array_compact(found)).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))

    found = [places(phrase.split(" "), label) for phrase, label in phrases.items()]
    return F.concat(*found)


def grams_of(templates, spark: SparkSession, k: int) -> DataFrame:
    """h (hash of a k-gram), tpl, label, length (words), tpos of each place in each template."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "tpl int, label string, text string")
    rows = rows.select("tpl", "label", _inner(words_of(F.col("text"))).alias("words"))
    rows = rows.select("tpl", "label", F.size("words").alias("length"), F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    return rows.select("tpl", "label", "length", F.posexplode(_hashes(F.col("words"), F.col("length"), k)).alias("tpos", "h"))


def _hashes(words: Column, n: Column, k: int) -> Column:
    """A hash of each k hashes of words in a row."""
    return F.transform(_shifted(words, k, n), lambda z: F.xxhash64(z))


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] | None = None, k: int = K, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), spans of every row.

    ``spans`` holds label, first, end (words, end exclusive) and covered (share of the
    template's words) of what is verified. A null text has no words; empty and very long
    texts are read whole. Repeated rows are rows of their own, also with a null doc_id;
    an empty table gives no rows, other columns are ignored. Templates of fewer than ``k``
    words match nothing.
    """
    require(docs, ("doc_id", "text"))
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("parts"))
    rows = rows.select("row", "doc_id", _inner(F.col("parts")).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("places", _phrase_starts(F.col("words"), F.col("n"), PHRASES if phrases is None else phrases))
    at, label = F.col("places.at"), F.col("places.label")
    doc = F.struct("doc_id", F.col("n").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_sort(F.array_distinct(label)).alias("base"))
    rows = rows.select("row", doc.alias("doc"), "n", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    # place 0 is the text's own
    rows = rows.select("row", "doc", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), _hashes(F.col("words"), F.col("n"), k))).alias("pos", "h"))
    met = rows.join(F.broadcast(grams_of(templates, spark, k)), "h", "left").where((F.col("pos") == 0) | F.col("tpl").isNotNull())
    # all that follows is grouped by the row first: this is the only shuffle
    met = met.select("row", F.when(F.col("pos") == 0, F.col("doc")).alias("doc"), "tpl", "label", "length", "tpos", (F.col("pos") - 1).alias("pos")).repartition("row")
    diagonals = met.groupBy("row", "tpl", "label", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.first("doc", True).alias("doc"), F.collect_set("tpos").alias("at"), F.min("pos").alias("first"), (F.max("pos") + k).alias("end"))
    along = Window.partitionBy("row", "tpl").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > slack).cast("int")
    merged = diagonals.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("nth", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("row", "tpl", "label", "length", "nth").agg(F.first("doc", True).alias("doc"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("first").alias("first"), F.max("end").alias("end"))
    share = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + (k - 1)))))) / F.col("length")
    span = F.when(F.col("tpl").isNotNull() & (share >= coverage), F.struct("label", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), share.alias("covered")))
    found = merged.groupBy("row").agg(F.first("doc", True).alias("doc"), F.array_sort(F.collect_list(span)).alias("spans"))
    return found.select("doc.*", "spans")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is the largest share of a template that the text covers; a phrase is covered whole."""
    found = scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base", F.col("spans.label")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("spans.covered")), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _next(n: int) -> str:
    """SQL: the next n words of a text, joined."""
    return " || ' ' || ".join(f"lead(word, {j}) OVER along" if j else "word" for j in range(n))


OP13_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS nr, doc_id, {_SQL_WORDS} AS words FROM documents),
placed AS (SELECT nr, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
grams AS (SELECT nr, pos, {", ".join(f"{_next(n)} AS g{n}" for n in sorted({len(p.split(" ")) for p in PHRASES} | {K}))} FROM placed WINDOW along AS (PARTITION BY nr ORDER BY pos)),
base AS ({" UNION ALL ".join(f"SELECT nr, pos AS place, {_quoted(label)} AS label FROM grams WHERE g{len(p.split(' '))} = {_quoted(p)}" for p, label in PHRASES.items())}),
t AS (
  SELECT tpl, label, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS tpos
  FROM (SELECT tpl, label, {_SQL_WORDS} AS words FROM (VALUES {", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))}) x(tpl, label, text))
), met AS (
  SELECT d.nr, g.tpl, g.label, g.n, d.pos, g.tpos, d.pos - g.tpos AS diagonal
  FROM grams d JOIN (SELECT tpl, label, n, tpos, {_next(K)} AS gram FROM t WINDOW along AS (PARTITION BY tpl ORDER BY tpos)) g ON d.g{K} = g.gram
), merged AS (
  SELECT nr, tpl, diagonal, sum(apart) OVER (PARTITION BY nr, tpl ORDER BY diagonal) AS nth
  FROM (SELECT nr, tpl, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY nr, tpl ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS apart FROM (SELECT DISTINCT nr, tpl, diagonal FROM met))
), spans AS (
  SELECT nr, label, covered FROM (
    SELECT nr, tpl, nth, label, count(DISTINCT tpos + o) / any_value(n) AS covered FROM met JOIN merged USING (nr, tpl, diagonal), range({K}) r(o) GROUP BY nr, tpl, nth, label)
  WHERE covered >= {COVERAGE}
)
SELECT doc_id, len(words) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(l.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN (SELECT nr, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY nr) b USING (nr)
LEFT JOIN (SELECT nr, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT nr, label FROM base UNION ALL SELECT nr, label FROM spans) GROUP BY nr) l USING (nr)
LEFT JOIN (SELECT nr, max(covered) AS score FROM spans GROUP BY nr) s USING (nr)
"""
