"""License notices by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is joined, by hash and then by its words, to the places
of the same k-gram in license templates (a fixed, small list, hence broadcast). A match votes
for the diagonal ``place in text - place in template``. Neighbouring diagonals of one template
are merged, which bridges words that were put in or left out, and a merged span counts if enough
of the template's k-grams voted within a span not much longer than the template.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Words after A-Z are lower-cased (fixed pattern of the contract).
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted one by one (fixed values of the contract).
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Openings of public licenses and of the notices they ask for (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)
#: A span counts with this share of the template's k-grams, diagonals merge up to this distance.
LEAST_SHARE, NEAR = 0.7, 2


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    base: bool


def templates() -> list[Template]:
    both = [(label, text, True) for label, text in BASE_PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES]
    return [Template(n, label, tuple(text.split()), base) for n, (label, text, base) in enumerate(both)]


def template_grams(spark: SparkSession) -> DataFrame:
    rows = [(t.number, t.label, t.base, len(t.words) - K + 1, len(t.words), i, " ".join(t.words[i : i + K])) for t in templates() for i in range(len(t.words) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, length int, at int, gram string")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def grams(words: Column) -> Column:
    """The rolling K-grams of an array of words, joined by blanks."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (K - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, K)]))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty. Rows that share an id are read as parts of one document: words and places
    add up, and places count from the start of their own row; a null id is an id of its own.
    ``score`` is the largest share of a template's k-grams in a span that counts, else 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    sizes = docs.select("doc_id", F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long").alias("n_words"))

    # Votes are counted by row, so that copies of a row do not fill each other's phrases.
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORDS), F.lit(0)).alias("w"))
    places = words.select("doc_id", "row", F.posexplode(grams(F.col("w"))).alias("pos", "gram"))
    known = template_grams(documents.sparkSession).withColumn("h", F.xxhash64("gram"))
    hits = places.join(F.broadcast(known.withColumnRenamed("gram", "own")), (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("own")))
    votes = hits.groupBy("doc_id", "row", "template", "label", "base", "grams", "length", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )

    along = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True)) | F.col("base")
    spans = (
        votes.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(along))
        .groupBy("doc_id", "row", "template", "label", "base", "grams", "length", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + K).alias("end"), F.min("diagonal").alias("start"))
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    verified = spans.where(
        F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise((share >= LEAST_SHARE) & (F.col("end") - F.col("first") <= F.col("length") + 2 * NEAR))
    )
    found = verified.select("doc_id", F.lit(0).cast("long").alias("n_words"), "label", "base", F.col("start").cast("long").alias("start"), share.alias("share"))
    nothing = sizes.select("doc_id", "n_words", F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("double").alias("share"))

    base = F.when(F.col("base"), F.col("label"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        nothing.unionByName(found)
        .groupBy("doc_id")
        .agg(
            F.sum("n_words").alias("n_words"),
            F.count(base).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
    )
