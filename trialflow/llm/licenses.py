"""License scan: a trained paragraph classifier, in DataFrame functions and Spark ML only.

Paragraphs (lines, and wrapped lines joined up to a blank one) are classified by a multinomial logistic regression over word uni- and
bigrams whose weights the L1 penalty keeps sparse. It learns families from templates and
ordinary paragraphs of the corpus, a temperature is calibrated on paragraphs it has not
seen, and an unsure family counts as unknown. A comparison with the family's templates
confirms predictions. Paragraphs without any weighted term all get the same prediction, so
only those with one are scored; that changes no result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.session import materialized

# Names of license families, and sentences their texts or notices contain.
FAMILIES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["the BSD 3-Clause License", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0 Universal", "has waived all copyright and related rights under the CC0 public domain dedication"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "isc": ["the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPL-3.0"],
    "mit": ["the MIT License", "MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"],
    "proprietary": ["Copyright. All rights reserved", "This document is proprietary and confidential, no license is granted"],
    "unlicense": ["the Unlicense", "This is free and unencumbered software released into the public domain"],
}
NOTICES = ["", "Licensed under ", "Released under ", "This work is licensed under ", "This software is distributed under ", "Published under the terms of ",
           "SPDX-License-Identifier: ", "License: ", "Available under ", "This project uses "]
# Sentences with like words that are no notices.
OTHER = ["the driver has a license plate", "a licensed driver", "you must license your dog", "the general public was invited", "version 3 of the report",
         "version 2.0 is out", "the free city", "a common source of errors", "a creative public", "permission to enter was granted", "software for any purpose"]

# Stop words.
STOP = ["and", "any", "are", "but", "for", "from", "has", "have", "into", "not", "that", "the", "this", "was", "with", "you", "your"]

# Wording of notices; what holds it is no ordinary paragraph.
NOTICE = r"under the|under a|under an|(licen[sc]ed|released|distributed|published|available) under|spdx|rights reserved|hereby|licen[sc]e:|copyright (\(c\)|©|\d)"
# Words of licences that ordinary paragraphs may hold.
TELLING = "licen|copyright|gnu|spdx|rights reserved|creative commons|cc by|cc0|permission"

#: most ordinary paragraphs a fit learns from, as many that hold words of licences, and terms it knows
SAMPLE, TERMS = 2000, 4096
SURE, CONFIRMED = 0.5, 0.6


def words(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")


def terms(column: Column) -> Column:
    """Distinct words that are not stop words, and pairs of neighbouring words."""
    w = words(column)
    telling = F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(*STOP))
    pairs = F.transform(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(0))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(F.concat(telling, F.filter(pairs, lambda p: p.contains(" "))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (line number from 0) and line; null texts have none."""
    return docs.select(F.col("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "line"))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, lines, line: runs of more than one line up to a blank one, joined.

    ``paragraph`` is the number of the first line. A line without letters and digits, such
    as the bare comment mark between paragraphs of a file header, is blank.
    """
    rows = docs.select(*docs.columns, F.split(F.col("text").cast("string"), "\n").alias("p_all"))
    rows = rows.withColumn("p_full", F.transform("p_all", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    at = F.sequence(F.lit(1), F.size("p_all"))

    def full(i):
        return F.coalesce(F.get("p_full", i - 1), F.lit(False))

    first, last = F.filter(at, lambda i: full(i) & ~full(i - 1)), F.filter(at, lambda i: full(i) & ~full(i + 1))
    rows = rows.where("p_all IS NOT NULL").withColumn("p_run", F.explode(F.arrays_zip(first.alias("first"), last.alias("last")))).where("p_run.last > p_run.first")
    size = F.col("p_run.last") - F.col("p_run.first") + 1
    return rows.select(*docs.columns, (F.col("p_run.first") - 1).alias("paragraph"), size.alias("lines"), F.array_join(F.slice("p_all", F.col("p_run.first"), size), " ").alias("line")).drop("text")


def candidates(docs: DataFrame) -> DataFrame:
    """Lines and passages of ``docs`` (doc_id, text) with ``of_text``, by which they belong together."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("of_text"))
    lines = docs.select("doc_id", "of_text", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "of_text", "paragraph", F.lit(1).alias("lines"), "line").unionByName(passages(docs))


@dataclass
class Classifier:
    """The fitted term vectors and regression, both JVM models, and the calibrated temperature."""

    names: list[str]
    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    temperature: float = 1.0

    def used(self) -> list[str]:
        """Terms that speak for a family or against none.

        Without any of these, no family has more than its bias and none has that at least.
        """
        weights = self.regression.coefficientMatrix.toArray()
        tells = (weights[1:] > 0).any(axis=0) | (weights[0] < 0)
        return sorted(self.vectors.vocabulary[j] for j in tells.nonzero()[0])

    def pattern(self) -> str:
        """A pattern that finds one of the used terms in a text in lower case, grouped by first letter."""
        parts = []
        for first, some in groupby(self.used(), key=lambda t: t[0]):
            rest = "|".join(t[1:].replace(" ", "[^a-z0-9]+") for t in sorted(some, reverse=True))
            parts.append(f"{first}(?:{rest})")
        # without any used term the pattern matches nothing
        return f"(?<![a-z0-9])(?:{'|'.join(parts) or '(?!)'})(?![a-z0-9])"

    def logits(self, rows: DataFrame) -> DataFrame:
        """Rows with a column ``z``, the array of the families' scores, instead of ``terms``."""
        raw = self.regression.transform(self.vectors.transform(rows))
        return raw.withColumn("z", vector_to_array("rawPrediction")).select(*[c for c in rows.columns if c != "terms"], "z")


def softmax(logits: Column, temperature: float) -> Column:
    raw = F.transform(logits, lambda x: F.exp(x / temperature))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def _sampled_lines(docs: DataFrame, most: int) -> DataFrame:
    """Distinct lines and passages of up to ``most`` texts by hash, and of as many that hold words of licences.

    Texts are chosen by their hashes alone, so that copies count once and no task holds
    more than a bounded number of them.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    own = F.xxhash64(F.lit(5), "text")
    seen = texts.select(own.alias("h"), F.lower("text").rlike(TELLING).alias("telling")).distinct()
    chosen = seen.orderBy("h").limit(most).unionByName(seen.where("telling").orderBy("h").limit(most)).select("h").distinct()
    # at most twice ``most`` hashes
    few = texts.withColumn("h", own).join(F.broadcast(chosen), "h", "left_semi")
    return candidates(few).where(F.length("line") > 0).select("line").distinct()


def _examples(spark: SparkSession, docs: DataFrame, most: int) -> DataFrame:
    """line, family, held: templates under all notices, like sentences, and ordinary paragraphs."""
    rows = [(n + t + end, k, i % 4 == 3) for k, texts in FAMILIES.items() for t in texts for i, (n, end) in enumerate([(n, e) for n in NOTICES for e in ("", ".")])]
    rows += [(x + e, "none", i % 4 == 3) for i, (x, e) in enumerate([(x, e) for x in OTHER for e in ("", ".", " and so on")])]
    known = spark.createDataFrame(rows, "line string, family string, held boolean")
    every = _sampled_lines(docs, most).select("line", F.xxhash64(F.lit(5), "line").alias("h"))
    telling, low = F.lower("line").rlike(TELLING), F.lower("line")
    mine = F.array_distinct(words(F.col("line")))
    like = F.greatest(*[F.size(F.array_intersect(own, mine)) / F.size(own) for own in (F.array_distinct(words(F.lit(t))) for texts in FAMILIES.values() for t in texts)])
    near = every.where(telling & ~low.rlike(NOTICE)).where(like < SURE).orderBy("h", "line").limit(most)
    plain = every.where(~telling).orderBy("h", "line").limit(most).unionByName(near)
    plain = plain.select("line", F.lit("none").alias("family"), (F.pmod("h", F.lit(4)) == 3).alias("held"))
    return known.unionByName(plain)


def fit(docs: DataFrame, most: int = SAMPLE) -> Classifier:
    """Learn from templates and up to ``most`` ordinary paragraphs of the documents.

    As many again hold words of licences, but neither a notice's wording nor half of a
    template's words. The examples are bounded in number, so they are one partition.
    """
    spark = docs.sparkSession
    names = ["none", *FAMILIES]
    rows = _examples(spark, docs, most).select("held", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")).alias("y"), terms(F.col("line")).alias("terms"))
    rows = materialized(rows.withColumn("label", F.col("y").cast("double") - 1).coalesce(1))
    vectors = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=TERMS, minDF=2, binary=True).fit(rows.where("NOT held"))
    # every family weighs alike, and so do the examples of none together
    sizes = rows.where("NOT held").groupBy("label").count().withColumn("weight", 100.0 / F.col("count")).drop("count")
    learn = vectors.transform(rows.where("NOT held")).join(F.broadcast(sizes), "label").select("label", "features", "weight").coalesce(1).persist()
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=4e-3, elasticNetParam=1.0, maxIter=60).fit(learn)
    learn.unpersist()
    found = Classifier(names, vectors, model)
    unseen = materialized(found.logits(rows.where("held").select(F.col("y").cast("int").alias("y"), "terms")))
    steps = (0.5, 0.7, 1.0, 1.4, 2.0)
    loss = [F.avg(-F.log(F.greatest(F.element_at(softmax(F.col("z"), t), F.col("y")), F.lit(1e-12)))) for t in steps]
    got = unseen.agg(*[x.alias(f"l{i}") for i, x in enumerate(loss)]).first()
    found.temperature = min(zip(got, steps, strict=True), key=lambda x: x[0] if x[0] is not None else math.inf)[1]
    return found


def license_paragraphs(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed and lines of each licence paragraph.

    Every line is read by itself, and wrapped lines up to a blank one also as one
    paragraph of so many ``lines`` that has the number of its first line. The latter is
    left out if one of its lines is reported for the same family with no less similarity,
    and, without a sure family, if any of its lines is reported.

    A paragraph is reported unless "none" is its likeliest class with at least ``SURE``;
    its family is the likeliest one, or "unknown" below ``SURE``. ``similarity`` is the
    largest share of a template's words that the paragraph holds, ``confirmed`` whether
    that reaches ``CONFIRMED``. Null and empty texts have no licence paragraphs, repeated
    rows report each, other columns are ignored, an empty table gives an empty result.
    """
    holds = model.pattern()
    rows = candidates(docs.where(F.lower(F.col("text").cast("string")).rlike(holds))).where(F.lower("line").rlike(holds))
    # few rows are left; written tables keep the long expressions apart
    rows = materialized(model.logits(rows.withColumn("terms", terms(F.col("line")))))
    rows = materialized(rows.withColumn("p", softmax(F.col("z"), model.temperature)).drop("z"))
    top = F.array_max("p")
    name = F.element_at(F.array(*[F.lit(n) for n in model.names]), F.array_position("p", top).cast("int"))
    rows = rows.select("doc_id", "of_text", "paragraph", "lines", "line", name.alias("likeliest"), top.alias("probability"))
    rows = rows.where(~((F.col("likeliest") == "none") & (F.col("probability") >= SURE)))
    mine = F.array_distinct(words(F.col("line")))
    held = [(family, F.array_distinct(words(F.lit(text)))) for family, texts in FAMILIES.items() for text in texts]
    shares = F.greatest(*[F.when(F.col("likeliest") == family, F.size(F.array_intersect(own, mine)) / F.size(own)).otherwise(0.0) for family, own in held])
    family = F.when((F.col("probability") >= SURE) & (F.col("likeliest") != "none"), F.col("likeliest")).otherwise("unknown")
    rows = materialized(rows.select("doc_id", "of_text", "paragraph", "lines", family.alias("family"), F.round("probability", 6).alias("probability"), F.round(shares, 6).alias("similarity")))
    x, y = rows.alias("x"), rows.where("lines = 1").alias("y")
    inside = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.of_text") == F.col("y.of_text")) & (F.col("x.lines") > 1)
    inside &= F.col("y.paragraph").between(F.col("x.paragraph"), F.col("x.paragraph") + F.col("x.lines") - 1)
    says = (F.col("x.family") == "unknown") | ((F.col("x.family") == F.col("y.family")) & (F.col("y.similarity") >= F.col("x.similarity")))
    rows = x.join(y, inside & says, "left_anti")
    return rows.select("doc_id", "paragraph", "family", "probability", "similarity", ((F.col("similarity") >= CONFIRMED) & (F.col("family") != "unknown")).alias("confirmed"), "lines")
