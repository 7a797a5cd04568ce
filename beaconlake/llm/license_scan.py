"""Licence scan: a trained paragraph classifier whose predictions a template comparison confirms.

Paragraphs (lines, joined where a line is only wrapped) are cut into overlapping stretches of ``STRETCH`` words, so a notice is found in a paragraph of any length.
A stretch is described by the words and word pairs of the templates that it holds; any other gram is in no family. So all stretches of the corpus
are learnt from, each distinct vector once with its count: a multinomial logistic regression sorts vectors into licence families and a class for all
other text. It learns from parts of the templates, from templates set among vectors of the corpus and from the corpus itself.
A family counts only if it is likelier against the unknown class than in any held-out vector of that class; then the stretch must
hold most of the word pairs of one of the family's templates.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

# Short notices by which public licences are named.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-only"),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "all-rights-reserved": ("All rights reserved.", "No part of this publication may be reproduced without prior written permission."),
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
CONFIRMED = 0.7
DIMS = 1 << 14
# Weight of all vectors of the corpus together; a made row of a family weighs 3.
CORPUS_WEIGHT = 2000.0
# Any STRETCH - STEP + 1 words in a row are whole in one stretch; the longest template has 16.
STRETCH, STEP = 48, 32
# A paragraph ends at a blank line, or where a line ends with a closing mark; other line ends are wraps, as notices in source files have them.
PARAGRAPH_END = r"(?<=[.!?…:;])[\"'”»)\]]*[ \t\r]*\n|\n[ \t\r]*\n"


@dataclass(frozen=True)
class Model:
    regression: LogisticRegressionModel
    thresholds: tuple[float, ...]  # by family, in the order of FAMILIES


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def literal_pairs(text: str) -> list[str]:
    """Distinct word pairs of a template."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def pairs(words: Column) -> Column:
    """Pairs of words in a row."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))


def template_share(grams: Column, family: str) -> Column:
    """Largest share of the word pairs of one of the family's templates that the vector holds."""
    shares = [F.size(F.array_intersect(grams, F.array(*map(F.lit, wanted)))) / len(wanted) for wanted in map(literal_pairs, TEMPLATES[family])]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def template_pairs(grams: Column, family: str) -> Column:
    """Word pairs of the vector that are in any of the family's templates."""
    return F.array_intersect(grams, F.array(*(F.lit(p) for p in dict.fromkeys(p for t in TEMPLATES[family] for p in literal_pairs(t)))))


def family_by_template(grams: Column, least: float) -> Column:
    """Number of the family whose templates fit best, 0 if none reaches ``least``."""
    best = F.array_max(F.array(*(F.struct(template_share(grams, f).alias("share"), F.lit(i).alias("family")) for i, f in enumerate(FAMILIES) if i)))
    return F.when(best["share"] >= least, best["family"]).otherwise(0)


def template_grams() -> Column:
    """All words and word pairs of the templates."""
    found = [g for texts in TEMPLATES.values() for t in texts for p in literal_pairs(t) for g in (*p.split(" "), p)]
    return F.array(*map(F.lit, dict.fromkeys(found)))


def featured(rows: DataFrame) -> DataFrame:
    """The rows with features of their grams."""
    return HashingTF(numFeatures=DIMS, binary=True, inputCol="grams", outputCol="features").transform(rows)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line for each paragraph with a word."""
    return docs.select("doc_id", F.posexplode(F.split(text_of(), PARAGRAPH_END)).alias("pos", "line")).filter(F.col("line").rlike(WORD))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, pos, at (a number of the paragraph), v of each of the overlapping stretches that cover all words of a paragraph; one stretch if it
    has no more than STRETCH words. v holds the stretch's template grams, sorted, joined by ``|``.

    The generators keep words and pairs from being made again for each stretch, which would take time with the square of a paragraph's length.
    """
    rest = ["doc_id", "pos", "at"]
    rows = paragraphs(docs).withColumn("at", F.monotonically_increasing_id())
    rows = rows.select(*rest, F.explode(F.array(tokens(F.col("line")))).alias("words"))
    rows = rows.select(*rest, F.explode(F.array(F.struct("words", pairs(F.col("words")).alias("pairs")))).alias("of"))
    rows = rows.select(*rest, "of", F.explode(F.array(F.array_sort(F.array_intersect(F.concat("of.words", "of.pairs"), template_grams())))).alias("known"))
    last = F.floor(F.greatest(F.size("of.words") - STRETCH + STEP - 1, F.lit(0)) / STEP).cast("int")
    cut = lambda k: F.array_intersect("known", F.concat(F.slice("of.words", 1 + k * STEP, STRETCH), F.slice("of.pairs", 1 + k * STEP, STRETCH - 1)))
    each = F.when(last == 0, F.array("known")).when(F.size("known") == 0, F.array_repeat(F.col("known"), last + 1)).otherwise(F.transform(F.sequence(F.lit(0), last), cut))
    return rows.select(*rest, F.explode(each).alias("v")).withColumn("v", F.concat_ws("|", "v"))


def grams() -> Column:
    return F.filter(F.split("v", r"\|"), lambda g: g != "")


def against_unknown(probability: Column, family: int) -> Column:
    """Probability of the family where the only other choice is the unknown class, so two notices in one stretch do not weaken each other."""
    p, unknown = F.get(probability, F.lit(family)), F.get(probability, F.lit(0))
    return F.coalesce(p / (p + unknown), F.lit(0.0))


def learn(found: DataFrame, contexts: int = 40) -> Model:
    """Train on pieces of the templates, on each template among the grams of vectors of the corpus (the ``contexts`` most frequent ones and
    as many that hold most grams) and on every vector of the corpus, weighted by the logarithm of its count.

    Vectors that hold a whole template get its family, those that hold most of one are left out, all others get the unknown class.
    A quarter of the distinct vectors, by hash, is held out to set each family's threshold.
    """
    spark = found.sparkSession
    own = found.groupBy("v").agg(F.count("*").alias("n")).select("v", "n", grams().alias("grams"))
    own = own.select("v", "n", "grams", family_by_template(F.col("grams"), 1.0).alias("label"), family_by_template(F.col("grams"), CONFIRMED).alias("near"))
    own = own.filter("label > 0 OR near = 0").select("v", "n", "grams", F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64("v"), F.lit(4)) == 0).alias("held"), F.log1p("n").alias("weight"))
    own = stored(own, "counted")
    total = own.filter("NOT held").agg(F.sum("weight")).first()[0] or 1.0
    plain = own.filter("label = 0 AND NOT held")
    frequent = plain.orderBy(F.desc("n"), "v").limit(contexts)
    full = plain.orderBy(F.desc(F.size("grams")), "v").limit(contexts)
    mixed = frequent.unionByName(full).select(F.col("grams").alias("context")).distinct()
    made = [(t, float(i)) for i, f in enumerate(FAMILIES) if i for t in TEMPLATES[f]]
    whole = spark.createDataFrame(made, "template string, label double").select(tokens(F.col("template")).alias("words"), "label")
    n = F.size("words")
    parts = F.expr("transform(sequence(0, size(words) div 3), d -> slice(words, 1 + cast(d as int), greatest(size(words) - 2 * cast(d as int), 2)))")
    noisy = F.expr("transform(sequence(1, 4), d -> concat(slice(array('the', 'work', 'of', 'file', 'under', 'project'), d, d), words, slice(array('copyright', 'see', 'for', 'details', 'by', 'it'), d, 5 - d)))")
    pieces = whole.filter(n >= 6).select(F.slice("words", 1, 2).alias("words"), F.lit(0.0).alias("label"))
    taught = whole.filter(n >= 2).select(F.explode(F.concat(parts, noisy)).alias("words"), "label").unionByName(pieces)
    taught = taught.select(F.array_intersect(F.concat("words", pairs(F.col("words"))), template_grams()).alias("grams"), "label")
    among = whole.crossJoin(F.broadcast(mixed)).select(F.array_union(F.concat("words", pairs(F.col("words"))), "context").alias("grams"), "label")
    taught = taught.unionByName(among).withColumn("weight", F.when(F.col("label") == 0, 1.0).otherwise(3.0))
    rows = own.filter("NOT held").select("grams", "label", (F.col("weight") * F.lit(CORPUS_WEIGHT / total)).alias("weight")).unionByName(taught)
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(featured(rows).select("features", "label", "weight"))
    unknown = model.transform(featured(own.filter("held AND label = 0"))).select(vector_to_array("probability").alias("p"))
    # The fit sees every family up to the last one of the templates, so all probabilities have one place per family.
    most = unknown.agg(*(F.max(against_unknown(F.col("p"), i)).alias(f"t{i}") for i in range(len(FAMILIES)))).first()
    return Model(model, tuple(max(0.5, min(0.95, most[i] or 0.0)) for i in range(len(FAMILIES))))


def fit(docs: DataFrame, contexts: int = 40) -> Model:
    """The model of all paragraphs of the table."""
    return learn(stored(vectors(docs), "vectors"), contexts)


def classified(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, pos, at, family, probability (against the unknown class), share of each paragraph and family it holds
    a notice of: above the threshold and confirmed in one of its stretches.

    Each distinct vector is scored once. Families share some word pairs. Where a stretch holds several, a family that is not the likeliest must
    hold at least half of its pairs beside those of the likelier ones.
    """
    rows = model.regression.transform(featured(found.select("v").distinct().withColumn("grams", grams())))
    # The generator keeps the filters below from being pushed under the model, which would run it once for each mention.
    rows = rows.select("v", "grams", F.explode(F.array(vector_to_array("probability"))).alias("p"))
    passes = [against_unknown(F.col("p"), i) > model.thresholds[i] for i in range(len(FAMILIES))]
    rows = rows.filter(functools.reduce(operator.or_, passes[1:]))
    each = F.array(*(
        F.struct(F.lit(f).alias("family"), against_unknown(F.col("p"), i).alias("probability"), passes[i].alias("passes"), template_share(F.col("grams"), f).alias("share"), template_pairs(F.col("grams"), f).alias("pairs"))
        for i, f in enumerate(FAMILIES) if i
    ))
    rows = rows.select("v", F.explode(F.array(each)).alias("each"))
    left = "size(filter(c.pairs, w -> NOT exists(each, o -> o.probability > c.probability AND array_contains(o.pairs, w))))"
    rows = rows.select("v", F.explode(F.expr(f"filter(each, c -> c.passes AND c.share >= {CONFIRMED} AND 2 * {left} >= size(c.pairs))")).alias("c"))
    return found.join(rows, "v").groupBy("doc_id", "pos", "at", F.col("c.family").alias("family")).agg(F.max("c.probability").alias("probability"), F.max("c.share").alias("share"))


def fit_and_scan(docs: DataFrame) -> DataFrame:
    """``scan`` by the model of the table itself; its texts are read once for both."""
    found = stored(vectors(docs), "vectors")
    return notices(docs, found, learn(found))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_notices, families for each doc_id: how many paragraphs hold a licence notice and the families, sorted, joined by commas.

    Rows that repeat a doc_id are one document. Null and empty texts and texts without a notice have 0 and the empty text; a null id is an id
    of its own; other columns are not read.
    """
    return notices(docs, stored(vectors(docs), "vectors"), model)


def notices(docs: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    """The rows of ``scan``, given the vectors of the documents."""
    found = classified(found, model).groupBy("doc_id").agg(F.countDistinct("at").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f")).withColumnRenamed("doc_id", "of")
    ids = docs.select("doc_id").distinct()
    return ids.join(found, ids["doc_id"].eqNullSafe(found["of"]), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("f", F.lit("")).alias("families"))
