"""License scans by a trained paragraph classifier, in DataFrame and SQL
expressions only (``pyspark.ml`` fits the model).

Sparse word 1- and 2-grams of a paragraph go into a logistic regression over
licence families and an unknown class.  Every paragraph is scored, as a whole
and line by line; no word filter decides first.  The unknown class is
calibrated over the whole corpus: a family needs a probability above nearly
all that the corpus's other paragraphs get.  A comparison with the family's
templates confirms each prediction.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import save, text_key

# Short public notices of each family, the templates.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "https://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "https://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "https://creativecommons.org/licenses/by-sa/4.0/"],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL v3 license.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
             "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
                      "This work is dedicated to the public domain.", "SPDX-License-Identifier: Unlicense"],
}
# Sentences that share words with licences and are none.
NOT_LICENCES = ["The driver had to show a licence to the officer.", "She was granted permission to enter the building.", "The apache helicopter landed near the road.",
                "He studied at MIT and later taught there.", "The museum is open to the public and free of charge.", "A new version of the software was released today.",
                "The warranty of the machine ended last year.", "All members of the commons voted for the law.", "The fishing license costs twenty dollars.",
                "The copyright lawyer wrote a long letter.", "The general public may attend the meeting.", "You can obtain a copy of the book at the shop."]
UNKNOWN = "unknown"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    two = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                                               lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, two))


def pieces(text: Column) -> Column:
    """array<array<string>>: for each blank-line block of ``text`` the block and, if it has several, its lines."""
    return F.transform(F.split(text, r"\n\s*\n"), lambda b: F.when(F.contains(b, F.lit("\n")), F.concat(F.array(b), F.split(b, "\n"))).otherwise(F.array(b)))


def piece_words(docs: DataFrame, key: list[str]) -> DataFrame:
    """(key, no, line, w): the words of every piece that has any; line 0 is the
    block itself.  A line is split into words once, and a block's words are
    those of its lines.  Each step is a column of its own, as a function of
    arrays computes its argument again wherever it is named."""
    return docs.select(*key, F.posexplode(F.split("text", r"\n\s*\n")).alias("no", "block")) \
        .select(*key, "no", F.transform(F.split("block", "\n"), words_of).alias("lines")) \
        .select(*key, "no", F.posexplode(F.when(F.size("lines") > 1, F.concat(F.array(F.flatten("lines")), F.col("lines"))).otherwise(F.col("lines"))).alias("line", "w")) \
        .where("size(w) > 0")


def known_grams(words: DataFrame, key: list[str], vocabulary: list, most: int) -> DataFrame:
    """(key, n, grams) of ``words`` (key, w): the grams of the vocabulary, and
    the number of all different grams up to ``most`` (0 if none is known).
    Pairs are only spelled out where both words are in the vocabulary; the
    others are counted by a 64-bit hash."""
    left, right = F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1)
    single = [g for g in vocabulary if " " not in g]
    both = [g for g in vocabulary if " " in g]
    parts = sorted({x for g in both for x in g.split(" ")})
    pair = F.zip_with(left, right, lambda a, b: F.when(a.isin(parts) & b.isin(parts), F.concat_ws(" ", a, b)))
    d = words.select(*key, "w", F.array_distinct("w").alias("one"), F.array_distinct(F.filter(pair, lambda g: g.isin(both))).alias("two"))
    d = d.select(*key, "w", F.size("one").alias("ones"), F.concat(F.filter("one", lambda g: g.isin(single)), "two").alias("grams"))
    n = F.when(F.col("ones") >= most, F.lit(most)).otherwise(
        F.least(F.lit(most), F.col("ones") + F.size(F.array_distinct(F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))))))
    return d.select(*key, F.when(F.size("grams") > 0, n).otherwise(0).alias("n"), "grams")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, x) for f, xs in TEMPLATES.items() for x in xs], "family string, t string") \
        .select("family", grams(words_of(F.col("t"))).alias("tg"))


def training_set(spark: SparkSession, docs: DataFrame, sample_docs: int, sample_lines: int) -> DataFrame:
    """(family, grams): templates whole and in windows of words, sentences
    that are no licences, and at most ``sample_lines`` pieces that resemble no
    template from at most ``sample_docs`` documents, both taken by hash."""
    t = spark.createDataFrame([(f, x) for f, xs in TEMPLATES.items() for x in xs], "family string, text string") \
        .select("family", words_of(F.col("text")).alias("w"))
    spans = t.select("family", "w", F.explode(F.array(F.lit(6), F.lit(10), F.lit(20), F.lit(1000))).alias("n")) \
        .withColumn("at", F.explode(F.when(F.size("w") <= F.col("n"), F.array(F.lit(1))).otherwise(F.expr("sequence(1, size(w) - n + 1, 2)"))))
    yes = spans.select("family", F.expr("slice(w, at, n)").alias("w")).select("family", grams(F.col("w")).alias("grams"))
    no = spark.createDataFrame([(x,) for x in NOT_LICENCES], "text string").select(F.lit(UNKNOWN).alias("family"), grams(words_of(F.col("text"))).alias("grams"))
    no = no.unionByName(no).unionByName(no)
    some = docs.where("text is not null").select("text").orderBy(F.xxhash64(F.substring("text", 1, 200)), "text").limit(sample_docs) \
        .select(F.explode(F.flatten(pieces(F.col("text")))).alias("line")).orderBy(F.xxhash64("line"), "line").limit(sample_lines) \
        .select(words_of(F.col("line")).alias("w")).where("size(w) > 0").select(F.monotonically_increasing_id().alias("id"), grams(F.col("w")).alias("grams"))
    # bounded: the sample beside the templates
    alike = F.max((F.size("grams") > 1) & (overlap("grams", "tg") >= 0.5))
    some = some.crossJoin(F.broadcast(templates(spark))).groupBy("id").agg(F.first("grams").alias("grams"), alike.alias("alike")) \
        .where("not alike").select(F.lit(UNKNOWN).alias("family"), "grams")
    return yes.unionByName(no).unionByName(some)


def overlap(a: str, b: str) -> Column:
    """The share of the smaller array's grams that the other holds."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def fit(spark: SparkSession, docs: DataFrame, sample_docs: int = 300, sample_lines: int = 3000) -> tuple[DataFrame, list, list, dict]:
    """(weights (gram, w array), grams, families, intercepts)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    rows = save(training_set(spark, docs, sample_docs, sample_lines), "licence-train")
    known = rows.where(F.col("family") != UNKNOWN)
    vocabulary = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=4000).fit(known)  # words of the templates
    index = StringIndexer(inputCol="family", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=2e-3, maxIter=40, family="multinomial", standardization=False) \
        .fit(index.transform(vocabulary.transform(rows)))
    families, matrix, bias = index.labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = spark.createDataFrame([(g, [float(v) for v in matrix[:, i]]) for i, g in enumerate(vocabulary.vocabulary)], "gram string, w array<double>")
    return weights, list(vocabulary.vocabulary), families, bias


def _logits(paragraphs: DataFrame, key: list[str], weights: DataFrame, families: list, bias) -> DataFrame:
    """``z``: for each family the sum of the weights of a paragraph's grams."""
    hits = paragraphs.select(*key, F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")  # the templates' words: bounded
    sums = hits.groupBy(*key).agg(*[F.sum(F.get("w", i)).alias(f"z{i}") for i in range(len(families))])
    return sums.select(*key, F.array(*[F.coalesce(f"z{i}", F.lit(0.0)) + float(bias[i]) for i in range(len(families))]).alias("z"))


def _softmax(logits: DataFrame, families: list) -> DataFrame:
    """The best family beside unknown and its probability."""
    key = [c for c in logits.columns if c != "z"]
    e = logits.select(*key, F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    named = F.filter(F.arrays_zip(F.col("e").alias("p"), F.array(*[F.lit(f) for f in families]).alias("family")), lambda x: x["family"] != UNKNOWN)
    return e.select(*key, total.alias("t"), F.array_max(named).alias("b")).select(*key, (F.col("b.p") / F.col("t")).alias("p"), F.col("b.family").alias("family"))


def scan(docs: DataFrame, least_overlap: float = 0.5, known_rate: float = 0.995, floor: float = 0.1) -> DataFrame:
    """``docs`` (doc_id, text) -> one row for each distinct (doc_id, text):
    (doc_id, text_key, licences, n_licence, best) with the families found, the
    number of licence paragraphs, and the highest probability.

    A paragraph is a blank-line block, judged as a whole and by its lines.  A
    family counts if ``least_overlap`` of the grams of the smaller one of
    piece and template are in the other, and if its probability passes the
    calibrated least: the ``known_rate`` quantile over all pieces of the corpus
    that no template confirms, and not below ``floor``, which stands in where
    a corpus is too small to calibrate on (a piece without any known word gets
    about 0.01).  Null and empty texts have none; repeated rows give one row;
    null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    weights, vocabulary, families, bias = fit(spark, docs)
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    most = max(len(set(w) | set(zip(w, w[1:]))) for xs in TEMPLATES.values() for x in xs for w in [re.findall(r"[^\W_]+", x.lower())])
    # of a piece's grams only those of the vocabulary have a weight or stand in a template; of their number, what a template can reach counts
    key = ["doc_id", "text_key", "no", "line"]
    paragraphs = known_grams(piece_words(keyed, ["doc_id", "text_key"]), key, vocabulary, most).dropDuplicates(key)
    # equal pieces are judged once, however often they come
    paragraphs = save(paragraphs.withColumn("kind", F.xxhash64("n", F.array_sort("grams"))), "licence-paragraphs")
    kinds = save(paragraphs.groupBy("kind").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.count("*").alias("pieces")), "licence-kinds")
    scored = save(_softmax(_logits(kinds, ["kind", "pieces"], weights, families, bias), families), "licence-scored")
    share = F.size(F.array_intersect("grams", "tg")) / F.least("n", F.size("tg"))
    likely = kinds.where("n > 0").join(scored.where(F.col("p") >= floor).select("kind", "family", "p"), "kind")
    # against every template (a fixed few): the share in its own family, and the families that fit as well
    shares = likely.crossJoin(F.broadcast(templates(spark).withColumnRenamed("family", "other"))).groupBy("kind") \
        .agg(F.first("family").alias("family"), F.first("p").alias("p"), F.collect_list(F.struct("other", share.alias("share"))).alias("s"))
    own = F.array_max(F.transform(F.filter("s", lambda x: x["other"] == F.col("family")), lambda x: x["share"]))
    sure = shares.withColumn("own", own).where(F.col("own") >= least_overlap)
    sure = save(sure.select("kind", "family", "p", F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda x: x["share"] >= F.col("own")), lambda x: x["other"]))).alias("fits")), "licence-sure")
    # the unknown class: all other pieces, counted by probability to five places, so at most 100,001 rows
    others = scored.join(sure.select("kind"), "kind", "left_anti").groupBy(F.round("p", 5).alias("p")).agg(F.sum("pieces").alias("pieces"))
    least = max(floor, others.agg(F.expr(f"percentile(p, {float(known_rate)}, pieces)")).first()[0] or 0.0)
    # a line that fits its block's family as well as its own (families share wording) says what the block says
    judged = paragraphs.where("n > 0").select("doc_id", "text_key", "no", "line", "kind").join(sure.where(F.col("p") >= least), "kind") \
        .groupBy("doc_id", "text_key", "no").agg(F.max(F.when(F.col("line") == 0, F.col("family"))).alias("whole"), F.collect_set(F.struct("family", "fits")).alias("said"), F.max("p").alias("p"))
    named = F.transform("said", lambda x: F.when(F.coalesce(F.array_contains(x["fits"], F.col("whole")), F.lit(False)), F.col("whole")).otherwise(x["family"]))
    found = judged.select("doc_id", "text_key", "p", F.array_sort(F.array_distinct(named)).alias("families")) \
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")) \
        .agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("licences"), F.count("*").alias("n_licence"), F.max("p").alias("best"))
    return keyed.select("doc_id", "text_key").distinct().join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left") \
        .select("doc_id", "text_key", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_licence", F.lit(0)).alias("n_licence"), F.coalesce("best", F.lit(0.0)).alias("best"))
