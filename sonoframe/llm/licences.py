"""Licence families of paragraphs by a trained n-gram classifier, in DataFrame operations only (operator 7)."""

import json
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, NGram, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.shared import share, stored

BUCKETS = 1 << 11           # hashed features of each n-gram size; few enough that the weights stay a dense matrix
BACKGROUND = 3_000          # corpus paragraphs that teach the unknown class, at most about
SIMILARITY = 0.5            # share of a paragraph's or template's word pairs that has to agree
WINDOW, STEP = 80, 40       # words of a paragraph judged at once, and how far windows move
UNKNOWN = "unknown"

# Names of licence families as they occur in notices.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "Apache-2.0"),
    "MIT": ("the MIT License", "the MIT license (MIT)", "MIT License", "MIT"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL version 3", "GPL-3.0-or-later"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL version 2", "GPL-2.0-only"),
    "LGPL": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v3.0", "LGPL-2.1-or-later"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPL-3.0-only"),
    "BSD": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the New BSD License", "a BSD-style license", "BSD-3-Clause"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("the ISC License", "ISC License", "ISC"),
    "CC-BY": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC0": ("CC0 1.0", "the Creative Commons Zero v1.0 Universal dedication", "CC0-1.0"),
    "Unlicense": ("the Unlicense", "The Unlicense", "Unlicense"),
}
NOTICES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This file is distributed under the terms of {}.",
           "SPDX-License-Identifier: {}", "Available under {}.", "Code in this repository is made available under {}.", "See LICENSE for {}.", "License: {}")
# Sentences of the published licence texts.
TEXTS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY": ("You are free to share and adapt the material for any purpose, even commercially, if you give appropriate credit.",),
    "CC-BY-SA": ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",),
    "CC-BY-NC": ("You may not use the material for commercial purposes.",),
    "CC0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# Paragraphs of six and more words of the published texts, by family; where a family has none, NAMES and TEXTS are all there is.
PUBLISHED = json.loads(Path(__file__).with_name("licence_texts.json").read_text("utf-8"))
# Ordinary sentences with words of the trade, for the unknown class.
ORDINARY = ("He lost his driving license last year.", "The city council issued a license to the new restaurant.", "A public hearing about version 3 of the plan is on Monday.",
            "Students study at the institute of technology.", "The software was distributed to all offices.", "Copyright law was changed by the parliament.",
            "Permission to enter the building was granted to the visitors.", "All rights of the workers are protected.", "The general public was invited to the opening.",
            "The warranty covers parts and labour for two years.", "Released last week, the film was a success.", "See the notice at the door.",
            "Licensed plumbers are available in this area.", "The Apache helicopter landed at the base.", "This work is about rivers and their banks.")


def _words(text: Column) -> Column:
    """Lower-case words and numbers of a paragraph."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _literal_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    entries = F.from_json(F.lit(json.dumps([{"family": family, "text": text} for family, text in rows])), "array<struct<family:string,text:string>>")
    return spark.range(1).select(F.explode(entries).alias("r")).select("r.family", "r.text")


def _notices() -> list[tuple[str, str]]:
    return [(f, n.format(name)) for f, names in NAMES.items() for name in names for n in NOTICES] + [(f, t) for f, texts in TEXTS.items() for t in texts]


def _windows(words: Column) -> Column:
    """Starts of the overlapping windows of at most ``WINDOW`` words, from 0."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(words) - WINDOW) / F.lit(STEP)).cast("int")))


def _published(spark: SparkSession) -> DataFrame:
    """``family, words``: the published paragraphs, cut as the paragraphs of a corpus are."""
    rows = _literal_rows(spark, [(f, t) for f, texts in PUBLISHED.items() for t in texts]).select("family", _words(F.col("text")).alias("w"))
    return rows.select("family", "w", F.explode(_windows(F.col("w"))).alias("part")).select("family", F.slice("w", F.col("part") * STEP + 1, F.lit(WINDOW)).alias("words"))


def _inline(notices: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """``family, words``: each corpus row with one of the ``n`` notices set into it, in a window of at most ``WINDOW`` words."""
    own = notices.select("family", F.col("words").alias("notice"), "at")
    around = corpus.select(F.col("words").alias("w"), F.pmod("h", F.lit(n)).cast("int").alias("at"), F.pmod(F.xxhash64("h"), F.size("words") + 1).cast("int").alias("cut"))
    room = F.greatest(F.lit(0), F.lit(WINDOW) - F.size("notice"))
    before = F.least("cut", room)
    parts = F.concat(F.slice("w", F.col("cut") - before + 1, before), "notice", F.slice("w", F.col("cut") + 1, room - before))
    return around.join(F.broadcast(own), "at").select("family", parts.alias("words"))


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, paragraph, part, words``: lines of the whole texts from 0, cut into overlapping windows of at most ``WINDOW`` words."""
    lines = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_column}`").cast("string"), "\n")).alias("paragraph", "line"))
    words = lines.select("doc_id", "paragraph", _words(F.col("line")).alias("w")).filter(F.size("w") > 0)
    return words.select("doc_id", "paragraph", "w", F.explode(_windows(F.col("w"))).alias("part")).select(
        "doc_id", "paragraph", "part", F.slice("w", F.col("part") * STEP + 1, F.lit(WINDOW)).alias("words"))


def _features() -> list:
    grams = [NGram(n=n, inputCol="words", outputCol=f"g{n}") for n in (2, 3)]
    hashed = [HashingTF(inputCol=c, outputCol=f"h_{c}", numFeatures=BUCKETS, binary=True) for c in ("words", "g2", "g3")]
    return [*grams, *hashed, VectorAssembler(inputCols=[f"h_{c}" for c in ("words", "g2", "g3")], outputCol="x")]


class LicenceModel:
    """Fitted pipeline, calibration of its chance of any licence, and the word pairs of the templates by family.

    ``pairs`` are those of all templates together; their number is fixed by the published texts, not by any table.
    """

    def __init__(self, pipeline: PipelineModel, calibration, templates: DataFrame):
        self.pipeline, self.calibration, self.templates = pipeline, calibration, templates
        self.pairs = sorted(r["pair"] for r in templates.select(F.explode(F.flatten("templates")).alias("pair")).distinct().collect())


def fit_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", background: int = BACKGROUND) -> LicenceModel:
    """Learn families from notices, alone and set into corpus paragraphs, and the published texts, and the unknown class from ordinary
    sentences and about ``background`` corpus paragraphs.

    Corpus paragraphs that name a licence word are not taken as unknown.  A fifth of the rows, of the published texts none, is set aside to
    calibrate the chance that a paragraph is of a known family.
    """
    spark = docs.sparkSession
    notices = _notices()
    known = _literal_rows(spark, notices)
    ordinary = _literal_rows(spark, [(UNKNOWN, t) for t in ORDINARY])
    n = max(1, docs.count())
    drawn = docs.filter(share(id_column, "background", min(1.0, background / n))).select(F.col(f"`{id_column}`").alias("d"), F.col(f"`{text_column}`").cast("string").alias("t"))
    line = F.element_at(F.split("t", "\n"), (F.pmod(F.xxhash64("d"), F.size(F.split("t", "\n"))) + 1).cast("int"))  # one of its lines
    corpus = drawn.filter("t is not null").select(F.lit(UNKNOWN).alias("family"), line.alias("text")).filter(~F.col("text").rlike("(?i)licen[sc]|copyright|warrant|redistribut|permission"))
    drawn = stored(corpus.select("family", _words(F.col("text")).alias("words"), F.xxhash64("text").alias("h")).filter(F.size("words") > 0))
    short = known.unionByName(ordinary).select("family", _words(F.col("text")).alias("words"))
    numbered = F.from_json(F.lit(json.dumps([{"at": i, "family": f, "text": t} for i, (f, t) in enumerate(notices)])), "array<struct<at:int,family:string,text:string>>")
    numbered = spark.range(1).select(F.explode(numbered).alias("r")).select("r.at", "r.family", _words(F.col("r.text")).alias("words"))
    mixed = short.unionByName(drawn.select("family", F.slice("words", 1, WINDOW).alias("words"))).unionByName(_inline(numbered, drawn, len(notices)))
    rows = mixed.withColumn("aside", F.pmod(F.xxhash64("family", "words"), F.lit(5)) == 0).unionByName(_published(spark).withColumn("aside", F.lit(False)))
    rows = stored(rows.coalesce(4))
    indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    regression = LogisticRegression(featuresCol="x", labelCol="label", predictionCol="class", regParam=1e-3, maxIter=40, family="multinomial")
    pipeline = Pipeline(stages=[*_features(), indexer, regression]).fit(rows.filter("not aside"))
    pipeline = PipelineModel([s for s in pipeline.stages if s is not indexer and s.uid != indexer.uid] + [IndexToString(inputCol="class", outputCol="family", labels=indexer.labels)])
    unknown = indexer.labels.index(UNKNOWN)
    chance = (1 - vector_to_array("probability")[unknown]).alias("chance")
    aside = pipeline.transform(rows.filter("aside").withColumnRenamed("family", "truth")).select(chance, (F.col("truth") != UNKNOWN).cast("double").alias("known"))
    calibration = IsotonicRegression(featuresCol="chance", labelCol="known", predictionCol="score").fit(aside)
    texts = known.select("family", _words(F.col("text")).alias("words")).unionByName(_published(spark))
    templates = stored(texts.select("family", _pairs(F.col("words")).alias("pairs")).groupBy("family").agg(F.collect_set("pairs").alias("templates")))
    model = LicenceModel(pipeline, calibration, templates)
    model.unknown = unknown
    return model


def _pairs(words: Column) -> Column:
    """Neighbouring words as pairs, each once; a single word stands for itself."""
    two = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, two).otherwise(words))


def find_licences(docs: DataFrame, model: LicenceModel, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, paragraph, family, score, similarity`` of every paragraph that is licence text.

    All windows of all paragraphs of the whole texts are judged: the calibrated chance of a known family has to reach
    ``least``, and the word pairs shared with a template of the predicted family, as a part of the smaller of both, ``similarity``.
    A window without any pair of any template cannot reach a similarity above 0, so it is not classified.
    A paragraph gives its surest window; ties go to the first family by name.

    Null and empty texts give nothing, and a null id its paragraphs under null.  Rows that repeat an id are put together, so a
    paragraph position counts once.  An empty table gives an empty result; further columns are not carried.
    """
    windows = paragraphs(docs, id_column, text_column)
    if similarity > 0:
        windows = windows.filter(F.exists(_pairs(F.col("words")), lambda pair: pair.isin(model.pairs)))
    scored = model.pipeline.transform(windows).select(
        "doc_id", "paragraph", "words", "family", (1 - vector_to_array("probability")[model.unknown]).alias("chance"))
    likely = model.calibration.transform(scored.filter(F.col("family") != UNKNOWN)).filter(F.col("score") >= least)
    own = _pairs(F.col("words"))
    shared = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.greatest(F.lit(1), F.least(F.size(t), F.size("pairs")))))
    confirmed = likely.withColumn("pairs", own).join(F.broadcast(model.templates), "family").withColumn("similarity", shared).filter(F.col("similarity") >= similarity)
    # the lowest family among the surest windows, by aggregates that combine before the shuffle
    best = confirmed.groupBy("doc_id", "paragraph", "family").agg(F.max("score").alias("score"), F.max("similarity").alias("similarity"))
    top = F.max(F.struct("score", "similarity")).alias("top")
    by_family = best.groupBy("doc_id", "paragraph").agg(top, F.collect_list(F.struct("score", "similarity", "family")).alias("all"))
    chosen = F.array_min(F.transform(F.filter("all", lambda r: (r["score"] == F.col("top.score")) & (r["similarity"] == F.col("top.similarity"))), lambda r: r["family"]))
    return by_family.select("doc_id", "paragraph", chosen.alias("family"), F.col("top.score").alias("score"), F.col("top.similarity").alias("similarity"))
