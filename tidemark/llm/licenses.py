"""License scan by diagonal voting over rolling word k-grams.

Every run of K words of a document is joined to the places where a license template has the same run;
the hits of a document and a template on one diagonal (document position less template position) are
votes.  Neighbouring diagonals, whose difference is a few inserted or missing words, are merged, and
the merged span is verified: it must hold at least COVERED of the template's runs, each counted once.
The base phrases are templates of two and three words that must be there in full.

Defined results: a null text is the empty text, without words; repeated rows give a row each; an empty
table gives no rows; `first_word` and `last_word` are null and the label lists empty where nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

K, COVERED = 3, 0.6
#: Diagonals of a template that lie no further apart are merged.
APART = 8

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices and the labels they stand for.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License. See the LICENSE file in the project root for license information."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def grams(hashes: Column, k: int) -> Column:
    """Hashes of the runs of k word hashes, in order."""
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _templates(spark: SparkSession) -> DataFrame:
    """key, template, label, base, at, runs: a row per run of each template; a fixed, small table."""
    rows = [(k, label, text, text in BASE, len(text.split()) if text in BASE else K) for k, (label, text) in enumerate([*((v, k) for k, v in BASE.items()), *TEMPLATES])]
    made = spark.createDataFrame(rows, "template int, label string, text string, base boolean, k int")
    h = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    per = None
    for k in sorted({r[4] for r in rows}):
        own = made.where(F.col("k") == k).select("template", "label", "base", "k", grams(h, k).alias("g")).select("*", F.size("g").alias("runs"), F.posexplode("g").alias("at", "key")).drop("g")
        per = own if per is None else per.unionByName(own)
    return per


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    templates = checkpointed(_templates(spark))
    h = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), h.alias("h")).withColumn("n_words", F.size("h"))
    # place -1 stands for the document itself and meets no template
    keyed = lambda k: F.transform(grams(F.col("h"), k), lambda g, i: F.struct(i.cast("int").alias("place"), F.lit(k).alias("k"), g.alias("key")))
    own = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("key")))
    lengths = sorted({len(p.split()) for p in BASE} | {K})
    runs = hashed.select("row", "doc_id", "n_words", F.explode(F.concat(own, *(keyed(k) for k in lengths))).alias("r")).select("row", "doc_id", "n_words", "r.*")
    document = spark.createDataFrame([(0, 0)], "k int, key long").withColumns({"template": F.lit(-1), "label": F.lit(None).cast("string"), "base": F.lit(False), "runs": F.lit(0), "at": F.lit(-1)})
    hits = checkpointed(runs.join(F.broadcast(templates.unionByName(document)), ["k", "key"]).select("row", "doc_id", "n_words", "template", "label", "base", "runs", "place", "at"))

    phrase = F.col("base") & (F.col("template") >= 0)
    plain = hits.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(phrase, 1)).alias("n_base"), F.min(F.when(phrase, F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("place"))).cast("long").alias("last_word"), F.array_sort(F.collect_set(F.when(phrase, F.col("label")))).alias("base_labels"),
    )
    votes = hits.where(~F.col("base") & (F.col("template") >= 0)).withColumn("diagonal", F.col("place") - F.col("at"))
    votes = votes.groupBy("row", "template", "label", "runs", "diagonal").agg(F.collect_set("at").alias("ats"))  # at most the template's runs
    by = W.partitionBy("row", "template").orderBy("diagonal")
    near = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > APART).cast("int"), F.lit(1))
    merged = votes.withColumn("new", near).withColumn("span", F.sum("new").over(by)).select("row", "template", "label", "runs", "span", F.explode("ats").alias("at")).groupBy("row", "template", "label", "runs", "span").agg(F.countDistinct("at").alias("held"))
    verified = merged.withColumn("share", F.col("held") / F.col("runs")).where(F.col("share") >= COVERED)
    found = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = plain.join(found, "row", "left")
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(some(F.col("base_labels")), some(F.col("more")))), ",").alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
