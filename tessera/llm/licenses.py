"""License scans (operator 5): sparse TF-IDF cosine to templates, then inheritance by directory.

DataFrame operations only.  Sentences that speak of licences are compared with short notices, and whole
texts with the full texts of licences.  A text that is a licence, or made of notices, is a licence file and
governs its directory and all below it, down to the next.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import work

# Names and customary short notices of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, under the MIT license"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    # The older GNU notices have a stop before and after this part, the newer ones run on to the version.
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
#: The GNU licences are tagged with what later versions are allowed.
_TAGS = [(name, name + more) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for more in ("-only", "-or-later")]
ALL_TEMPLATES = TEMPLATES + [(name, f"SPDX-License-Identifier: {tag}") for name, tag in [*((n, n) for n in dict.fromkeys(n for n, _ in TEMPLATES)), *_TAGS]]

#: What a sentence must say to be compared, where sentences end (at a line's end, or, for sentences that run
#: over several lines, only at a stop or an empty line), and what a term is.
TRIGGER = "(?i)licen[sc]e|spdx|permission is hereby granted|permission to use|redistribution|free software|public domain"
SENTENCE_END = "\\n|[.!?;] "
WRAPPED_END = "\\n[ \\t\\r]*\\n|[.!?;][ \\t\\r\\n]+"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a sentence and of a whole text; the share of a text's terms in matching sentences that
#: makes it a licence file, and the share of words of licences that it must have to be compared as a whole.
LEAST_COSINE, LEAST_WHOLE, FILE_SHARE, VOCABULARY_SHARE = 0.6, 0.75, 0.5, 0.5


def _full_texts() -> list[tuple[str, str]]:
    """The licence texts beside this module, by name.  The Affero licence is the general one under its
    own name, but for a section on use over networks."""
    texts = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = re.sub("(?i)GNU GENERAL PUBLIC", "GNU Affero General Public", texts["GPL-3.0"])
    return sorted(texts.items())


FULL_TEXTS = _full_texts()
#: The terms of licence texts; the literal of them is used in an SQL expression.
VOCABULARY = sorted({t for _, text in FULL_TEXTS for t in re.findall(TERM, text.lower())})
_IN_VOCABULARY = "t IN (" + ", ".join(f"'{t}'" for t in VOCABULARY) + ")"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def _templates(spark: SparkSession) -> DataFrame:
    """(template, whole, license, term, tf): a table of fixed size; the full texts are ``whole``."""
    told = [(False, *t) for t in ALL_TEMPLATES] + [(True, *t) for t in FULL_TEXTS]
    told = [F.struct(F.lit(i).alias("template"), F.lit(whole).alias("whole"), F.lit(name).alias("license"), F.lit(text).alias("notice")) for i, (whole, name, text) in enumerate(told)]
    rows = spark.range(1, numPartitions=1).select(F.inline(F.array(*told)))
    rows = rows.select("template", "whole", "license", F.explode(terms(F.col("notice"))).alias("term"))
    return work.written(rows.groupBy("template", "whole", "license", "term").agg(F.count("*").cast("double").alias("tf")), "templates")


def _best(words: DataFrame, weighed: DataFrame, idf: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(uid, pos, n, b): of each piece of ``words`` (uid, pos, term, tf) its terms and the nearest template
    of at least the cosine ``least``, the first of equals, as ``b`` (license, cosine)."""
    mine = words.join(F.broadcast(idf), F.col("term") == F.col("i_term"), "left").crossJoin(F.broadcast(other)).select("uid", "pos", "term", "tf", (F.col("tf") * F.coalesce("idf", "other")).alias("w"))
    length = mine.groupBy("uid", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n"))
    dots = mine.join(F.broadcast(weighed), F.col("term") == F.col("t_term")).groupBy("uid", "pos", "template", "license", "t_norm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)
    matched = dots.join(length, ["uid", "pos"]).select("uid", "pos", "n", "template", "license", cosine.alias("cosine")).where(F.col("cosine") >= least)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("template")))
    return matched.groupBy("uid", "pos").agg(best.alias("b"), F.first("n").alias("n"))


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """(id, path, license, found, score): one row per row of ``files``.

    ``found`` is ``file`` for a licence file (a text near a licence's full text, or half of it in
    matching sentences), ``header`` for another text with a matching sentence,
    ``inherited`` for a text without one below a directory that has a licence file (the nearest
    counts; in one directory the highest cosine, then the least path), else ``none`` with no license
    and no score.  Inverse document frequencies of the templates' terms are counted over all matching
    sentences of the corpus and the templates; a term of no template weighs as one seen once.

    Null or empty texts have no header; a null path stands in no directory and inherits nothing; a null
    id stays null; repeated rows each get a row; other columns are not read.
    """
    spark = files.sparkSession
    text = F.col(text_col)
    # one pass over the texts: only those that speak of licences are kept, numbered for good by the table
    base = files.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), path.cast("string").alias("path"), F.when(text.rlike(TRIGGER), text).alias("text"))
    base = work.written(base, "licenses")
    spoken = base.where(F.col("text").isNotNull())
    plain = F.split("text", SENTENCE_END)
    pieces = F.concat(plain, F.filter(F.split("text", WRAPPED_END), lambda p: F.contains(p, F.lit("\n"))))
    sentences = spoken.select("uid", F.size(plain).alias("n_plain"), F.posexplode(pieces).alias("pos", "sentence")).where(F.col("sentence").rlike(TRIGGER))
    words = sentences.select("uid", "pos", (F.col("pos") >= F.col("n_plain")).alias("wrapped"), F.explode(terms(F.col("sentence"))).alias("term"))
    words = work.written(words.groupBy("uid", "pos", "wrapped", "term").agg(F.count("*").cast("double").alias("tf")), "terms")
    own_terms = terms(F.col("text"))
    whole = spoken.select("uid", own_terms.alias("terms")).where(F.expr(f"size(terms) > 0 AND size(filter(terms, t -> {_IN_VOCABULARY})) >= {VOCABULARY_SHARE} * size(terms)"))
    whole = whole.select("uid", F.lit(0).alias("pos"), F.explode("terms").alias("term"))
    whole = work.written(whole.groupBy("uid", "pos", "term").agg(F.count("*").cast("double").alias("tf")), "whole")

    template = _templates(spark)
    vocabulary = template.groupBy("term").agg(F.count("*").alias("t_df"))
    total = words.select("uid", "pos").distinct().agg((F.count("*") + F.lit(len(ALL_TEMPLATES) + len(FULL_TEXTS))).alias("n"))
    df = words.join(F.broadcast(vocabulary.select(F.col("term").alias("v"))), F.col("term") == F.col("v")).groupBy("term").agg(F.count("*").alias("df"))
    idf = vocabulary.join(df.withColumnRenamed("term", "d"), F.col("term") == F.col("d"), "left").crossJoin(total)
    idf = idf.select(F.col("term").alias("i_term"), (F.log((1 + F.col("n")) / (1 + F.col("t_df") + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = work.written(idf, "idf")  # no longer than the templates' vocabulary
    other = total.select((F.log((1 + F.col("n")) / F.lit(2)) + 1).alias("other"))

    weighed = template.join(idf, F.col("term") == F.col("i_term")).select("template", "whole", "license", F.col("term").alias("t_term"), (F.col("tf") * F.col("idf")).alias("tw"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_norm")).withColumnRenamed("template", "n_template")
    weighed = work.written(weighed.join(norms, F.col("template") == F.col("n_template")).drop("n_template"), "weighed")

    notices = _best(words, weighed.where(~F.col("whole")), idf, other, least)
    notices = notices.join(words.select(F.col("uid").alias("w_uid"), F.col("pos").alias("w_pos"), "wrapped").distinct(), (F.col("uid") == F.col("w_uid")) & (F.col("pos") == F.col("w_pos")))
    told = F.greatest(*[F.sum(F.when(F.col("wrapped") == side, F.col("n")).otherwise(0)) for side in (False, True)])
    own = notices.groupBy("uid").agg(F.max_by("b", F.struct(F.col("b.cosine"), -F.col("pos"))).alias("header"), told.alias("told"))
    own = own.select(F.col("uid").alias("o_uid"), "header", "told")
    files = _best(whole, weighed.where("whole"), idf, other, LEAST_WHOLE).select(F.col("uid").alias("f_uid"), F.col("b").alias("file"))

    parts = F.split("path", "/")
    directory = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    known = base.join(own, F.col("uid") == F.col("o_uid"), "left").join(files, F.col("uid") == F.col("f_uid"), "left").withColumn("b", F.coalesce("file", "header"))
    is_file = F.col("file").isNotNull() | F.coalesce(F.col("told") >= FILE_SHARE * F.size(terms(F.col("text"))), F.lit(False))
    known = work.written(known.select("id", "path", F.when(F.col("path").isNotNull(), directory).alias("dir"), F.col("b.license").alias("license"), F.col("b.cosine").alias("score"), is_file.alias("is_file")), "known")

    rules = known.where(F.col("is_file") & F.col("dir").isNotNull()).groupBy(F.col("dir").alias("r_dir"))
    rules = rules.agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("rule"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    dirs = known.select("dir").where(F.col("dir").isNotNull()).distinct().select("dir", F.posexplode(above).alias("depth", "up"))
    nearest = dirs.join(rules, F.col("up") == F.col("r_dir")).groupBy("dir").agg(F.max_by("rule", "depth").alias("rule")).withColumnRenamed("dir", "n_dir")
    nearest = work.written(nearest, "nearest")
    out = known.join(nearest, F.col("dir") == F.col("n_dir"), "left")
    found = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("rule").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("license", F.col("rule.license")).alias("license"), found.alias("found"), F.coalesce("score", F.col("rule.score")).alias("score"))
