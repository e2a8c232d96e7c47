"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory (built-in functions only).

Every line of every file, and every whole text, is a passage. Terms of the templates other than stop words make the vocabulary; a passage
without such a term has cosine 0 to every template and is dropped before anything is shuffled. Terms outside the vocabulary
count in a passage's length, with the largest idf. A file takes the template nearest to any of its lines (a header)
or to its whole text (a licence file, which also speaks for its directory). Other files inherit from the licence
file in the nearest directory above them, found by joining the files' ancestor paths with the licence files' directories.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, scoped

TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words without weight, here and in templates.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "was", "with", "work", "you"]
#: Names of licences and how notices of them read. A parameter of the scan; this list is the default.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-clause license."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Templates come from a parameter; more than this many are refused rather than broadcast.
MOST_TEMPLATES = 5_000
LICENCE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(rows, "license string, text string")


@scoped
def scan(files: DataFrame, known: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per row of files (path, text): path, license, how (header, file, inherited or null), score (null where inherited).

    Scores are rounded to 6 places; ties go to whole texts, then to the smaller name. Null or empty texts have no licence of their own but inherit;
    a null path neither inherits nor speaks for a directory. Repeated paths keep a row each. Files in a directory with several
    licence files inherit the one of the highest score, then the smaller name. No templates: no licences.
    """
    stop = F.array(*map(F.lit, STOP_WORDS))
    bag = known.where("license is not null").select("license", F.explode(terms(F.col("text"))).alias("term")).where(~F.array_contains(stop, F.col("term"))).groupBy("license", "term").agg(F.count("*").alias("tf"))
    many = known.where("license is not null").agg(F.count_distinct("license").alias("many"))
    idf = lambda df: F.log((1 + F.col("many")) / (1 + df)) + 1
    vocabulary = bag.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(many)).select("term", idf(F.col("df")).alias("idf"))
    weighted = cut(bag.join(vocabulary, "term").select("license", "term", (F.col("tf") * F.col("idf")).alias("w"), "idf"))
    norms = weighted.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighted = F.broadcast(weighted.join(norms, "license").select("license", "term", (F.col("w") / F.col("norm")).alias("w")))
    words = [r["term"] for r in vocabulary.select("term").limit(MOST_TEMPLATES + 1).collect()]
    if len(words) > MOST_TEMPLATES:
        raise ValueError(f"the templates have more than {MOST_TEMPLATES} terms")
    idfs = F.broadcast(vocabulary)
    rows = files.select(F.monotonically_increasing_id().alias("row"), "path", "text")
    cue = "(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, sorted(words))) + ")(?![a-z0-9])" if words else "(?!)"
    told = rows.select("row", "path", F.when(F.col("text").rlike(cue), F.col("text")).alias("text"))
    told = cut(told)
    lines = told.where("text is not null").select("row", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "part")).where(F.col("part").rlike(cue))
    tf = lines.select("row", "line", F.explode(terms(F.col("part"))).alias("term")).where(~F.array_contains(stop, F.col("term"))).groupBy("row", "line", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(idfs, "term", "left").crossJoin(F.broadcast(many)).select("row", "line", "term", (F.col("tf") * F.coalesce("idf", idf(F.lit(0)))).alias("q"))
    tf = cut(tf)
    length = tf.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    near = tf.join(weighted, "term").groupBy("row", "line", "license").agg(F.sum(F.col("q") * F.col("w")).alias("dot")).join(length, ["row", "line"])
    near = near.select("row", F.when(F.col("line") == 0, "file").otherwise("header").alias("how"), "license", (F.floor(F.col("dot") / F.col("length") * 1e6 + 0.5) / 1e6).alias("score")).where(F.col("score") >= threshold)
    best = near.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("less"), "how", "license")).alias("b")).select("row", F.col("b.license").alias("license"), F.col("b.how").alias("how"), (-F.col("b.less")).alias("score"))
    own = cut(told.select("row", "path").join(best, "row", "left"))
    folder = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    speaks = (F.col("how") == "file") | F.col("path").rlike(LICENCE_NAMES)
    spoken = own.where(speaks & F.col("license").isNotNull() & F.col("path").isNotNull()).groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("less"), "license"))["license"].alias("above"))
    spoken = cut(spoken)
    steps = F.split(folder, "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda k: F.struct((F.size(steps) - k).alias("far"), F.when(k == 0, "").otherwise(F.array_join(F.slice(steps, 1, F.greatest(k, F.lit(1))), "/")).alias("folder")))
    inherits = own.where("license is null and path is not null").select("row", F.explode(above).alias("a")).select("row", "a.*")
    inherits = inherits.join(checked_broadcast(spoken), "folder").groupBy("row").agg(F.min(F.struct("far", "above"))["above"].alias("above"))
    return own.join(inherits, "row", "left").select("path", F.coalesce("license", "above").alias("license"), F.coalesce("how", F.when(F.col("above").isNotNull(), "inherited")).alias("how"), "score")
