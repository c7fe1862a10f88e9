"""License scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Native: DataFrame functions only.  A file's notices are its lines; those of a
licence file (by name) are also its runs of two and three lines and its whole
text.  A notice's vector has a weight ``tf * idf`` per word; idf comes from all
files for the words of the templates, and any other word has the idf of a word
that no file has.  Stop words count nowhere.  The best notice with a cosine of
``LEAST`` or more is the file's own licence.  Notices of licence files are also
compared with licence texts and titles (``license_texts``), with an idf from
the licence files alone; a cosine of ``LEAST_TEXT`` (``LEAST_TITLE``) or more
there goes before any line that looks like a short notice.  A file without a licence takes that
of the nearest directory above it, its own included, that holds a licence file.

``ln((files + 1) / (files with the word + 1)) + 1`` is the idf.  Order: licence
titles, then licence texts, then notices; the higher score, the earlier line, the
shorter run, the licence by name.  For directories the same without lines.  Null or empty texts have no notice,
a null path no directory; repeated rows are scanned each for themselves.
Template words are compared whole, a-z and 0-9 in lower case.
"""

from __future__ import annotations

from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage

LEAST, LEAST_TEXT, LEAST_TITLE = 0.7, 0.8, 0.9
# fixed values: notices of common licences
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright (CC0 1.0 Universal)."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-rights-reserved", "All rights reserved."),
)
# titles of licences whose text is not in license_texts
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
)
STOP = ("a", "an", "and", "are", "as", "for", "has", "in", "is", "of", "or", "the", "this", "to", "under", "with", "without")
LICENSE_FILE = "^(licen[cs]e|copying|notice)([.-].*)?$"


def pieces_of(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def words_of(text: Column) -> Column:
    return F.filter(pieces_of(text), lambda w: (w != "") & ~w.isin(*STOP))


def template_rows(spark, templates=TEMPLATES) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("template")) for k, t in templates])
    rows = spark.range(1).select(F.explode(each).alias("t")).select("t.*")
    words = rows.select("license", F.explode(words_of(F.col("template"))).alias("word"))
    return words.groupBy("license", "word").agg(F.count("*").alias("tf"))


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Licences with their texts, from the files of ``license_texts``, and ``TITLES``."""
    found = [f for f in resources.files("pulsegrid.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return (*sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in found), *((f"{k} title", t) for k, t in TITLES))


def weighted_terms(terms: DataFrame, held: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``word, idf`` of the templates' words, and ``license, word, weight`` of unit length; ``held`` has ``word, df`` over ``n`` texts."""
    idf = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighted = cut_lineage(terms.join(held, "word", "left").select("license", "word", "tf", idf.alias("idf")))
    norms = weighted.groupBy("license").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    unit = weighted.join(norms, "license").select("license", "word", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))
    return weighted.select("word", "idf").distinct(), unit


def scored(counted: DataFrame, known: DataFrame, unit: DataFrame, n: int, least: float) -> DataFrame:
    """``__file, line, run, license, score`` of the notices (``__file, line, run, word, tf``) with a cosine of ``least`` or more."""
    key = ["__file", "line", "run"]
    vectors = counted.join(F.broadcast(known), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1))
    lengths = vectors.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    dots = vectors.join(F.broadcast(unit), "word").groupBy(*key, "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(lengths, key).select(*key, "license", F.round(F.col("dot") / F.col("length"), 6).alias("score")).filter(F.col("score") >= least)


def run_of(k: int):
    return lambda x, i: F.struct(i.alias("line"), F.lit(k).alias("run"), x.alias("x"))


def license_scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per file: ``__file``, ``path``, ``own_license``, ``own_score``, ``license``, ``license_dir`` (null unless inherited).

    ``files`` needs ``__file`` (a number of its own for each row), ``path`` and ``text``.
    """
    spark = files.sparkSession
    terms = template_rows(spark, templates)
    vocabulary = sorted({w for r in terms.select("word").distinct().collect() for w in r})  # the templates' words: a parameter
    listed = F.array(*map(F.lit, vocabulary))
    n = files.count()

    # one pass: document frequencies of the templates' words
    held = files.select(F.explode(F.array_intersect(pieces_of(F.col("text")), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    known, unit = weighted_terms(terms, held, n)

    # another pass: notices with two words or more of the templates, or with one that reaches the least cosine alone
    alone = [r["word"] for r in unit.filter(F.col("weight") >= least - 1e-6).select("word").distinct().collect()]
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    whole = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    lines = F.split("text", "\n")
    twos = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(0))), lambda x, y: F.concat_ws("\n", x, y))
    threes = F.zip_with(twos, F.slice(lines, 3, F.greatest(F.size(lines), F.lit(0))), lambda x, y: F.concat_ws("\n", x, y))
    runs = [F.transform(x, run_of(k)) for k, x in enumerate((lines, twos, threes), 1)]
    text = F.struct(F.lit(0).alias("line"), F.lit(0).alias("run"), F.col("text").alias("x"))
    placed = F.when(whole, F.concat(F.array(text), *runs)).otherwise(runs[0])

    def marked(p):
        pieces = pieces_of(p["x"])
        held_enough = F.size(F.array_intersect(pieces, listed)) >= 2
        return held_enough | F.arrays_overlap(pieces, F.array(*map(F.lit, alone))) if alone else held_enough

    chosen = F.when(whole, placed).otherwise(F.filter(placed, marked))
    notices = cut_lineage(files.select("__file", "path", whole.alias("whole"), F.explode(chosen).alias("n")).select("__file", "path", "whole", "n.line", "n.run", words_of(F.col("n.x")).alias("words")))
    counted = cut_lineage(notices.select("__file", "whole", "line", "run", F.explode("words").alias("word")).groupBy("__file", "whole", "line", "run", "word").agg(F.count("*").alias("tf")))
    short = scored(counted.drop("whole"), known, unit, n, least).withColumn("kind", F.lit(2))

    # licence files against licence texts
    texts = counted.filter("whole and run = 0")
    n_texts = notices.filter("whole and run = 0").count()
    known, unit = weighted_terms(template_rows(spark, full_texts()), texts.groupBy("word").agg(F.count("*").alias("df")), n_texts)
    titled = F.col("license").endswith(" title")
    full = scored(counted.filter("whole").drop("whole"), known, unit, n_texts, LEAST_TEXT)
    full = full.filter(~titled | (F.col("score") >= LEAST_TITLE))
    scores = short.unionByName(full.withColumn("kind", F.when(titled, 0).otherwise(1)).withColumn("license", F.regexp_replace("license", " title$", "")))
    best = scores.groupBy("__file").agg(F.min(F.struct("kind", (-F.col("score")).alias("s"), "line", "run", "license")).alias("b"))
    own = cut_lineage(best.select("__file", F.col("b.kind").alias("kind"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score")))

    # directories: each distinct one asks all its ancestors, the deepest with a licence file answers
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    held_by = notices.filter("whole").select("__file", parent.alias("dir")).distinct().join(own, "__file")
    granted = held_by.groupBy("dir").agg(F.min(F.struct("kind", (-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("g")).select("dir", F.col("g.l").alias("license"))
    dirs = files.select(parent.alias("dir")).filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    steps = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    asked = dirs.select("dir", F.explode(steps).alias("depth"))
    asked = asked.select("dir", "depth", F.concat_ws("/", F.slice(parts, 1, F.col("depth"))).alias("above"))
    answers = asked.join(granted.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("a"))
    inherited = answers.select("dir", F.col("a.license").alias("given"), F.col("a.above").alias("given_by"))

    found = files.select("__file", "path", parent.alias("dir")).join(own, "__file", "left").join(inherited, "dir", "left")
    return found.select(
        "__file", "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("given_by")).alias("license_dir"),
    )
