"""License scans: MinHash bands retrieve templates for windows of text, exact shingle containment decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.secretscan import blob_of
from monthloom.llm.textwords import joined_small, positions, word_hashes

# Notices by which texts name their license, and the opening of longer ones.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so",
    "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((texts or TEMPLATES).items()), "license string, text string")


def shingles(words: Column, start: Column, count: Column, k: int) -> Column:
    """Hashes of ``count`` shingles of ``k`` words from word ``start`` on, as far as there are words."""
    last = F.least(start + count, F.size(words) - (k - 1)) - 1
    one = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))
    return F.when(last < start, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(start, last), one))


def signature(hashes: Column, bands: int, rows: int) -> Column:
    """Per band, a hash of the smallest values of its hash functions."""
    value = lambda n: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(n))))
    return F.array(*(F.xxhash64(F.lit(b), *(value(b * rows + r) for r in range(rows))) for b in range(bands)))


def scan_licenses(
    docs: DataFrame, templates: DataFrame, least: float = 0.8, k: int = 5, bands: int = 40, rows: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Matches of license templates: (doc_id, license, containment, position), one row per document and license.

    Texts are read in windows of a power of two shingles, each half over the last, so that a template of up to half a
    window lies whole in one of them; a template is looked for in the smallest such size. Then a window that holds a
    share c of a template has a similarity of about c / 4 at least, and the chance that none of 40 bands of one row
    collides is below 0.03 % at c = 0.8 (0.8 / 4.2 = 0.19; 0.81 ** 40). Every retrieved pair is verified: ``containment`` is the
    exact share of the template's distinct shingles in the window, and must be ``least`` or more.

    A band of one row collides only if the window holds the very shingle that is the template's smallest, so windows
    without any shingle of any template need no signature. That spares nearly all of them and changes no result.
    Templates are a parameter, counted before they are broadcast. ``position`` is the first word of the best window.

    Null and empty texts and texts shorter than a shingle match nothing and have no rows; templates of fewer than ``k``
    words cannot match. Repeated rows and null ids give their matches each. Tables may be empty.
    """
    words = F.filter(word_hashes(F.col("text")), lambda w: w != F.xxhash64(F.lit("")))
    known = templates.select("license", words.alias("words")).where(F.size("words") >= k)
    known = known.select("license", F.array_distinct(shingles(F.col("words"), F.lit(0), F.size("words"), k)).alias("shingles"))
    # The smallest window of which the template fills no more than half.
    known = known.withColumn("window", F.pow(2, F.ceil(F.log2(F.size("shingles"))) + 1).cast("int"))
    number = known.agg(F.sum(F.size("shingles")), F.max("window"), F.count("*")).first()
    total, widest, count = (number[0] or 0), (number[1] or 2), number[2]
    sizes = [2**n for n in range(1, int(math.log2(widest)) + 1)]

    single = known.select(F.explode("shingles").alias("shingle")).distinct()
    at = positions(docs, text_col)
    made = at.where(F.col("at") + k <= F.size("words")).select(
        "blob", "words", "at", F.xxhash64(*(F.get("words", F.col("at") + j) for j in range(k))).alias("shingle")
    )
    hits = joined_small(made, single, ["shingle"], total)
    # Both windows of each size that hold the hit.
    around = F.explode(F.array(*(F.struct(F.lit(s).alias("window"), F.lit(b).alias("back")) for s in sizes for b in (0, 1))))
    half = F.col("w.window") / 2
    windows = hits.select("blob", "words", "at", around.alias("w")).select(
        "blob", "words", F.col("w.window").alias("window"),
        ((F.floor(F.col("at") / half) - F.col("w.back")) * half).cast("int").alias("position"),
    )
    wanted = known.select("window").distinct()
    windows = joined_small(windows.where("position >= 0"), wanted, ["window"], count)
    # The window's words are cut out here, in the stage of the joins, and hashed once per window.
    cut = F.slice("words", F.col("position") + 1, F.col("window") + (k - 1))
    windows = windows.select("blob", "window", "position", cut.alias("words"))
    windows = windows.groupBy("blob", "window", "position").agg(F.any_value("words").alias("words"))
    windows = windows.select("blob", "window", "position", shingles(F.col("words"), F.lit(0), F.col("window"), k).alias("held"))
    banded = windows.select("*", F.explode(signature(F.col("held"), bands, rows)).alias("band"))
    listed = known.select("license", "window", "shingles", F.explode(signature(F.col("shingles"), bands, rows)).alias("band"))
    met = joined_small(banded, listed, ["window", "band"], count * bands)
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    found = met.select("blob", "license", "position", share.alias("containment")).where(F.col("containment") >= least)
    best = found.groupBy("blob", "license").agg(F.max("containment").alias("containment"), F.max_by("position", F.struct("containment", -F.col("position"))).alias("position"))
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(F.col(text_col)).alias("blob"))
    return paths.join(best, "blob").select("doc_id", "license", "containment", "position")
