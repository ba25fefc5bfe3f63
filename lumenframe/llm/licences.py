"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

Only DataFrame functions. A template of t shingles looks at windows of t + s - 1 shingles or a little
more, s apart (s is a power of two, at most an eighth of t), so that one of them holds a whole occurrence. A window that holds the needed
share of a template has a Jaccard similarity of at least j with it; with bands of one MinHash value
each, a template is missed with probability (1 - j)^bands, and the bands are as many as make that
``MISS`` at most. Whatever a band retrieves is verified on the window's shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORDS = 5               # of a shingle
SHARE = 0.8             # of a template's shingles that a window must hold
MISS = 1e-4
SEGMENT = 2_048         # shingles of a text handled at once

# License lines and notices as published.
TEMPLATES = {
    "apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0 line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "mit line": "Released under the MIT License.",
    "apache-2.0 notice": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "gpl notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mit grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
}


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside lambdas."""
    return F.transform(F.array(value), use)[0]


def shingles_of(words: Column) -> Column:
    """64-bit hashes of all runs of ``WORDS`` words, in order."""
    return bound(words, lambda w: F.when(
        F.size(w) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(w) - WORDS + 1), lambda i: F.xxhash64(*[w[i - 1 + k] for k in range(WORDS)]))).otherwise(F.array().cast("array<bigint>")))


def window_plan(shingles: int) -> tuple[int, int, int, int]:
    """(distance of windows, shingles of a window, shingles needed, bands) for a template's length."""
    step = 1 << max(0, (shingles // 8).bit_length() - 1)
    width, needed = -(-(shingles + step - 1) // step) * step, math.ceil(SHARE * shingles - 1e-9)
    j = needed / (width + shingles - needed)
    return step, width, needed, 1 if j == 1 else math.ceil(math.log(MISS) / math.log(1 - j))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles), distinct shingles of each template that has any; as many rows as templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    return rows.select("license", F.array_distinct(shingles_of(words_of(F.col("body")))).alias("shingles")).where(F.size("shingles") > 0)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, license, containment, first_word) for each document and template found in it.

    Words are lower-case runs of ASCII letters and digits. A template is found when a window of the
    text holds at least ``SHARE`` of its distinct shingles; ``containment`` is the largest such share
    and ``first_word`` the start of the first window that reaches it (from 0). Whole texts are read,
    in segments. Null, empty and short texts give no row; rows with the same id (nulls too) count as
    one document; equal rows change nothing. Other columns are left out.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates).collect()
    if not known:
        return docs.select(F.col(id).alias(id)).limit(0).selectExpr(f"`{id}`", "'' as license", "0.0D as containment", "0L as first_word")
    plans = {r.license: window_plan(len(r.shingles)) for r in known}
    kinds = sorted({p[:2] for p in plans.values()})
    # The band index: one row for each template and band.
    index = spark.createDataFrame([(r.license, r.shingles, *plans[r.license]) for r in known], "license string, template array<long>, step int, width int, needed int, bands int")
    index = index.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    index = index.withColumn("best", F.array_min(F.transform("template", lambda h: F.struct(F.xxhash64(h, F.col("band")).alias("low"), h.alias("h")))))
    # A window's MinHash value can be a template's only if the window holds the shingle that gives it:
    # windows without any such shingle need no values.
    givers = sorted({r.h for r in index.select("best.h").collect()})
    index = index.select("license", "template", "needed", F.col("step").alias("t_step"), F.col("width").alias("t_width"), F.col("band").alias("t_band"), F.col("best.low").alias("t_low"))
    widest, most = max(w for _, w in kinds), max(p[3] for p in plans.values())
    rows = docs.select(F.col(id).alias("doc"), shingles_of(words_of(F.col(text))).alias("all")).where(F.exists("all", lambda h: h.isin(givers)))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(SEGMENT))
    parts = F.transform(starts, lambda a: F.struct(a.alias("a"), F.slice("all", a + 1, F.lit(SEGMENT + widest)).alias("s")))
    rows = rows.select("doc", F.explode(parts).alias("part")).select("doc", "part.a", "part.s")

    def around(p: Column, step: int, width: int) -> Column:
        """The windows of one kind that start in the segment and hold the shingle at place p of it."""
        first = F.greatest(F.ceil((F.col("a") + p - width + 1) / step), F.ceil(F.col("a") / step)).cast("int")
        last = F.floor((F.col("a") + F.least(p, F.lit(SEGMENT - 1))) / step).cast("int")
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: F.struct(F.lit(step).alias("step"), F.lit(width).alias("width"), (k * step).alias("at")))).otherwise(
            F.array().cast("array<struct<step:int,width:int,at:int>>"))

    places = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda p: F.get(F.col("s"), p).isin(givers))
    windows = F.array_distinct(F.flatten(F.transform(places, lambda p: F.concat(*[around(p, *k) for k in kinds]))))
    seen = rows.select("doc", "a", "s", F.explode(windows).alias("w")).select("doc", "w.*", F.slice("s", F.col("w.at") - F.col("a") + 1, F.col("w.width")).alias("held"))
    seen = seen.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("low", F.array_min(F.transform("held", lambda h: F.xxhash64(h, F.col("band")))))
    # As many rows as templates have bands: a bound set by the caller's list, far below the threshold of broadcasts.
    match = (F.col("low") == F.col("t_low")) & (F.col("band") == F.col("t_band")) & (F.col("step") == F.col("t_step")) & (F.col("width") == F.col("t_width"))
    hits = seen.join(F.broadcast(index) if len(known) <= 1_000 else index, match)
    share = F.size(F.array_intersect("template", "held"))
    verified = hits.select("doc", "license", "at", "needed", share.alias("n"), (share / F.size("template")).alias("containment")).where("n >= needed")
    best = verified.groupBy("doc", "license").agg(F.max(F.struct("containment", (-F.col("at").cast("long")).alias("back"))).alias("best"))
    return best.select(F.col("doc").alias(id), "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))
