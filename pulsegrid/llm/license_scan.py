"""License scan: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Built-in functions only. A file's sections are its lines, windows of joined neighbouring lines, and the whole text. The document frequency of every
term is counted over the lines of all files. Of each template the rarest terms are anchors: what the others weigh cannot reach
the least cosine, so only sections with an anchor are compared, exactly, by joins on their terms. The
bundled full texts, whose weight lies in words of all prose, add no anchors: they are compared with sections that hold one of a title or header.
"""

from __future__ import annotations

from collections.abc import Sequence

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import table
from pulsegrid.llm.licence_templates import more
from pulsegrid.sources.stage import materialise

# How the licences are announced.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

LEAST_COSINE = 0.7
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
"""Lines that are joined to one section."""
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying)[^/]*$"


def terms(c: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def lines_of(files: DataFrame, path: str, text: str) -> DataFrame:
    """(_path, lines): the terms of every line that has one, in order."""
    body = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    lines = F.filter(F.transform(body, terms), lambda x: F.size(x) > 0)
    # split inside the generator: what stands above it reads the words instead of splitting anew
    return files.select(F.col(path).alias("_path"), F.explode(F.array(lines)).alias("lines"))


def term_counts(lines: DataFrame) -> DataFrame:
    """(term, n): in how many lines a term stands, for every term; the term "" counts the lines."""
    line = lines.select(F.explode("lines").alias("words"))
    return line.select(F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("term")).groupBy("term").agg(F.count("term").alias("n"))


def needed(words: dict[str, float], df: dict[str, int], least: float) -> set[str]:
    """Terms of a unit vector of which a section of cosine `least` holds one: what the others weigh is too little."""
    rest, out = 1.0, set()
    for w in sorted(words, key=lambda w: (df.get(w, 0), w)):
        if rest < least ** 2 - 1e-9:
            break
        rest -= words[w] ** 2
        out.add(w)
    return out


def sections(lines: DataFrame, anchors: list[str]) -> DataFrame:
    """(_path, section, words): every window of joined neighbouring lines that holds an anchor, and the whole text of a file with one.

    Windows of up to six lines begin at every line, longer ones at every quarter of their length, the first and the last included.
    """
    known = F.array(*[F.lit(w) for w in anchors]).cast("array<string>")
    n = F.size("lines")
    here = F.filter(F.transform("lines", lambda x, i: F.when(F.arrays_overlap(x, known), i)), lambda i: i.isNotNull())
    found = lines.select("_path", "lines", F.explode(F.array(here)).alias("here")).where(F.size("here") > 0)

    def windows(size: int) -> Column:
        """Coded starts and sizes of the windows of one size: each anchored line names those it lies in, so the work grows with the lines."""
        last, step = F.greatest(n - size, F.lit(0)), max(1, size // 4) if size > 7 else 1

        def around(i: Column) -> Column:
            low, high = F.greatest(i - (size - 1), F.lit(0)), F.least(i, last)
            first, final = F.ceil(low / step).cast("int") * step, F.floor(high / step).cast("int") * step
            on_grid = F.when(first <= final, F.sequence(first, final, F.lit(step))).otherwise(F.array().cast("array<int>"))
            return F.when((last >= low) & (last <= i), F.array_append(on_grid, last)).otherwise(on_grid)

        starts = F.array_distinct(F.flatten(F.transform("here", around)))
        return F.transform(starts, lambda s: coded(s, F.least(n, F.lit(size))))

    # one number for each window: Spark tells numbers apart by hashing, but compares structs in pairs
    coded = lambda start, size: start.cast("long") * (1 << 31) + size
    codes = F.array_distinct(F.concat(*[windows(k) for k in WINDOWS], F.array(coded(F.lit(0), n))))
    code = F.col("code")
    spans = found.select("_path", "lines", F.explode(codes).alias("code")).select("_path", "lines", F.struct(
        F.shiftright(code, 31).cast("int").alias("start"), code.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("size")).alias("span"))
    return spans.select("_path", F.flatten(F.slice("lines", F.col("span.start") + 1, F.col("span.size"))).alias("words")).withColumn(
        "section", F.monotonically_increasing_id())


def own_licenses(files: DataFrame, path: str, text: str, templates: list[tuple[str, str, str]], least: float) -> DataFrame:
    """(_path, own_license, similarity) of the files that hold a notice."""
    spark = files.sparkSession
    words = [re.findall(r"[^\W_]+", x.lower()) for _, x, _ in templates]
    lines = lines_of(files, path, text)
    counts = materialise(term_counts(lines), "license-terms")
    vocabulary = spark.createDataFrame([(w,) for w in sorted({"", *(w for ws in words for w in ws)})], "term string")
    df = {r["term"]: r["n"] for r in counts.join(F.broadcast(vocabulary), "term").collect()}  # at most one row per term of the templates
    n = df.pop("", 0)
    rows, anchors = [], set()
    for t, ws in enumerate(words):
        v = {w: ws.count(w) * _idf(n, df.get(w, 0)) for w in ws}
        norm = sum(x * x for x in v.values()) ** 0.5
        unit = {w: x / norm for w, x in v.items()}
        if templates[t][2] == "short":
            anchors.add(min(unit, key=lambda w: (df.get(w, 0), w)))  # every term must be there
        elif templates[t][2] != "full":
            anchors |= needed(unit, df, least)
        rows += [(t, w, x, len(unit) if templates[t][2] == "short" else 1) for w, x in unit.items()]
    unit = spark.createDataFrame(rows, "template int, term string, u double, least_terms int")
    close = sections(lines, sorted(anchors & set(df)))
    tf = close.select("_path", "section", F.explode("words").alias("term")).groupBy("_path", "section", "term").agg(F.count("term").alias("tf"))
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1
    weights = materialise(tf.join(counts, "term").select("_path", "section", "term", (F.col("tf") * idf).alias("w")), "license-weights")
    norms = weights.groupBy("section").agg(F.sum(F.col("w") * F.col("w")).alias("norm2"))
    dots = weights.join(F.broadcast(unit), "term").groupBy("_path", "section", "template").agg(
        F.sum(F.col("w") * F.col("u")).alias("dot"), F.count("term").alias("held"), F.first("least_terms").alias("least_terms"))
    cosines = dots.where(F.col("held") >= F.col("least_terms")).join(norms, "section")
    cosines = cosines.select("_path", "template", F.least(F.lit(1.0), F.round(F.col("dot") / F.sqrt("norm2"), 9)).alias("similarity")).where(F.col("similarity") >= least)
    best = cosines.groupBy("_path").agg(F.max(F.struct(F.col("similarity"), (-F.col("template")).alias("after"))).alias("best"))
    names = F.array(*[F.lit(t) for t, _, _ in templates])
    return best.select("_path", F.get(names, -F.col("best.after")).alias("own_license"), "best.similarity")


def _idf(n: int, df: int) -> float:
    return log((1 + n) / (1 + df)) + 1


def license_scan(files: DataFrame, *, path: str = "path", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_COSINE,
                 keep: Sequence[str] = ()) -> DataFrame:
    """(path, own_license, similarity, license, inherited_from) and the `keep` columns: one row per row of `files`.

    `license` is the file's own or else that of the nearest ancestor directory (its own directory first, "" is the root) with a licence
    file that was recognised; `inherited_from` names it. Of several in one directory the best match counts, then the template named
    first. Null and empty texts hold no notice. A null path has no directory and inherits nothing; its own notices are not looked for.
    Rows that share a path are one file. Empty tables give no rows. Notices are looked for in whole texts.
    `templates` stands in place of the announcements, headers, titles, SPDX lines and full texts that are looked for otherwise.

    The ancestors are looked up once per directory, not once per file; a directory with very many files meets its one licence in a
    join that adaptive execution splits.
    """
    known = [(k, x, "notice") for k, x in (templates or TEMPLATES).items()] + ([] if templates else more())
    own = materialise(own_licenses(files.where(F.col(path).isNotNull()), path, text, known, least), "own-licenses")
    here = own.where(F.col("_path").rlike(LICENCE_FILE)).groupBy(directory(F.col("_path")).alias("_up")).agg(
        F.max_by("own_license", F.struct("similarity", "own_license")).alias("_got"))
    dirs = files.where(F.col(path).isNotNull()).select(directory(F.col(path)).alias("_dir")).distinct()
    parts = F.split("_dir", "/")
    ups = F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.lit(""))
    near = dirs.select("_dir", F.explode(F.array_distinct(ups)).alias("_up")).join(here, "_up").groupBy("_dir").agg(
        F.max_by(F.struct("_got", "_up"), F.length("_up")).alias("_near"))
    near = materialise(near.select("_dir", "_near._got", "_near._up"), "inherited-licenses")
    kept = {f"_keep_{i}": F.col(c) for i, c in enumerate(keep)}
    rows = files.select(F.col(path).alias("_path"), directory(F.col(path)).alias("_dir"), *[c.alias(n) for n, c in kept.items()]).join(own, "_path", "left").join(near, "_dir", "left")
    got = F.col("own_license").isNull()
    return rows.select(F.col("_path").alias("path"), "own_license", "similarity", F.coalesce("own_license", "_got").alias("license"), F.when(got, F.col("_up")).alias("inherited_from"), *[F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)])


def paths_of(docs: DataFrame) -> DataFrame:
    """`documents` as a tree of files: source, then ten-thousands and five-hundreds of the id; every fiftieth document is its directory's licence
    file. A document without an id has no path."""
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, F.concat(F.lit("LICENSE-"), i)).otherwise(F.concat(F.lit("doc-"), i))
    return docs.withColumn("path", F.when(i.isNotNull(), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 10_000).cast("string"), F.floor(i / 500).cast("string"), F.concat(name, F.lit(".txt")))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = paths_of(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = license_scan(docs, keep=["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "own_license", F.round("similarity", 6).alias("similarity"), "license", "inherited_from")
