"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, slices, staged

#: Notices as authors put them into headers, and how licence files begin. Common public wordings.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
    *[
        (name, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by "
         f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
        for name, what, kind, version in [
            ("GPL-3.0", "program", "General", "3"), ("GPL-2.0", "program", "General", "2"), ("LGPL-3.0", "library", "Lesser General", "3"),
            ("LGPL-2.1", "library", "Lesser General", "2.1"), ("AGPL-3.0", "program", "Affero General", "3"),
        ]
    ],
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: A line that names a licence or rights. Terms weigh by how many of these have them; what is scored does not depend on it.
NOTICE = r"(?i)licen[sc]|copyright|all rights reserved|public domain|creative commons|spdx|redistribution and use|permission is hereby"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z0-9]+)?$"
LEAST = 0.5
#: Tags that name a licence by its identifier, parts of their expressions, and identifiers that name none.
SPDX, SPDX_PART, SPDX_NONE = r"(?i)spdx-license-identifier:([^\n]*)", r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)", ("none", "noassertion")
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: How a comment line begins, lines at most of a window, numbers at most that bounds are taken with at once, terms of
#: no template at most whose own weights bounds take.
COMMENT, WINDOW_LINES, AT_ONCE, FREQUENT = r"\s*(?:#|//|/?\*|--|;|%|<!--)", 6, 2_000_000, 20_000


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(TEMPLATES)], "template int, licence string, notice string")


def notices(files: DataFrame) -> DataFrame:
    """Every line of every file that names a licence or rights: path, notice."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(NOTICE)))
    found = files.select("path", F.when(F.rlike("text", F.lit(NOTICE)), lines).alias("lines"))
    return found.select("path", F.explode("lines").alias("notice"))


def _runs(flags):
    """First and end of each run of true flags."""
    import numpy as np

    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _spans(worded, comment, whole: bool):
    """What is judged at once, as first line and end: each line, windows of some lines and runs of lines with no line
    without a word between them, runs of comment lines, and a licence file whole."""
    import numpy as np

    n = len(worded)
    blank = np.concatenate([[0], np.cumsum(~worded)])
    first, end = [], []
    for size in range(1, min(WINDOW_LINES, n) + 1):
        i = np.arange(n - size + 1)
        i = i[blank[i + size] == blank[i]]
        first.append(i)
        end.append(i + size)
    for a, b in (_runs(worded), _runs(comment), *([(np.array([0]), np.array([n]))] if whole else [])):
        first.append(a)
        end.append(b)
    both = np.unique(np.stack([np.concatenate(first), np.concatenate(end)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _identifiers(text: str) -> set[str]:
    """The licences that the SPDX tags of a text name. What follows WITH is an exception, not a licence."""
    found = set()
    for tag in re.finditer(SPDX, text):
        rest, at, before = tag.group(1), 0, ""
        while part := re.compile(SPDX_PART).match(rest, at):
            at, word = part.end(), part.group(1)
            joins = word.upper() in ("AND", "OR", "WITH")
            if word in "()" or joins:
                before = word.upper() if joins else before
                continue
            if before == "ID":
                break  # words after the expression
            if before != "WITH" and word.lower() not in SPDX_NONE:
                found.add(word)
            before = "ID"
    return found


def _blocks(bound: tuple | None, least: float):
    """Texts to the spans that may score `least`, and to the identifiers of their SPDX tags: path, notice, tag.

    bound has the numbers of terms, those of templates first, their squared weights, with the least of any other term
    at 0, and the shares of templates' terms in each template; without it all spans are given. The product with a
    template adds up over the terms, and the square of the norm is at least the sum of the squares of single terms: no
    cosine is above that bound. What is left is bounded again with its terms counted.
    """
    term, comments, licence_file = re.compile(TERM), re.compile(COMMENT), re.compile(LICENCE_FILE)

    def possible(ids, begin, first, end):
        import numpy as np

        number, square, shares = bound
        top, own = len(shares), len(square)
        weigh = np.where(ids < own, ids, 0)
        norm = np.concatenate([[0.0], np.cumsum(square[weigh])])
        norm = norm[begin[end]] - norm[begin[first]]
        known = np.flatnonzero((ids > 0) & (ids < top))
        at = np.searchsorted(known, begin)
        a, b = at[first], at[end]
        best = np.zeros(len(first))
        step = max(1, AT_ONCE // max(1, len(known) + len(first)))
        for t in range(0, shares.shape[1], step):
            sums = np.cumsum(shares[ids[known], t : t + step], axis=0)
            sums = np.concatenate([np.zeros((1, sums.shape[1])), sums])
            best = np.maximum(best, (sums[b] - sums[a]).max(axis=1))
        good = (best > 0) & (best >= (least - 1e-4) * np.sqrt(np.maximum(norm, 0)) - 1e-6)
        for k in np.flatnonzero(good).tolist():
            terms, times = np.unique(ids[begin[first[k]] : begin[end[k]]], return_counts=True)
            dot = (times[terms < top] @ shares[terms[terms < top]]).max()
            good[k] = dot >= (least - 1e-4) * math.sqrt((times.astype(float) ** 2 * square[np.where(terms < own, terms, 0)]).sum())
        return good

    def of(text: str, path: str) -> list[str]:
        import numpy as np

        lines, found, begin = text.split("\n"), [], [0]
        for line in lines:
            found += term.findall(line.lower())
            begin.append(len(found))
        begin = np.array(begin)
        comment = np.array([comments.match(line) is not None for line in lines])
        first, end = _spans(np.diff(begin) > 0, comment, licence_file.search(path) is not None)
        if bound:
            number, square, _ = bound
            others: dict[str, int] = {}
            ids = [number.get(x) or others.setdefault(x, len(square) + len(others)) for x in found]
            good = possible(np.array(ids, dtype=np.int64), begin, first, end)
            first, end = first[good], end[good]
        return list({"\n".join(lines[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)})

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for batch in slices(big, "text"):
                rows, notices, tags = [], [], []
                for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                    if text:
                        found = [(x, None) for x in of(text, str(path))] + [(None, x) for x in _identifiers(text)]
                        rows += [i] * len(found)
                        notices += [x for x, _ in found]
                        tags += [x for _, x in found]
                paths = batch.column("path").take(pa.array(rows, pa.int64()))
                yield pa.record_batch([paths, pa.array(notices, pa.string()), pa.array(tags, pa.string())], names=["path", "notice", "tag"])

    return run


def _bound(theirs: DataFrame, idf: DataFrame, unseen: float) -> tuple | None:
    """What _blocks takes to bound cosines; None where the templates are too many for that."""
    import numpy as np

    names = theirs.select("template").distinct()
    terms = theirs.select("term").distinct()
    if names.count() * terms.count() > AT_ONCE:
        return None
    rows = theirs.join(idf, "term").select("template", "licence", "term", "v", "idf").collect()
    frequent = idf.join(terms, "term", "left_anti").orderBy("idf", "term").limit(FREQUENT).collect()
    other = unseen if len(frequent) < FREQUENT else frequent[-1].idf
    number = {x: k for k, x in enumerate(sorted({r.term for r in rows}), 1)}
    column = {x: k for k, x in enumerate(sorted({(r.template, r.licence) for r in rows}, key=str))}
    shares = np.zeros((len(number) + 1, max(1, len(column))))
    square = np.full(len(number) + 1 + len(frequent), other**2)
    for r in rows:
        square[number[r.term]] = r.idf**2
        shares[number[r.term], column[r.template, r.licence]] = r.v * r.idf
    for r in frequent:
        number[r.term] = len(number) + 1
        square[number[r.term]] = r.idf**2
    return number, square, shares


def _named(tags: DataFrame, known: DataFrame) -> DataFrame:
    """Each path of an SPDX tag with its licence: the known one of that name, also without -only, -or-later or +,
    else the identifier as it stands."""
    names = known.groupBy(F.lower("licence").alias("name")).agg(F.min("licence").alias("licence"))
    ids = tags.select("tag").distinct().withColumns({"name": F.lower("tag"), "short": F.regexp_replace(F.lower("tag"), r"(-only|-or-later|\+)$", "")})
    ids = ids.join(names, "name", "left").join(names.select(F.col("name").alias("short"), F.col("licence").alias("family")), "short", "left")
    ids = staged(ids.select("tag", F.coalesce("licence", "family", "tag").alias("licence")), "identifiers")
    return tags.join(ids, "tag").select("path", F.lit(1.0).alias("score"), "licence")


def detect(files: DataFrame, known: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Each file's best matching licence: path, licence, score; files without a notice of `least` are left out.

    files has path and text, known has template, licence and notice. What is scored are lines and blocks of lines
    (_spans), since notices are wrapped. Terms weigh by how many lines that name a licence or rights (NOTICE), of the
    whole corpus, and templates, have them: 1 + ln((1 + notices) / (1 + those with the term)). Equal blocks, of which
    there may be very many, are scored once, and only those whose bound reaches `least`. SPDX tags score 1. The table of templates is given by the caller
    and small; past a million terms it is joined like any other. Ties go to the licence that comes first by name. Null
    texts have no notice, null paths are dropped; repeated paths give one row.
    """
    spark = files.sparkSession
    known = templates(spark) if known is None else known
    files = files.select("path", "text").where("path is not null")
    lines = staged(notices(files), "notices")
    distinct = lines.groupBy("notice").agg(F.count(F.lit(1)).alias("copies"))
    words = distinct.select("notice", "copies", F.explode(F.array_distinct(_terms(F.col("notice")))).alias("term"))
    wanted = known.select("template", "licence", F.explode(_terms(F.col("notice"))).alias("term"))
    wanted = wanted.groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    both = words.select("term", "copies").unionByName(wanted.select("term", F.lit(1).cast("long").alias("copies")))
    df = both.groupBy("term").agg(F.sum("copies").alias("df"))
    total = distinct.agg((F.coalesce(F.sum("copies"), F.lit(0)) + known.count()).alias("total"))
    (total,) = total.first()
    unseen = 1 + math.log(1 + total)
    idf = staged(df.select("term", (1 + F.log((1 + F.lit(total)) / (1 + F.col("df")))).alias("idf")), "idf")

    def weighted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        w = rows.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
        return w.select(*keys, "term", "w"), w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    theirs, lengths = weighted(wanted, ["template", "licence"])
    theirs = staged(theirs.join(lengths, ["template", "licence"]).select("template", "licence", "term", (F.col("w") / F.col("norm")).alias("v")), "templates")
    bound = _bound(theirs, idf, unseen)
    if theirs.count() < 1_000_000:
        theirs = F.broadcast(theirs)
    short_batches(spark)
    schema = T.StructType([files.schema["path"], T.StructField("notice", T.StringType()), T.StructField("tag", T.StringType())])
    both = staged(files.mapInArrow(_blocks(bound, least), schema), "blocks")
    blocks, tags = both.where("notice is not null").select("path", "notice"), both.where("tag is not null").select("path", "tag")
    tf = blocks.select("notice").distinct().select("notice", F.explode(_terms(F.col("notice"))).alias("term"))
    mine, norms = weighted(tf.groupBy("notice", "term").agg(F.count(F.lit(1)).alias("tf")), ["notice"])
    dots = mine.join(theirs, "term").groupBy("notice", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scores = dots.join(norms, "notice").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    best = scores.groupBy("notice").agg(F.max(F.struct("score")).alias("m"), F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    best = staged(best.select("notice", F.col("m.score").alias("score"), F.col("b.licence").alias("licence")), "scored")
    of = blocks.join(best, "notice").select("path", "score", "licence").unionByName(_named(tags, known))
    of = of.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return of.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def ancestors(path: Column) -> Column:
    """The directories above a path, the root as an empty string, each with its depth."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.struct(k.alias("depth"), F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")).alias("dir")),
    )


def inherit(files: DataFrame, detected: DataFrame) -> DataFrame:
    """Each path with its licence: its own, or that of licence files in the nearest directory above that has any.

    Returns path, licence, score, inherited_from (a directory, null for an own licence); files under no licence
    file have nulls. Of several licence files in a directory the best score counts, then the name. Directories
    with a licence are found by equi-joins on the ancestors of each path, once for each distinct directory.
    """
    files = files.select("path").where("path is not null").distinct()
    own = files.join(detected, "path", "left")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    held = detected.where(F.rlike("path", F.lit(LICENCE_FILE))).withColumn("dir", parent)
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    held = staged(held.select("dir", F.col("b.licence").alias("dir_licence"), (-F.col("b.s")).alias("dir_score")), "directories")
    bare = own.where("licence is null").select(parent.alias("parent")).distinct()
    up = bare.select("parent", F.explode(ancestors(F.concat(F.col("parent"), F.lit("/x")))).alias("a")).select("parent", "a.*")
    up = up.withColumn("dir", F.regexp_replace("dir", "^/", ""))
    near = up.join(held, "dir").groupBy("parent").agg(F.max(F.struct("depth", "dir", "dir_licence", "dir_score")).alias("n"))
    near = staged(near, "nearest")  # written before it is joined, so that Spark can split a directory with most files
    out = own.withColumn("parent", parent).join(near, "parent", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "path",
        F.coalesce("licence", "n.dir_licence").alias("licence"),
        F.coalesce("score", "n.dir_score").alias("score"),
        F.when(~mine, F.col("n.dir")).alias("inherited_from"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents as files source/language/number; the first licensed document of a source is its LICENSE."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    found = staged(detect(docs.select(plain.alias("path"), "text")), "licensed")
    place = docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), plain.alias("plain"))
    first = place.join(found, place["plain"] == found["path"], "left_semi").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("is_first", F.lit(True))
    place = place.join(first, ["source", "doc_id"], "left")
    place = staged(place.select("doc_id", "plain", F.when(F.col("is_first"), F.concat("source", F.lit("/LICENSE"))).otherwise(F.col("plain")).alias("path")), "places")
    detected = found.withColumnRenamed("path", "plain").join(place.select("plain", "path").distinct(), "plain").drop("plain")
    out = inherit(place, detected)
    return place.join(out, "path").select("doc_id", "path", "licence", "score", "inherited_from")
