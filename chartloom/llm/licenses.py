"""Licence scan with DataFrame functions only: TF-IDF cosine to templates, then inheritance from directories.

Passages are lines that speak of licences (headers, notices), each such line with the short lines after it, as notices
and titles are wrapped, and the whole text of licence files. Distinct passages are scored once. A file takes the licence of its best passage; one without takes that of the nearest directory above
it that has a licence file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CUE = r"(?i)licen[sc]e|copyright|spdx|creative commons|public domain|free software|hereby granted|redistribution and use|cc0|permission to use"
#: A passage goes on over so many lines, up to one without words or longer than this.
BLOCK_LINES, BLOCK_CHARS = 8, 100
#: Openings of public licence texts and of the notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "The MIT License (MIT)"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Artistic-1.0", "The Artistic License"),
    ("BSD-2-Clause", "The BSD 2-Clause License"),
    ("BSD-3-Clause", "The BSD 3-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work: dedicated to the public domain, CC0 1.0 Universal."),
)


@dataclass(frozen=True)
class Settings:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    threshold: float = 0.6
    #: Rows (distinct terms, passages, directories) that a broadcast may hold; beyond that they are shuffled.
    broadcast_rows: int = 200_000
    licence_file: str = field(default=r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)[^/]*$")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9.+-]+|[.]+(?![a-z0-9])"), "")


def passages_of(body: Column, is_file: Column) -> Column:
    """The distinct passages of a text, in the order of its lines; see above."""

    def of(lines: Column) -> Column:
        cues = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"].rlike(CUE))

        def block(x: Column) -> Column:
            after = F.slice(lines, x["i"] + 2, BLOCK_LINES - 1)
            ends = F.array_position(F.transform(after, lambda y: ~y.rlike(r"[\p{L}\p{N}]") | (F.length(y) > BLOCK_CHARS)), True)
            more = F.slice(after, 1, F.when(ends == 0, F.size(after)).otherwise(ends - 1).cast("int"))
            return F.when(F.length(x["line"]) > BLOCK_CHARS, x["line"]).otherwise(F.array_join(F.concat(F.array(x["line"]), more), " "))

        title = F.slice(F.filter(lines, lambda y: y.rlike(r"[\p{L}\p{N}]")), 1, 2)
        whole = F.when(is_file & (F.trim(body) != ""), F.array(body, F.array_join(title, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.transform(F.concat(F.transform(cues, lambda x: x["line"]), F.transform(cues, block), whole), lambda y: F.trim(y)))

    # most texts say nothing of licences and are not split
    return F.when(is_file | body.rlike(CUE), F.get(F.transform(F.array(F.split(body, "\n")), of), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def scored(passages: DataFrame, settings: Settings) -> DataFrame:
    """(id, licence, score) of distinct passages (id, passage, n), as a written table; the best template of each.

    Document frequencies count every passage as often as it was found, and every template once.
    """
    spark = passages.sparkSession
    templates = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(settings.templates)], "template int, licence string, body string")
    tf = passages.select("id", "n", F.explode(terms(F.col("passage"))).alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    own = templates.select("template", "licence", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    df = written(tf.select("term", "n").union(own.select("term", F.lit(1).cast("long"))).groupBy("term").agg(F.sum("n").alias("df")), "terms")
    total = (passages.agg(F.sum("n")).first()[0] or 0) + len(settings.templates)
    idf = _small(df.select("term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), settings.broadcast_rows)
    weight = (1 + F.log("tf")) * F.col("idf")
    own = own.join(idf, "term").withColumn("w", weight)
    own = F.broadcast(own.join(own.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "template").select("term", "template", "licence", (F.col("w") / F.col("norm")).alias("t")))
    mine = written(tf.join(idf, "term").select("id", "term", weight.alias("w")), "weights")
    norm = mine.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = mine.join(own, "term").groupBy("id", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot")).join(norm, "id")
    best = dots.groupBy("id").agg(F.max(F.struct(F.round(F.col("dot") / F.col("norm"), 9).alias("score"), "licence")).alias("b"))
    return written(best.select("id", "b.licence", "b.score"), "scored")


def ancestors(folder: Column) -> Column:
    """The folder itself and those above it, the root as an empty text, each with its depth."""
    parts = F.split(folder, "/")
    some = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("folder"), k.alias("depth")))
    return F.when(folder == "", F.array(F.struct(F.lit("").alias("folder"), F.lit(0).alias("depth")))).otherwise(F.concat(F.array(F.struct(F.lit("").alias("folder"), F.lit(0).alias("depth"))), some))


def scanned(files: DataFrame, path: str = "path", text: str = "text", key: str | None = None, licence_file: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of files: key (if named), path, own_licence, score, licence, inherited_from, distance.

    own_licence is the best template at or above the threshold (ties: the later name), else null; licence is that or
    the one of the nearest folder above, whose name is inherited_from and which is distance levels up (0: the same
    folder). licence_file says which rows give their folder a licence; by default their names do. Of several in one
    folder the best score counts, then the first path. Null paths lie in the root under no name; null and empty texts
    have no licence of their own. Repeated rows come out each. Scores are rounded to nine digits.
    """
    is_file = F.coalesce(F.col(f"`{path}`").rlike(settings.licence_file) if licence_file is None else licence_file, F.lit(False))
    name, body = F.coalesce(F.col(f"`{path}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{key}`").alias("_key")] if key else []
    found = passages_of(body, is_file)
    rows = written(files.select(*kept, F.col(f"`{path}`").alias("_path"), F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise("").alias("_folder"), is_file.alias("_is_file"), found.alias("_passages")), "passages")
    each = rows.select(F.explode("_passages").alias("passage")).select(F.md5("passage").alias("id"), "passage")
    passages = written(each.groupBy("id").agg(F.first("passage").alias("passage"), F.count("*").alias("n")), "distinct")
    best = scored(passages, settings).where(F.col("score") >= settings.threshold)
    best = written(best, "licensed")
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    hits = rows.where(F.size("_passages") > 0).select("_id", F.explode(F.transform("_passages", lambda x: F.md5(x))).alias("id")).join(_small(best, settings.broadcast_rows), "id")
    own = written(hits.groupBy("_id").agg(F.max(F.struct("score", "licence")).alias("o")).select("_id", "o.licence", "o.score"), "own")
    rows = rows.drop("_passages").join(own.withColumnsRenamed({"licence": "own_licence"}), "_id", "left")
    folders = rows.where("_is_file and own_licence is not null").groupBy("_folder").agg(F.max_by("own_licence", F.struct("score")).alias("_l"), F.max("score").alias("_s"))
    first = rows.where("_is_file and own_licence is not null").join(folders.select("_folder", "_s"), "_folder").where("score = _s").groupBy("_folder").agg(F.min_by("own_licence", F.struct("_path", "own_licence")).alias("given"))
    folders = written(first, "folders")
    above = rows.select("_folder").distinct().select("_folder", F.size(F.split("_folder", "/")).alias("_d"), F.explode(ancestors(F.col("_folder"))).alias("a"))
    above = above.join(_small(folders.withColumnRenamed("_folder", "_up"), settings.broadcast_rows), F.col("a.folder") == F.col("_up"))
    nearest = above.groupBy("_folder").agg(F.max(F.struct(F.col("a.depth").alias("depth"), F.col("_up").alias("up"), "given")).alias("n"))
    nearest = written(nearest.select("_folder", "n.given", F.col("n.up").alias("up"), (F.when(F.col("_folder") == "", 0).otherwise(F.size(F.split("_folder", "/"))) - F.col("n.depth")).alias("d")), "nearest")
    out = rows.join(_small(nearest, settings.broadcast_rows), "_folder", "left")
    inherits = F.col("own_licence").isNull()
    return out.select(*([F.col("_key").alias(key)] if key else []), F.col("_path").alias(path), "own_licence", "score", F.coalesce("own_licence", "given").alias("licence"), F.when(inherits, F.col("up")).alias("inherited_from"), F.when(inherits, F.col("d")).cast("long").alias("distance"))
