"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

A file's header lines are the lines that name a licence, copyright or permission. The TF-IDF vectors of each such line, run
of such lines and sentence (of a licence file, the whole text too) are compared with the templates' (document frequencies are those of the templates; a word in no template weighs the most); the best
part and template at or above a threshold give the file's own licence. Short statements also count inside running text. A file of a licence file's name, or one that is
little more than a licence statement, speaks for its directory; of several the best match (then the first path) counts.
Files without a licence of their own take that of the nearest ancestor directory that has one, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut

#: Statements by which licences are declared (licence, family, statement).
TEMPLATES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "permissive", "Released under the MIT License"),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "copyleft", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0"),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright under CC0 1.0"),
    ("proprietary", "restricted", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited"),
)
#: Short statements that hold wherever their words stand in a text, one after the other.
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"), ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "under CC BY-NC 4.0"), ("CC-BY-SA-4.0", "under CC BY-SA 4.0"), ("CC-BY-4.0", "under CC BY 4.0"), ("CC0-1.0", "under CC0 1.0"),
    *((n, f"SPDX-License-Identifier: {n}") for n in ("Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0", "CC0-1.0")),
    ("proprietary", "Unauthorized copying of this file is strictly prohibited"),
)
#: Stands in permissive headers too, so it counts only where nothing else is found.
RESERVED = ("proprietary", "All rights reserved")
HEADER = "licen[sc]e|copyright|permission|permitted|redistribut|gnu |public domain|all rights reserved|cc0|cc by|spdx"
MORE = r"|unauthorized\s+copying|all\s+rights\s+reserved|public\s+domain|cc\s+by"
FILE_NAME = "(?i)^(un)?(licen[sc]e|copying|notice)([.-].*)?$"
THRESHOLD = 0.6
STATEMENT_WORDS = 40


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def weights() -> tuple[dict[str, float], list[dict[str, float]], float]:
    """IDF of each template word, unit vectors of the templates, IDF of any other word; rounded, so that SQL has the same numbers."""
    bags = [Counter(_words(t)) for _, _, t in TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = {w: round(math.log((1 + len(bags)) / (1 + n)) + 1, 9) for w, n in sorted(df.items())}
    vectors = []
    for b in bags:
        v = {w: n * idf[w] for w, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: round(x / norm, 9) for w, x in v.items()})
    return idf, vectors, round(math.log(1 + len(bags)) + 1, 9)


def _map(values: dict[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def own_licence(text: Column) -> Column:
    """struct(score, template): the best cosine over the header lines and its template's place, (0, -1) without a header."""
    return _best(text, F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(HEADER)), HEADER)


def found_licence(text: Column, whole: Column) -> Column:
    """struct(score, template): the best over header lines, runs of header lines, sentences and (where `whole`) the text.

    Words of STATEMENTS in a row score 1. RESERVED counts only where nothing else reaches THRESHOLD.
    """
    header = HEADER + MORE
    is_header = lambda x: F.lower(x).rlike(header)
    lines = F.split(text, "\n")
    runs = F.split(F.array_join(F.transform(lines, lambda x: F.when(is_header(x), x).otherwise(F.lit("\x01"))), "\n"), "\x01")
    sentences = F.split(F.regexp_replace(text, r"\s*\n[\s#*/;-]*", " "), r"(?<=[.!?])\s+(?=[\p{Lu}(])")
    segments = F.filter(F.array_distinct(F.concat(lines, runs, sentences, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))), is_header)
    best = _best(text, segments, header)
    said = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    says = lambda statement: F.contains(said, F.lit(f" {' '.join(_words(statement))} "))
    place: dict[str, int] = {}
    for k, (name, _, _) in enumerate(TEMPLATES):
        place.setdefault(name, k)
    result = lambda name: F.struct(F.lit(1.0).alias("score"), F.lit(place[name]).alias("template"))
    stated = F.coalesce(*(F.when(says(t), result(n)) for n, t in STATEMENTS))

    # one evaluation of the cosines; a statement word for word beats a lesser cosine
    def choose(b: Column) -> Column:
        return F.when((b["score"] < 1) & stated.isNotNull(), stated).when((b["score"] < THRESHOLD) & says(RESERVED[1]), result(RESERVED[0])).otherwise(b)

    none = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("template"))
    return F.when(F.lower(text).rlike(header), F.transform(F.array(best), choose)[0]).otherwise(none)


def _best(text: Column, segments: Column, header: str) -> Column:
    idf, vectors, other = weights()

    def judged(line: Column) -> Column:
        """The best template of a segment, in time of one sort of its words: equal words stand in a row, and the nth of them adds (2n - 1) squared weights to the norm."""
        words = F.array_sort(F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != ""))
        weight = lambda w: F.coalesce(F.try_element_at(_map(idf), w), F.lit(other))

        def count(acc: Column, w: Column) -> Column:
            run = F.when(acc["w"] == w, acc["run"] + 1).otherwise(1.0)
            weigh = F.when(acc["w"] == w, acc["weight"]).otherwise(weight(w))
            return F.struct(w.alias("w"), run.alias("run"), weigh.alias("weight"), (acc["sum"] + (2 * run - 1) * weigh * weigh).alias("sum"))

        def best(ws: Column) -> Column:
            start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("run"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("sum"))
            norm = F.sqrt(F.aggregate(ws, start, count, lambda acc: acc["sum"]))
            known = F.filter(ws, lambda w: F.try_element_at(_map(idf), w).isNotNull())

            def scores(pair: Column) -> Column:
                dot = lambda v: F.aggregate(pair["known"], F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(_map({x: idf[x] * y for x, y in v.items()}), w), F.lit(0.0)))
                return F.array_max(F.array(*(F.struct(F.round(dot(v) / pair["norm"], 9).alias("score"), F.lit(-k).alias("k")) for k, v in enumerate(vectors))))

            return F.transform(F.array(F.struct(norm.alias("norm"), known.alias("known"))), scores)[0]

        return F.transform(F.array(words), best)[0]

    none = F.struct(F.lit(0.0).alias("score"), F.lit(1).alias("k"))
    found = F.when(F.lower(text).rlike(header), F.coalesce(F.array_max(F.transform(segments, judged)), none)).otherwise(none)
    return F.struct(found["score"].alias("score"), (-found["k"]).alias("template"))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds licence (own, or null), licence_score, inherited_from (a directory, or null), effective_licence and family to every row.

    Null texts have no header. A null path has no directories; "/" separates, the part behind the last one is the file's
    name. Rows are kept, repeated ones too. Columns of these names are replaced, and the text column is left out.
    """
    added = ("licence", "licence_score", "inherited_from", "effective_licence", "family")
    kept = [c for c in files.columns if c.lower() not in added and c != text]
    names = F.array(*(F.lit(n) for n, _, _ in TEMPLATES))
    sets = F.array(*(F.lit(f) for _, f, _ in TEMPLATES))
    n_words = F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    place = F.col(f"`{path}`")
    named = F.coalesce(F.regexp_extract(place, "[^/]*$", 0).rlike(FILE_NAME), F.lit(False))
    found = files.withColumn("__own", found_licence(F.col(text), named)).withColumns({"__has": F.col("__own.score") >= threshold, "__dir": F.regexp_extract(place, "^(.*)/[^/]*$", 1)})
    scanned = cut(
        found.select(
            *(F.col(f"`{c}`") for c in kept), "__dir", F.when(F.col("__has"), F.get(names, F.col("__own.template"))).alias("licence"), F.col("__own.score").alias("licence_score"),
            (F.col("__has") & place.isNotNull() & (F.regexp_extract(place, "[^/]*$", 0).rlike(FILE_NAME) | (n_words <= STATEMENT_WORDS))).alias("__speaks"),
        ),
        "scanned",
    )
    grants = scanned.where("__speaks").groupBy(F.col("__dir").alias("__from")).agg(F.min(F.struct((-F.col("licence_score")).alias("s"), F.col(f"`{path}`").alias("p"), F.col("licence").alias("l"))).alias("g")).select("__from", F.col("g.l").alias("__granted"))
    # each directory once, with itself and all its ancestors; "" is the root
    dirs = scanned.where(F.col(f"`{path}`").isNotNull()).select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("__dir") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("__from")).distinct()
    nearest = above.join(grants, "__from").groupBy("__dir").agg(F.max(F.struct(F.length("__from").alias("n"), "__from", "__granted")).alias("g"))
    nearest = cut(nearest.select("__dir", "g.__from", "g.__granted"), "nearest")
    joined = scanned.join(nearest, "__dir", "left")
    takes = F.col("licence").isNull() & F.col(f"`{path}`").isNotNull()
    effective = F.coalesce("licence", F.when(takes, F.col("__granted")))
    family = F.get(sets, F.array_position(names, effective).cast("int") - 1)
    return joined.select(*(F.col(f"`{c}`") for c in kept), "licence", "licence_score", F.when(takes, F.col("__from")).alias("inherited_from"), effective.alias("effective_licence"), family.alias("family"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top directory, each hundred keys a directory below it; see scan for nulls and ties."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return scan(files)


def _oracle() -> str:
    idf, vectors, other = weights()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(n)}, {quote(f)})" for k, (n, f, _) in enumerate(TEMPLATES))
    vec = ", ".join(f"({k}, {quote(w)}, {x!r})" for k, v in enumerate(vectors) for w, x in v.items())
    words = ", ".join(f"({quote(w)}, {x!r})" for w, x in idf.items())
    place: dict[str, int] = {}
    for k, (name, _, _) in enumerate(TEMPLATES):
        place.setdefault(name, k)
    spoken = lambda t: f" {' '.join(_words(t))} "
    said = ", ".join(f"({n}, {place[name]}, {quote(spoken(t))})" for n, (name, t) in enumerate(STATEMENTS))
    header, reserved, reserved_k = HEADER + MORE, spoken(RESERVED[1]), place[RESERVED[0]]
    return rf"""
WITH templates(k, name, family) AS (VALUES {rows}), vectors(k, w, v) AS (VALUES {vec}), idf(w, i) AS (VALUES {words}),
files AS (SELECT doc_id, source || '/' || CAST(floor(doc_id / 100.0) AS BIGINT) || '/' || doc_id || '.txt' AS path, text FROM documents),
folded AS (SELECT *, lower(text) AS low FROM files WHERE regexp_matches(lower(text), '{header}')),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM folded),
marked AS (SELECT *, regexp_matches(lower(line), '{header}') AS is_header FROM lines),
runs AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS line FROM (SELECT *, ln - row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS g FROM marked WHERE is_header) GROUP BY doc_id, g),
sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\s*\n[\s#*/;-]*', ' ', 'g'), '([.!?])\s+([\p{{Lu}}(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS line FROM folded),
headers AS (SELECT doc_id, row_number() OVER () AS ln, line FROM (SELECT doc_id, line FROM marked WHERE is_header UNION SELECT * FROM runs UNION SELECT * FROM sentences WHERE regexp_matches(lower(line), '{header}'))),
terms AS (SELECT doc_id, ln, w, count(*) AS n FROM (SELECT doc_id, ln, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS w FROM headers) WHERE w <> '' GROUP BY ALL),
weighed AS (SELECT doc_id, ln, w, n * coalesce(i, {other!r}) AS x FROM terms LEFT JOIN idf USING (w)),
norms AS (SELECT doc_id, ln, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
cosines AS (SELECT doc_id, ln, k, sum(x * v) AS dot FROM weighed JOIN vectors USING (w) GROUP BY ALL),
cosine AS (SELECT doc_id, score, k FROM (SELECT doc_id, round(dot / norm, 9) AS score, k, row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / norm, 9) DESC, k) AS r FROM cosines JOIN norms USING (doc_id, ln)) WHERE r = 1),
said AS (SELECT doc_id, ' ' || regexp_replace(low, '[^a-z0-9]+', ' ', 'g') || ' ' AS words FROM folded),
statements(ord, said_k, statement) AS (VALUES {said}),
stated AS (SELECT doc_id, arg_min(said_k, ord) AS said_k FROM said JOIN statements ON contains(words, statement) GROUP BY doc_id),
best AS (
  SELECT f.doc_id, 1 AS r,
    CASE WHEN coalesce(c.score, 0) < 1 AND s.said_k IS NOT NULL THEN s.said_k WHEN coalesce(c.score, 0) < {THRESHOLD} AND contains(w.words, '{reserved}') THEN {reserved_k} ELSE c.k END AS k,
    CASE WHEN coalesce(c.score, 0) < 1 AND s.said_k IS NOT NULL THEN 1.0 WHEN coalesce(c.score, 0) < {THRESHOLD} AND contains(w.words, '{reserved}') THEN 1.0 ELSE c.score END AS score
  FROM folded f JOIN said w USING (doc_id) LEFT JOIN cosine c USING (doc_id) LEFT JOIN stated s USING (doc_id)
),
scanned AS (
  SELECT f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, coalesce(score, 0) AS score, CASE WHEN score >= {THRESHOLD} THEN name END AS licence,
    coalesce(score >= {THRESHOLD}, false) AND len(regexp_split_to_array(trim(coalesce(text, '')), '\s+')) <= {STATEMENT_WORDS} AS speaks
  FROM files f LEFT JOIN best b ON b.doc_id = f.doc_id AND b.r = 1 LEFT JOIN templates t ON t.k = b.k
),
grants AS (SELECT dir AS origin, arg_min(licence, (-score, path)) AS granted FROM scanned WHERE speaks GROUP BY dir),
dirs AS (SELECT DISTINCT dir FROM scanned WHERE dir IS NOT NULL),
nearest AS (SELECT dir, origin, granted, row_number() OVER (PARTITION BY dir ORDER BY length(origin) DESC) AS r FROM dirs JOIN grants ON dir = origin OR origin = '' OR starts_with(dir, origin || '/')),
joined AS (
  SELECT s.doc_id, s.path, s.licence, s.score AS licence_score, CASE WHEN s.licence IS NULL THEN origin END AS inherited_from, coalesce(s.licence, granted) AS effective_licence
  FROM scanned s LEFT JOIN nearest n ON n.dir = s.dir AND n.r = 1
)
SELECT j.*, (SELECT min(family) FROM templates t WHERE t.name = j.effective_licence) AS family FROM joined j
"""


ORACLE = _oracle()
