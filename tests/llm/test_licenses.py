import math
from collections import Counter

from tidewire.llm import licenses as L


def brute_best(text):
    idf, vectors, other = L.weights()
    import re

    best = (0.0, 1)
    for line in (text or "").split("\n"):
        if re.search(L.HEADER, line.lower()):
            x = {w: n * idf.get(w, other) for w, n in Counter(L._words(line)).items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            for k, v in enumerate(vectors):
                best = max(best, (round(sum(a * v.get(w, 0) for w, a in x.items()) / norm, 9), -k))
    return best[0]


FILES = [
    ("a/LICENSE", "MIT License\nReleased under the MIT License.\n" + "words " * 100, "x"),
    ("a/b/c/one.txt", "no statement here", None),
    ("a/b/two.txt", "first\nLicensed under the Apache License, Version 2.0.\n" + "long text " * 50, None),
    ("a/b/short.txt", "Licensed under CC BY-NC 4.0.", None),
    ("a/b/c/d/three.txt", None, None),
    ("ab/four.txt", "All of it without any", None),
    ("five.txt", "nothing", None),
    (None, "Licensed under CC BY-NC 4.0.", None),
    (None, "", None),
    ("a/b/c/one.txt", "no statement here", None),
    ("z/COPYING.md", "This work is licensed under the GNU General Public License, version 3. " + "x" * 9, None),
    ("z/y/x", "license " * 30000, None),
]


def test_scan(spark):
    df = spark.createDataFrame(FILES, "path string, text string, licence string").repartition(3)
    got = sorted(((r["path"], r["licence"], r["inherited_from"], r["effective_licence"], r["family"]) for r in L.scan(df).collect()), key=str)
    want = [
        ("a/LICENSE", "MIT", None, "MIT", "permissive"),
        ("a/b/c/one.txt", None, "a/b", "CC-BY-NC-4.0", "noncommercial"),
        ("a/b/two.txt", "Apache-2.0", None, "Apache-2.0", "permissive"),
        ("a/b/short.txt", "CC-BY-NC-4.0", None, "CC-BY-NC-4.0", "noncommercial"),
        ("a/b/c/d/three.txt", None, "a/b", "CC-BY-NC-4.0", "noncommercial"),
        ("ab/four.txt", None, None, None, None),
        ("five.txt", None, None, None, None),
        (None, "CC-BY-NC-4.0", None, "CC-BY-NC-4.0", "noncommercial"),
        (None, None, None, None, None),
        ("a/b/c/one.txt", None, "a/b", "CC-BY-NC-4.0", "noncommercial"),
        ("z/COPYING.md", "GPL-3.0", None, "GPL-3.0", "copyleft"),
        ("z/y/x", None, "z", "GPL-3.0", "copyleft"),
    ]
    assert got == sorted(want, key=str)
    assert L.scan(df.limit(0)).count() == 0


def test_scores_equal_brute_force(spark):
    df = spark.createDataFrame(FILES, "path string, text string, licence string")
    got = df.select("text", L.own_licence(df["text"]).alias("o")).collect()
    assert [round(r["o"]["score"], 6) for r in got] == [round(brute_best(r["text"]), 6) for r in got]


def test_root_licence_file(spark):
    df = spark.createDataFrame([("LICENSE", "Released under the MIT License."), ("p/q.txt", "x"), ("r.txt", "y")], "path string, text string")
    assert {(r["path"], r["effective_licence"], r["inherited_from"]) for r in L.scan(df).collect()} == {("LICENSE", "MIT", None), ("p/q.txt", "MIT", ""), ("r.txt", "MIT", "")}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(FILES, "path string, text string, licence string")
    plan = df.select(L.own_licence(df["text"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


STATED = [
    ("All rights reserved.", "proprietary"),
    ("A long first line of prose.\nAll rights reserved.\nMore prose.", "proprietary"),
    ("This document is released under the MIT License by its authors in 2021.", "MIT"),
    ("Copyright (c) 2021 Jane Doe. Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("Prose before it. This work is licensed under\n# the GNU General Public\n# License, version 3. Prose behind it.", "GPL-3.0"),
    ("Copyright 2021 Jane Doe. All rights reserved.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files", "MIT"),
    ("The licence of the bridge was renewed and all copyright questions were left open.", None),
    ("Rights of all passengers are reserved for the ferry.", None),
]


def test_statements_in_running_text(spark):
    df = spark.createDataFrame([(f"d/{i}/LICENSE" if "hereby" in t else f"d/{i}/f.txt", t) for i, (t, _) in enumerate(STATED)], "path string, text string")
    got = {r["path"].split("/")[1]: r["licence"] for r in L.scan(df).collect()}
    assert [got[str(i)] for i in range(len(STATED))] == [want for _, want in STATED]
