from __future__ import annotations

from collections import Counter
from math import sqrt

import pytest

from tracewarp.llm import licenses as L

SCHEMA = "license string, doc_id long, path string, text string, folder int, base string, near int"
APACHE, GPL, MIT = (f" {t}" for n, t in L.TEMPLATES if n in ("Apache-2.0", "MIT", "GPL-3.0") and t.endswith(("2.0.", "MIT License.", "version 3.")) and len(t) < 75)


def frame(spark, rows):
    return spark.createDataFrame([("x", *r, 1, "b", 2) for r in rows], SCHEMA)


def brute_header(model, text):
    """Every line, sentence and run of lines with template words, compared without passing anything over."""
    lines, best = text.split("\n"), (0.0, "")
    units = [*lines, *(s for x in lines for s in L.SENTENCE.split(x))]
    units += ["\n".join(lines[i:j]) for i in range(len(lines)) for j in range(i + 2, min(len(lines), i + 9) + 1) if all(not model.signs.isdisjoint(L.words(x)) for x in lines[i:j])]
    for u in units:
        c = Counter(L.words(u))
        norm = sqrt(sum((n * model.idf.get(w, model.other)) ** 2 for w, n in c.items()))
        for name, t in L.TEMPLATES:
            v = {w: n * model.idf[w] for w, n in Counter(L.words(t)).items()}
            s = round(sum(c[w] * model.idf[w] * x for w, x in v.items()) / norm / sqrt(sum(x * x for x in v.values())), 9) if norm else 0.0
            best = min(best, (s, name), key=lambda f: (-f[0], f[1]))
    return best if best[0] >= model.threshold else None


def brute_licence(model, text):
    """The whole licence that the whole text is, by dictionaries."""
    c = Counter(L.words(text))
    norm = sqrt(sum((n * model.all_idf.get(w, model.all_other)) ** 2 for w, n in c.items()))
    best = (0.0, "")
    for name, t in L.WHOLE_TEXTS.items():
        dot = sum(c[w] * n * model.all_idf[w] ** 2 for w, n in t.items())
        s = round(dot / norm / sqrt(sum((n * model.all_idf[w]) ** 2 for w, n in t.items())), 9) if norm else 0.0
        best = min(best, (s, name), key=lambda f: (-f[0], f[1]))
    return best if best[0] >= L.WHOLE else None


def brute_paths(rows, model):
    """(doc_id, license, origin, inherited_from) by walking up from each file."""
    import re

    own, given = {}, {}
    for i, path, text in rows:
        p = [x for x in path.split("/") if x]
        found, full = brute_header(model, text or ""), brute_licence(model, text or "")
        found = full or found
        own[i] = (p, found, bool(found and (full or model.whole(text) or re.search(L.LICENSE_FILE, p[-1] if p else ""))))
        if own[i][2]:
            d = "/".join(p[:-1])
            given[d] = min(given.get(d, (0.0, "")), found, key=lambda f: (-f[0], f[1]))
    out = []
    for i, (p, found, is_file) in own.items():
        row = (i, found and found[1], "file" if is_file else "header" if found else "none", None)
        for n in range(max(len(p) - 1, 0), -1, -1) if not found else ():
            if (d := "/".join(p[:n])) in given:
                row = (i, given[d][1], "inherited", d)
                break
        out.append(row)
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.license, r.origin, r.inherited_from) for r in df.collect())


def test_equals_brute_force_on_a_table(spark):
    docs = L.document_paths(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r.doc_id, r.path, r.text) for r in docs.collect()]
    n, df = L.document_frequencies(docs)
    assert n == len(rows) and df["license"] == sum("license" in L.words(t) for _, _, t in rows)
    out = got(L.scan(docs))
    assert out == brute_paths(rows, L.Model(n, df))
    planted = {i for i, _, t in rows if any(x.strip() in t for x in (APACHE, MIT, GPL, "Licensed under CC BY-NC 4.0."))}
    assert planted == {r[0] for r in out if r[2] in ("header", "file")} and planted


@pytest.mark.parametrize(
    "text,want",
    [
        ("Much is for you quickly. Licensed under CC\nBY-NC 4.0. More about all of it", "CC-BY-NC-4.0"), ("Released under the\nMIT License.", "MIT"),
        ("// Notes\n// Permission is hereby granted, free of charge,\n// to any\n// person obtaining a copy of this software\n//\n// and associated\n// documentation files\n// Thanks", "MIT"),
        ("\n".join(["Foo", *L.words(L.TEMPLATES[2][1]), "bar"]), "Apache-2.0"),
    ],
)
def test_wrapped_notices(text, want):
    assert L.Model(10, {}).header(text) == (1.0, want)
    assert L.Model(10, {}).header("word\n" * 1000 + text + "\nword" * 1000) == (1.0, want)


def test_windows_equal_trying_all():
    import random

    r, model = random.Random(3), L.Model(50, {"the": 40, "license": 9})
    pool = [*sorted(L.VOCABULARY), "foo", "foo", "bar"]
    for _ in range(60):
        t = L.words(r.choice(L.TEMPLATES)[1])
        lines = [[r.choice(t) if r.random() < 0.7 else r.choice(pool) for _ in range(r.randint(1, 4))] for _ in range(12)]
        every = [model.cosine(" ".join(w for x in lines[i:j] for w in x)) for i in range(12) for j in range(i + 2, 13)]
        assert model._best(model._windows(lines)) == model._best(every)


def test_nearest_ancestor(spark):
    rows = [
        (1, "LICENSE", "My project." + MIT), (2, "a/x.c", "code"), (3, "a/b/COPYING.txt", GPL), (4, "a/b/c/d/y.c", ""), (5, "a/b/z.c", "int z;\n//" + APACHE),
        (6, "a/b2/w.c", None), (7, "//a//b/c/", "text"), (8, "a/b/c/e/only", MIT), (9, "a/b/c/e/v.c", "v"), (10, "README", "r"), (11, "", "t"),
    ]
    model = L.Model(*L.document_frequencies(frame(spark, rows)))
    out = got(L.scan(frame(spark, rows)))
    assert out == brute_paths(rows, model)
    assert {(r[0], r[1], r[3]) for r in out if r[2] == "inherited"} == {
        (2, "MIT", ""), (4, "GPL-3.0", "a/b"), (6, "MIT", ""), (7, "GPL-3.0", "a/b"), (9, "MIT", "a/b/c/e"), (10, "MIT", ""), (11, "MIT", ""),
    }


def test_edge_cases(spark):
    long = "word " * 400_000
    rows = [(1, None, "x"), (1, None, "x"), (None, "p/q", MIT + "\n" + long), (2, "p/LICENSE", MIT), (2, "p/LICENSE", MIT), (3, "p/LICENCE.md", APACHE), (4, "p/t", None), (5, None, MIT), (6, "r/" + "d/" * 300 + "f", "")]
    out = L.scan(frame(spark, rows))
    res = sorted(((r.doc_id, r.license, r.origin) for r in out.collect()), key=repr)
    assert res == sorted([(1, None, "none")] * 2 + [(None, "MIT", "header"), (2, "MIT", "file"), (2, "MIT", "file"), (3, "Apache-2.0", "file"), (4, "Apache-2.0", "inherited"), (5, "MIT", "file"), (6, None, "none")], key=repr)
    assert L.scan(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n,df", [(0, {}), (10, {}), (10**9, {"the": 9 * 10**8, "under": 10**8})])
def test_passing_over_lines_loses_nothing(n, df):
    model = L.Model(n, df)
    for _, t in L.TEMPLATES:
        kept = " ".join(w for w in L.words(t) if w not in model.signs)
        assert model.cosine(kept)[0] < model.threshold and model.header(f"a\n{t}\nb")


@pytest.mark.parametrize("name", sorted(L.WHOLE_TEXTS))
def test_a_whole_licence_is_known_with_its_names_filled_in(spark, name):
    text = "\n".join(" ".join([w] * n) for w, n in L.WHOLE_TEXTS[name].items())
    rows = [(1, "a/COPYING", f"Copyright (c) 2020 Some Body and others\n{text}"), (2, "a/b/c.py", "of the word"), (3, "x.py", "of the word")]
    assert got(L.scan(frame(spark, rows))) == [(1, name, "file", None), (2, name, "inherited", "a"), (3, None, "none", None)]
