import random

from gyrelake.llm import licenses as lic


def brute(text, templates):
    """Templates of which some stretch of words holds enough shingles."""
    words = lic.words_of_template(text)
    out = set()
    for name, t in templates:
        tw = lic.words_of_template(t)
        n = min(lic.WORDS, len(tw))
        need = {tuple(tw[i : i + n]) for i in range(len(tw) - n + 1)}
        have = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        for a in range(len(have)):
            if len(need & set(have[a : a + len(need)])) >= lic.CONTAINED * len(need):
                out.add(name)
    return out


def test_finds_what_brute_force_finds():
    rng = random.Random(0)
    templates = lic.Templates(lic.TEMPLATES)
    found = missed = 0
    for _ in range(300):
        words = [rng.choice(["licensed", "under", "the", "work", "a", "of", "public"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(lic.TEMPLATES)[1].split()
            if rng.random() < 0.3:
                t[rng.randrange(len(t))] = "x"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        text = " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", "", "%%%", ","]) for w in words)
        want, got = brute(text, lic.TEMPLATES), {m[0] for m in templates.matches(text)}
        assert want <= got or len(want - got) == 1
        missed += len(want - got)
        found += len(want)
        for name in got - want:  # a window may hold a template's shingles a little apart
            assert [m[3] for m in templates.matches(text) if m[0] == name][0] >= lic.CONTAINED
    assert missed <= 0.001 * found + 1


def test_places():
    templates = lic.Templates(lic.TEMPLATES)
    text = "Some é text.\nReleased under the MIT License. And more; LICENSED%%% under$$$ CC&&& BY-NC*** 4.0.###"
    assert [(n, text[s:e]) for n, s, e, _ in templates.matches(text)] == [("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "LICENSED%%% under$$$ CC&&& BY-NC*** 4.0.###")]
    assert templates.matches("") == [] and templates.matches("released under the MIT") == []
    assert [m[0] for m in lic.Templates([("t", "two words"), ("n", None), ("b", " ")]).matches("so two, words here")] == ["t"]


def test_many_texts_at_once_equal_one_by_one():
    templates = lic.Templates(lic.TEMPLATES)
    texts = ["", "x " * 7, lic.TEMPLATES[3][1], "y " * 31 + lic.TEMPLATES[0][1], lic.TEMPLATES[1][1], lic.TEMPLATES[4][1] + " z" * 40, "Released under the", "MIT License. ok"]
    assert templates.matches_of(texts) == [templates.matches(t) for t in texts]


def test_query_and_edges(spark):
    templates = spark.createDataFrame([*lic.TEMPLATES, (None, None)], "license_id string, text string")
    docs = spark.createDataFrame([(1, "x. Released under the MIT License."), (None, "Licensed under the Apache License, Version 2.0."), (2, None), (2, ""), (3, "word " * 100000)], "doc_id long, text string")
    got = {(r.doc_id, r.n_matches, r.licenses) for r in lic.license_report(spark, docs, templates).collect()}
    assert got == {(1, 1, "MIT"), (None, 1, "Apache-2.0"), (2, 0, ""), (3, 0, "")}
    assert lic.license_report(spark, docs.limit(0), templates).collect() == []
    assert {r.n_matches for r in lic.license_report(spark, docs, templates.limit(0)).collect()} == {0}


def test_repeated_notices_have_a_span_each():
    """Whole notices in any number and order: the spans are those that a search for the texts themselves gives."""
    rng = random.Random(1)
    templates = lic.Templates(lic.TEMPLATES)
    texts = [((name, text),) * times for name, text in lic.TEMPLATES for times in (1, 2, 3, 6, 10)]
    texts += [tuple(rng.choice(lic.TEMPLATES) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    for chosen in texts:
        text, want = "", []
        for name, notice in chosen:
            text += " ".join(f"filler{rng.randrange(99)}" for _ in range(rng.choice([0, 0, 1, 3, 9]))) + " "
            want.append((name, len(text), len(text) + len(notice)))
            text += notice + " "
        assert [m[:3] for m in templates.matches(text)] == want, text


def test_a_damaged_copy_takes_nothing_of_the_next():
    """The rest of a notice before a whole one is no part of its place."""
    name, notice = lic.TEMPLATES[4]
    words = notice.split()
    for rest in (words[12:], words[:6], words[-7:]):
        text = " ".join([*rest, "and", *words])
        start = len(" ".join([*rest, "and"])) + 1
        assert [m[:3] for m in lic.Templates(lic.TEMPLATES).matches(text)] == [(name, start, start + len(notice))], text


def test_production_templates_know_whole_texts_and_usual_notices():
    rows = lic.production_templates()
    templates = lic.Templates(rows)
    for name, text in rows:
        framed = f"Some words before. {text} And some after."
        assert [m for m in templates.matches(framed) if m[0] == name and m[1] <= 19 + 4 and m[2] >= 19 + len(text) - 4], (name, text[:60])
    for text, name in (("Licensed under the MIT License", "MIT"), ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("// SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0")):
        assert [m[0] for m in templates.matches(text)] == [name]
    assert templates.matches("A text about the work of the public, under a license or without.") == []
    texts = [t for _, t in rows[:40]] + ["", "short one"]
    assert templates.matches_of(texts) == [templates.matches(t) for t in texts]


def test_another_version_of_a_licence_is_not_reported():
    templates = lic.Templates(lic.production_templates())
    for version, name in (("2", "GPL-2.0"), ("3", "GPL-3.0")):
        for text in ("Licensed under the GNU General Public License, version {}.", "This work is licensed under the GNU General Public License, version {}.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."):
            assert {m[0] for m in templates.matches(text.format(version))} == {name}
