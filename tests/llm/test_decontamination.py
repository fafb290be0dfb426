import random

import pytest

from gyrelake.llm import decontamination as d

WORDS = "the of and thition ndbleor erha ening onst reou theaerat whly inores anblewh shha edst lyor".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) * (rng.random() < 0.6) for _ in range(n))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["#"], [out[at], "#"]])
    return "".join(out)


def distance(item, text):
    """Least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != x), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(8, 30))) for i in range(6)]
    index = d.Index(items)
    k = dict(zip(index.ids, index.k, strict=True))
    for _ in range(6):
        i, item = rng.choice(items)
        e = rng.randrange(0, 2 * k[i] + 2)
        text = prose(rng, 12) + " " + edited(rng, item, e) + " " + prose(rng, 5)
        got = {m[0]: m[3] for m in index.matches(text)}
        for j, other in items:
            least = distance(other, text)
            assert (j in got) == (least <= k[j]), (seed, j, least, k[j])
            if j in got:
                assert got[j] == least


@pytest.mark.parametrize("length", range(1, 41))
def test_short_items_at_their_whole_budget(length):
    """Every edit that the budget allows is found, and no more, for items of each length."""
    rng = random.Random(length)
    for turn in range(12):
        item = "".join(rng.choice("abcdefgh ") for _ in range(length - 2)).join("xy")[:length]
        k = int(d.BUDGET * length)
        text = prose(rng, 4) + " " + edited(rng, item, turn % (k + 2)) + " " + prose(rng, 3)
        flat = "".join(map(chr, d.normalise(item.strip())[0]))
        least, budget = distance(flat, "".join(map(chr, d.normalise(text)[0]))), int(d.BUDGET * len(flat))
        got = [m[3] for m in d.Index([(1, item)]).matches(text)]
        assert (min(got) if got else None) == (least if least <= budget else None), (item, text)


def test_gram_lengths_keep_the_bound():
    for length in range(d.Q, 400):
        k = int(d.BUDGET * length)
        assert length + 1 - d.gram_length(length, k) * (k + 1) >= 1 and d.gram_length(length, k) >= 5


def test_q_grams():
    points = d.normalise("abcabcabcd abcabc")[0]
    for q in range(1, 10):
        h = d.grams(points, q)
        assert len(h) == len(points) + 1 - q
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (points[i : i + q].tolist() == points[j : j + q].tolist())


def test_places_and_normalisation():
    index = d.Index([(7, "An Item  of some\nLength, with marks!"), (8, "short"), (9, None), (10, "  ")])
    text = "xx İ AN ITEM OF\t\tSOME LENGTH,  with marks! yy Short"
    assert [(i, text[s:e], n) for i, s, e, n in index.matches(text)] == [(7, "AN ITEM OF\t\tSOME LENGTH,  with marks!", 0), (8, "Short", 0)]
    item = "An Item of some Length, with marks!"
    twice = f"{item} and then again {item}"
    assert [(s, e) for _, s, e, _ in d.Index([(1, item)]).matches(twice)] == [(0, 35), (51, 86)]
    assert d.Index([]).matches(text) == [] and index.matches("") == []


def test_query_and_edges(spark):
    item = "An Item of some Length, with marks!"
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "y"), (1, item, "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, f"so {item}"), (None, item), (2, None), (2, ""), (3, "other words " * 30000), (3, "a" * 200000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, r.n_matches) for r in d.contamination(spark, docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, 2), (None, 1, 2), (2, 0, 0), (2, 0, 0), (3, 0, 0), (3, 0, 0)], key=str)
    assert sorted(r.doc_id for r in d.drop_contaminated(spark, docs, bench).collect()) == [2, 2, 3, 3]
    assert d.contamination(spark, docs.limit(0), bench).collect() == []
    assert {r.contaminated for r in d.contamination(spark, docs, bench.limit(0)).collect()} == {0}


def test_blocks_cover_the_benchmark(spark):
    bench = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "item_id long, text string")
    parts = list(d.blocks(bench, 300))
    assert len(parts) > 3 and sorted(i for p in parts for i, _ in p) == list(range(40))


def test_many_blocks_give_the_rows_of_one(spark):
    """Each block is a job of its own: the plan that is left reads written hits and has no Python stage."""
    rng = random.Random(3)
    items = [(i, prose(rng, 9)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, prose(rng, 5) + " " + items[i % 12][1] + " " + items[i % 5][1] if i % 3 else prose(rng, 9), "x") for i in range(40)] + [(None, items[3][1], "y"), (41, None, None), (41, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    one, many = d.find_matches(spark, docs, bench), d.find_matches(spark, docs, bench, 300)
    told = lambda df: sorted(((r.doc_id, sorted(map(tuple, r.matches))) for r in df.collect()), key=str)
    assert len(list(d.blocks(bench, 300))) > 3 and told(one) == told(many)
    assert "MapInArrow" not in many._jdf.queryExecution().toString() and one._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    left = [d.drop_contaminated(spark, docs, bench, n) for n in (d.BLOCK_CHARS, 300)]
    assert sorted(map(str, left[0].collect())) == sorted(map(str, left[1].collect())) and left[1].columns == docs.columns


@pytest.mark.parametrize("slice_", [7, 1_000_000])
def test_repetitive_text_and_item(monkeypatch, slice_):
    """Equal q-grams as many as the product of the lengths: counted in slices, with the same result."""
    monkeypatch.setattr(d, "SLICE", slice_)
    n = 200 if slice_ == 7 else 20_000
    index = d.Index([(1, "ab" * (n // 40)), (2, "an item that is not there at all, in words of its own")])
    found = index.matches("ab" * (n // 2))
    assert {m[0] for m in found} == {1} and all(m[3] == 0 for m in found)


def test_slices_bound_memory():
    """80 million equal q-grams, which took 2 GB at once, stay below 300 MB."""
    import tracemalloc

    index = d.Index([(1, "ab" * 1000)])
    points = d.normalise("ab" * 20_000)[0]
    tracemalloc.start()
    assert index.candidates(points)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_short_items_report_every_place():
    assert [(s, e) for _, s, e, _ in d.Index([(8, "short")]).matches("Short shorts, short")] == [(0, 5), (6, 11), (14, 19)]


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(5,0)"])
def test_item_ids_of_any_type_and_clashing_columns(spark, kind):
    item = "what is the boiling point of water at the height of the sea"
    benchmark = spark.createDataFrame([(1, item, "x"), (None, None, "y")], "item_id int, text string, matches string").selectExpr(f"cast(item_id as {kind}) as item_id", "text", "matches")
    docs = spark.createDataFrame([(1, f"Q: {item}?", "m", 1), (2, "nothing", "m", 1), (None, None, "m", 1)], "doc_id int, text string, matches string, item_id int")
    got = {r.doc_id: (r.contaminated, r.matches) for r in d.contamination(spark, docs, benchmark).collect()}
    assert got == {1: (1, "1:3:62:0"), 2: (0, ""), None: (0, "")}
    kept = d.drop_contaminated(spark, docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.matches for r in kept.collect()) == ["m", "m"]
