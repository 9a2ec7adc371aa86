"""Pigeonhole edit matching against a plain dynamic program."""

import random

import pytest

from proofline.llm.decontaminate import Matcher, budget, contaminated, edits, normalised, tree_paths, without_contaminated


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(text, edits, rng):
    text = list(text)
    for _ in range(min(edits, len(text) - 1)):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcxyz")
        elif kind == 1:
            text.insert(at, rng.choice("abcxyz"))
        else:
            del text[at]
    return "".join(text)


@pytest.mark.parametrize("seed", range(60))
def test_matcher_agrees_with_dynamic_program(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    items = [(i, normalised(" ".join(word() for _ in range(rng.choice((1, 3, 6, 12, 25)))))) for i in range(6)]
    text = " ".join(word() for _ in range(30))
    for _, item in items:
        text += " " + edited(item.strip(), rng.randrange(0, 9), rng) + " " + word()
    text = normalised(text)
    matcher = Matcher(items, 0.1)
    found = {matcher.patterns[p].item_id: v[0] for p, v in matcher.matches(text).items()}
    expected = {}
    for pattern in matcher.patterns:
        d = plain_distance(pattern.text, text)
        if d <= pattern.k:
            expected[pattern.item_id] = d
    assert found == expected


def test_budget_leaves_a_full_tree():
    assert [budget(n, 0.1) for n in (5, 10, 29, 30, 75, 150, 309, 310)] == [0, 1, 1, 3, 7, 15, 15, 31]


@pytest.mark.parametrize("seed", range(40))
def test_whole_budget_against_dynamic_program(seed):
    """Items with up to a little more than all edits of the unrounded rate."""
    rng = random.Random(1000 + seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    items = [(i, normalised(" ".join(word() for _ in range(rng.choice((5, 8, 13, 30, 45)))))) for i in range(5)]
    text = " ".join(word() for _ in range(20))
    for _, item in items:
        text += " " + edited(item.strip(), len(item) // 10 + rng.randrange(-4, 2), rng) + " " + word()
    text, expected = normalised(text), {}
    for i, item in items:
        whole_word = len(item) - 2 < 16
        d = plain_distance(item if whole_word else item[1:-1], text)
        if d <= (0 if whole_word else (len(item) - 2) // 10):
            expected[i] = d
    matcher = Matcher(items, 0.1)
    assert {matcher.patterns[p].item_id: v[0] for p, v in matcher.matches(text).items()} == expected


def test_budget_is_the_whole_rate():
    assert [edits(n, 0.1) for n in (9, 10, 29, 30, 149, 309, 310)] == [0, 1, 2, 3, 14, 30, 31]
    assert tree_paths(1) == [[]] and tree_paths(3) == [[(0, 3)], [(1, 3), (0, 3)], [(1, 3), (0, 3)]]


def test_normalised():
    assert normalised("  Éa,B’c_d\n\n«X» ") == " éa b c d x "
    assert normalised(None) == "" and normalised(" ?! ") == ""


def test_tables(spark):
    passage = "The quick brown fox jumps over the lazy dog while nobody looks"
    docs = spark.createDataFrame(
        [(1, f"before. {passage}! after", "x"), (2, None, None), (3, "", "y"), (None, passage.upper(), "z"), (1, "clean words", "w"),
         (5, "a tiny item here", "v"), (6, "a tinyitem here", "v"), (7, passage.replace("brown", "brawn").replace(" ", "\n"), "u")],
        "doc_id long, text string, item_id string",
    )
    bench = spark.createDataFrame([(7, passage), (8, ""), (9, None), (7, passage), (4, "tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7, 0), (None, 7, 0), (5, 4, 0), (7, 7, 1)}
    blocks = {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs, bench, block_chars=40).collect()}
    assert blocks == got
    left = without_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 6, 1} and left.count() == 4
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
