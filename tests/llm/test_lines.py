"""Line dedup against all pairs of lines."""

import random
import re

import pytest

from proofline.llm import lines
from proofline.llm.lines import dedup_lines, line_report


def plain(rows):
    """Remaining texts by brute force; equal rows are one document."""
    lines = []
    for doc_id, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate(text.split("\n")):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            lines.append((doc_id, i, text, words))
    gone = set()
    for k, (doc_id, i, text, words) in enumerate(lines):
        earlier = [x for x in lines[:k] if (x[0], x[1]) != (doc_id, i) or x[2] != text]
        if words and any(5 * len(words & x[3]) >= 4 * len(words | x[3]) for x in earlier if x[3]):
            gone.add((doc_id, i, text))
    return sorted(
        ((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i, t) not in gone)) for d, t in rows), key=str
    )


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 4, 5, 9, 10, 11, 20, 40)))] for _ in range(40)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return (rng.choice((" ", "\t", "  "))).join(words)

    rows = [(k, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randrange(1, 9)))) for k in range(40)]
    rows += [(40, None), (41, ""), rows[3], rows[3]]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, words string")
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == plain(rows)


def test_report_and_empty(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e\nx\n\n"), (2, "a b c d e f\nx y"), (None, "a b c d e"), (3, None)], "doc_id long, text string"
    )
    rows = {r.doc_id: (r.n_lines, r.n_removed, r.removed_chars) for r in line_report(docs).collect()}
    # The null id comes first, so its line stays and the later ones go.
    assert rows == {1: (4, 1, 9), 2: (2, 1, 11), None: (1, 0, 0), 3: (0, 0, 0)}
    assert dedup_lines(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, "x", 1.5), (2, "a b c d e\nz", 6, "y", 2.5)], "doc_id long, text string, _gone long, _gone_id string, `_GONE_hash` double")
    assert sorted(map(tuple, dedup_lines(docs).collect())) == [(1, "a b c d e", 5, "x", 1.5), (2, "z", 6, "y", 2.5)]
    assert dedup_lines(docs).columns == docs.columns


def test_a_group_of_near_copies_makes_few_pairs_and_short_plans(spark, monkeypatch):
    """Candidates grow with the group, not with its square, and no plan holds a table as text."""
    pairs, plans = {}, []
    kept = lines.saved

    def saved(df, name, *more):
        plans.append(len(df._jdf.queryExecution().toString()))
        out = kept(df, name, *more)
        if name in ("line-pairs-likely", "line-pairs"):
            pairs[name] = pairs.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "saved", saved)
    common = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join([*common, f"own{k % 40}"])) for k in range(300)] + [(300 + k, f"own{k} own{k + 1}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in dedup_lines(docs).collect() if r.text}
    assert got == {0, *range(300, 340)} and 0 < sum(pairs.values()) < 200  # the group has 40 sets, 780 pairs of them
    assert max(plans) < 200_000
