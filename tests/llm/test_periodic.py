"""Runs by automaton and link-cut tree against all stretches of all periods, and op11 against its contract written plainly."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from proofline.llm.periodic import periodic_runs, runs_of, runs_of_texts, window
from proofline.llm.queries import op11_periodic_runs


def all_runs(words, least_words=6, least_exponent=4):
    """Every maximal stretch of every period that has no smaller period."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[start + j] == words[start + j + p] for j in range(length - p)) for p in range(1, q))
            if length >= max(least_words, least_exponent * q) and not smaller:
                found.add((start, length, q))
    return sorted(found)


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randrange(40))]
    if rng.random() < 0.6:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        words = words[: rng.randrange(len(words) + 1)] + (unit * 9)[: rng.randrange(40)] + words
    return words


@pytest.mark.parametrize(("least_words", "least_exponent"), [(6, 4), (2, 2), (5, 3), (1, 2), (9, 2)])
def test_random_words(least_words, least_exponent):
    rng, texts, expected = random.Random(least_words), [], []
    for _ in range(500):
        words = random_words(rng)
        expected.append(all_runs(words, least_words, least_exponent))
        assert runs_of(words, least_words, least_exponent) == expected[-1]
        texts.append(" \t".join(map(str, words)))
    sizes, found, collapsed = runs_of_texts(pa.array(texts), least_words, least_exponent)  # many texts together, with the stretches
    assert found == expected
    assert sum(map(len, expected)) > 50
    for text, size, runs, left in zip(texts, sizes, found, collapsed.to_pylist(), strict=True):
        gone = {i for start, length, q in runs for i in range(start + q, start + length)}
        words = text.split()
        assert size == len(words) and left == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_window_keeps_a_partner_for_every_part_of_a_run():
    for least_words in range(1, 20):
        for exponent in (2, 3, 4, 6):
            size = window(least_words, exponent)
            for q in range(1, 60):
                length = max(least_words, exponent * q)
                assert size == 1 or (length - size + 1) // q >= 2


def test_table(spark):
    docs = spark.createDataFrame(
        [(1, "a a a a a a"), (1, "a a a a a a"), (None, "x y\nx y x\ty x y z"), (2, None), (3, ""), (4, " \n"), (5, "a a a a a")],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "1 AS runs", "2 AS n_words", "3 AS collapsed", "4 AS start")
    rows = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=str)
    assert rows == sorted([
        (1, 6, [(0, 6, 1)], "a"), (1, 6, [(0, 6, 1)], "a"), (None, 9, [(0, 8, 2)], "x y z"), (2, 0, [], ""), (3, 0, [], ""),
        (4, 0, [], ""), (5, 5, [], "a a a a a"),
    ], key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_long_text():
    text = " ".join(["again and again"] * 60_000 + [str(i) for i in range(200_000)] + ["z"] * 7)
    sizes, found, collapsed = runs_of_texts(pa.array([text]), 6, 4)
    assert sizes[0] == 380_007 and found[0] == [(0, 180_000, 3), (380_000, 7, 1)]
    assert collapsed[0].as_py().endswith("199999 z")


def contract(doc_id, text):
    """One row of op11, as its contract says."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    codes = {w: k for k, w in enumerate(words)}
    runs = all_runs([codes[w] for w in words])
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(((-length, start, q) for start, length, q in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_on_a_small_table(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " "] + [" ".join(rng.choice(["no", "ñu", "yes", "a\u00a0b"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    rows = [(7 * k, t, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, words string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(contract(i, t) for i, t, _ in rows)
    assert sum(row[1] > 0 for row in got) > 20
