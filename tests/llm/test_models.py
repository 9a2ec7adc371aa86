"""The n-gram models of LM scoring and quality rules against plain versions."""

import math
import random
import re
from collections import Counter

import pytest

from proofline.llm import ngrams, quality
from proofline.llm.common import of_ids
from proofline.llm.crossentropy import cross_entropy_difference
from proofline.llm.quality import kept_documents, quality_verdicts

DOCS = "doc_id long, text string, words string"


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def bigram_model(texts):
    """Interpolated modified Kneser-Ney, word by word; returns the probability of a word after another."""
    pairs = Counter((u, v) for words in texts for u, v in zip(["<s>", *words], words))
    before = Counter(v for _, v in pairs)
    d2, d1 = discounts(pairs.values()), discounts(before.values())
    total = sum(before.values())
    spread = sum(d1[min(c, 3) - 1] for c in before.values()) / total

    def single(v):
        share = (before[v] - d1[min(before[v], 3) - 1]) / total if before[v] else 0.0
        return share + spread / (len(before) + 1)

    def after(u, v):
        own = {w: c for (x, w), c in pairs.items() if x == u}
        if not own:
            return single(v)
        size = sum(own.values())
        freed = sum(d2[min(c, 3) - 1] for c in own.values()) / size
        share = (own[v] - d2[min(own[v], 3) - 1]) / size if v in own else 0.0
        return share + freed * single(v)

    return after


def loss(model, words):
    return sum(-math.log(model(u, v)) for u, v in zip(["<s>", *words], words)) / len(words) if words else None


@pytest.mark.parametrize("share", [0.0, 0.02])
def test_cross_entropy_against_plain_models(spark, share):
    rng = random.Random(5)
    vocabulary = [f"W{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randrange(1, 60))), "x") for k in range(60)]
    rows += [(60, None, "x"), (61, "", "x"), (62, " \t\n", "x"), (None, "w1 w2  W3\nw1", "x"), rows[4], rows[4]]
    target = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    cut = lambda text: (text or "").lower().split()
    counts = Counter(w for r in rows for w in cut(r[1]))
    known = {w for w, c in counts.items() if c >= share * sum(counts.values())}
    mapped = lambda r: [w if w in known else "<unk>" for w in cut(r[1])]
    models = [bigram_model([mapped(r) for r in part]) for part in (target, rows)]
    want = sorted(((r[0], len(mapped(r)), loss(models[0], mapped(r)), loss(models[1], mapped(r))) for r in rows), key=str)
    got = cross_entropy_difference(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(target, DOCS), word_share=share, least_share=0.0
    ).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in got), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        if w[1]:
            assert g[2:4] == pytest.approx(w[2:], rel=1e-6) and g[4] == pytest.approx(w[2] - w[3], abs=1e-6)
        else:
            assert g[2:] == (None, None, None)


def test_no_word_or_pair_is_dropped(spark):
    """By default, rare words and pairs count however many others there are."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"n{rng.randrange(60000)}" for _ in range(5000)), "x") for k in range(60)]
    rows += [(60, "seldom seen seldom heard", "x"), (61, "seldom seen seldom heard", "x")]
    target = rows[-2:] + rows[:3]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in cross_entropy_difference(docs, spark.createDataFrame(target, DOCS)).collect()}
    models = [bigram_model([r[1].split() for r in part]) for part in (target, rows)]
    for k in (60, 61):
        want = [loss(m, rows[k][1].split()) for m in models]
        assert [got[k].target_loss, got[k].background_loss] == pytest.approx(want, rel=1e-6)


def test_cross_entropy_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b a", "x")], DOCS)
    (row,) = cross_entropy_difference(docs, docs.limit(0)).collect()
    assert row.n_tokens == 3 and row.score > 0
    assert cross_entropy_difference(docs.limit(0), docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 10])
def test_rows_of_ids_are_the_same_by_either_join(spark, most):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, ""), (2, "b", ""), (None, "c", "")], DOCS)
    found = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.text or "") for r in of_ids(docs, found, "doc_id", most).collect()) == [(2, ""), (2, "b")]


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    text = text or ""
    words = cut(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if cut(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_base_rules_against_plain_counts(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "naïve", "x", "#", "50%", "a|b", "𝛼𝛽", "and", "river", "stone"] + [f"word{k}" for k in range(60)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 14))) for _ in range(40)]
    rows = [(k, rng.choice(("\n", "\n\n", "\r\n")).join(rng.choices(lines, k=rng.randrange(1, 25)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t\n"), (63, "a b c " * 5000), rows[0], rows[0], (None, "one two three")]
    rows = [(d, t, rng.choice(("en", "de", None)), "x") for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = quality_verdicts(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *[r[c] for c in names]) for r in got), key=str) == sorted(((d, *base(t)) for d, t, *_ in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_verdicts(docs.limit(0)).count() == 0


def test_character_model_of_a_small_language_beside_a_large_one(spark):
    """A language's losses do not change with the size of another, and symbol-rich texts are counted like any other."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(300)]
    small = [(k, " ".join(rng.choices(words, k=120)), "sm") for k in range(20)]
    table = [(100 + k, " | ".join(f"#{rng.randrange(99)} $ {rng.choice(words)} %" for _ in range(60)), "tab") for k in range(20)]
    large = [(1000 + k, " ".join("".join(rng.choices("nopqrstuvwxyz", k=6)) for _ in range(3000)), "lg") for k in range(120)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    losses = lambda rows: {r.doc_id: r.loss for r in quality_verdicts(docs(rows)).collect() if r.doc_id < 1000}
    alone, beside = losses(small + table), losses(small + table + large)
    assert alone.keys() == beside.keys() and all(beside[k] == pytest.approx(alone[k], rel=1e-9) for k in alone)
    # A language of symbols only has a model of its own, which knows its texts.
    assert all(0 < alone[100 + k] < math.log(100) for k in range(20)) and len({alone[100 + k] for k in range(20)}) == 20


def character_model(texts, order):
    """Interpolated modified Kneser-Ney over all orders, character by character; returns the mean loss of a text."""
    counts = {order: Counter(t[i : i + order] for t in ("\2" * (order - 1) + t for t in texts) for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    taken = {k: discounts(c.values()) for k, c in counts.items()}
    total, freed = Counter(), Counter()
    for k, found in counts.items():
        for g, c in found.items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += taken[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, c = len(g), counts[len(g)][g]
        return (c - taken[k][min(c, 3) - 1] + freed[k, g[:-1]] * p(g[1:])) / total[k, g[:-1]]

    def mean_loss(text):
        line = "\2" * (order - 1) + text
        return sum(-math.log(p(line[i : i + order])) for i in range(len(text))) / len(text)

    return mean_loss


def prose(rng, words, n):
    return "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(n))


@pytest.mark.parametrize("unit_bytes", [2_000, 1 << 25])
def test_character_losses_against_a_plain_model(spark, monkeypatch, unit_bytes):
    """Whatever the units and parts are, the losses are those of the whole tables of n-grams."""
    monkeypatch.setattr(quality, "WIDE_UNIT_BYTES", unit_bytes, raising=False)
    monkeypatch.setattr(ngrams, "PENDING", 300, raising=False)
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdeé𝛼 |", k=rng.randrange(1, 7))) for _ in range(80)]
    rows = [(k, prose(rng, words, rng.randrange(1, 9)), ("en", "de", None)[k % 3]) for k in range(60)]
    rows += [(60, None, "en"), (61, "", "xx"), (62, "\n \n", "de"), rows[5], rows[5]]
    got = sorted(((r.doc_id, r.loss) for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=str)
    models = {g: character_model([t.replace("\n", " ") for _, t, lang in rows if lang == g and t], 5) for g in ("en", "de", None)}
    want = sorted(((d, models[lang](t.replace("\n", " ")) if t else None) for d, t, lang in rows), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, g), (_, w) in zip(got, want):
        assert g == (None if w is None else pytest.approx(w, rel=1e-9))


@pytest.mark.parametrize("rules", [quality_verdicts, kept_documents])
def test_quality_rules_shuffle_less_than_their_texts(spark, monkeypatch, rules):
    """Texts and n-grams travel packed: what is shuffled in all, each text twice, stays under twice the size of the texts."""
    monkeypatch.setattr(quality, "WIDE_UNIT_BYTES", 2 << 20, raising=False)
    monkeypatch.setattr(ngrams, "UNIT_BYTES", 2 << 20)
    rng = random.Random(22)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(k, prose(rng, words, 50), "en") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).localCheckpoint()
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert rules(docs).count() == len(rows)
    assert written() - before < 2 * sum(len(r[1]) for r in rows)
