"""Word pairs of many small units and parts, and what they take on disk."""

import random
from pathlib import Path

import pytest
from test_models import DOCS, bigram_model, loss

from proofline import session
from proofline.llm import common, wordpairs
from proofline.llm.crossentropy import cross_entropy_difference


def test_units_and_parts_change_nothing(spark, monkeypatch):
    """Pairs and words that many units share, with a target whose texts are not all among the documents."""
    monkeypatch.setattr(wordpairs, "CHUNK_BYTES", 150)
    monkeypatch.setattr(wordpairs, "UNIT_BYTES", 400)
    monkeypatch.setattr(wordpairs, "PART_PAIRS", 90)
    monkeypatch.setattr(wordpairs, "PART_WORDS", 40)
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(60)]
    made = lambda first, n: [(k, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 50))), "x") for k in range(first, first + n)]
    rows = [*made(0, 80), (None, None, "x"), (7, "w1 w1 w1", "x")]
    target = [*rows[:25], *made(900, 10), (1, "elsewhere alone", "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in cross_entropy_difference(docs, spark.createDataFrame(target, DOCS)).where("n_tokens <> 3").collect()}
    models = [bigram_model([(r[1] or "").split() for r in part]) for part in (target, rows)]
    for k, text, _ in rows[:80]:
        want = [loss(m, text.split()) for m in models]
        if want[0] is not None and len(text.split()) != 3:
            assert [got[k].target_loss, got[k].background_loss] == pytest.approx(want, rel=1e-9)


def test_pairs_take_little_disk(spark, monkeypatch):
    """Stored: under twice the size of the texts, of which nearly every pair is another. Shuffled in all: under four times."""
    monkeypatch.setattr(wordpairs, "UNIT_BYTES", 1 << 20)
    rng = random.Random(32)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(5000)]
    rows = [(k, " ".join(rng.choices(words, k=150)), "x") for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2).localCheckpoint()
    folders = []

    def scratch(spark, name):
        folders.append(session.scratch(spark, name))
        return folders[-1]

    monkeypatch.setattr(common, "scratch", scratch)
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert cross_entropy_difference(docs, docs.where("doc_id % 3 = 0")).count() == len(rows)
    size = sum(len(r[1]) for r in rows)
    stored = sum(f.stat().st_size for folder in folders for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())
    assert written() - before < 4 * size
    assert 0 < stored < 2 * size
