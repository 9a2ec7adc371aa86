"""Fenwick cuts against plain unit lists; op13 has SQL besides."""

import hashlib
import random
import re

import numpy as np
import pytest

from proofline.llm.infilling import Blocks, fill_in_middle, marks_of, restored
from pyspark.sql import functions as F


def plainly(doc_id, text, seed=1, percent_cut=90, percent_spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent_cut:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < percent_spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_every_cut(block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice("ab Zé漢😀1\n") for _ in range(rng.randrange(200)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        data = text.encode()
        blocks = Blocks(*marks_of(np.frombuffer(data, np.uint8)), block)
        assert (blocks.units, blocks.points) == (len(units), len(text))
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert blocks.cut(u) == (len(head.encode()), len(head))


@pytest.mark.parametrize("block", [5, 4096])
def test_table(spark, block):
    rng = random.Random(4)
    texts = [None, "", "a<P>b", "<M>", "<", "é", "word", "x " * 300_000, "漢" * 5000 + "tail<S"]
    texts += ["".join(rng.choice("ab Zé漢😀1\n<>PSM") for _ in range(rng.randrange(300))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id at all"), (-5, "negative id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS output", "2 AS n", "3 AS form")
    out = fill_in_middle(docs, block=block)
    assert sorted(map(tuple, out.collect()), key=str) == sorted((plainly(*r) for r in rows), key=str)
    forms = {r.form: r["count"] for r in out.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm", "spm"}
    back = out.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_parameters(spark):
    docs = spark.createDataFrame([(k, f"one two {k}") for k in range(50)], "doc_id long, text string")
    made = fill_in_middle(docs, seed=2, percent_cut=100, percent_spm=0)
    assert sorted(map(tuple, made.collect())) == sorted(plainly(k, f"one two {k}", 2, 100, 0) for k in range(50))
