"""The stages one after another on the smallest tables: what each keeps, and that its decisions hold."""

import random

import corpus_pipeline
from proofline.llm.common import table
from proofline.llm.decontaminate import contaminated
from proofline.llm.simhash import near_duplicates

SMALL = "/root/testdata/sf0.001"


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    leaks = {r.doc_id for r in contaminated(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")).collect()}
    assert not leaks & {r.doc_id for r in rows}


def test_near_dedup_drops_only_near_duplicates(spark):
    """Rows of null or equal ids with texts of their own stay; of copies the smallest id stays, a null one last."""
    words = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north orbit plume quartz ridge slope tower".split()
    texts = [" ".join(random.Random(k).choices(words, k=120)) + f" only{k} {k * 7919} here{k}" for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[4]), (None, texts[3]),
            (9, texts[5]), (9, texts[5]), (None, texts[6]), (None, texts[6])]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars int")
    alone = {r.component_id for r in near_duplicates(docs.selectExpr("xxhash64(text) as doc_id", "text")).collect()}
    assert len(alone) == 7  # no two of the texts are near-duplicates of each other
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = [(None, 0), (None, 1), (7, 2), (7, 3), (3, 4), (9, 5), (None, 6)]
    assert sorted(((r.doc_id, texts.index(r.text)) for r in kept.collect()), key=str) == sorted(want, key=str)
