"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as registry
from compare import compare

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) == []


def test_every_query_but_training_has_sql():
    corpus = {n for n in QUERIES if n == "pipeline" or n[:2] == "op" and n.split("_")[0][2:].isdigit()}  # tested elsewhere
    assert set(QUERIES) - set(ORACLES) - corpus == {"train_score"}


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0
