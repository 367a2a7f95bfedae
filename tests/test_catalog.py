"""Every catalog query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__
from check import compare, duck
from docloom.catalog import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"bpe_learn", "train_multilabel", "train_multilabel_joint", "predict_multilabel"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 48 and set(rows[0].asDict()) == {"split", "label", "n_docs"}


def test_every_query_but_the_iterative_ones_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None
