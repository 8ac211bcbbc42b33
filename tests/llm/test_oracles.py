"""Text queries against their SQL, and the registry."""

import os

import pytest

import __spark_entry__
from compare import compare, connect
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
