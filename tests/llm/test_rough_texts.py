"""The text queries on empty tables and on tables full of nulls."""

import os

import pytest

from rough import emptied, roughened
from timbrel.llm import catalogue, tokenizers

SF = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p1_pieces", "p2_token_budget", "p4_classes", "p4_found", "p6_collapsed", "p6_near", "p7_found", "p7_turns", "p8_windows", "p9_found", "p9_leaks", "p10_levels"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    if not os.path.isdir(SF) or not os.path.isdir(tokenizers.FOLDER):
        pytest.skip("no test tables here")
    return emptied(spark, SF, str(tmp_path_factory.mktemp("empty"))), roughened(spark, SF, str(tmp_path_factory.mktemp("rough")))


@pytest.mark.parametrize("name", NAMES)
def test_rough_tables(spark, tables, name):
    query = catalogue.queries()[name]
    assert query(spark, tables[0]).collect() == []
    query(spark, tables[1]).collect()
