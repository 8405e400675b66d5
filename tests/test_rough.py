"""Queries of the core on empty tables and on tables full of nulls."""

import os

import pytest

from rough import emptied, roughened
from timbrel.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["p3_found", "p3_coverage", "p3_periods", "p5_found", "p5_unique", "record_failures", "silver_validation", "chunk_verification", "target_inventory", "nearest_vectors"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return emptied(spark, SF, str(tmp_path_factory.mktemp("empty"))), roughened(spark, SF, str(tmp_path_factory.mktemp("rough")))


@pytest.mark.parametrize("name", NAMES)
def test_rough_tables(spark, tables, name):
    query = catalogue.queries()[name]
    assert len(query(spark, tables[0]).collect()) <= 1  # a report of one row, or nothing
    query(spark, tables[1]).collect()
