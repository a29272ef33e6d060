"""Every registered query against its oracle SQL (or, without one, for a non-empty result)."""

import os

import pytest
from compare import compare

from workload import catalogue

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
# Nothing in the smallest tables matches these.
MAY_BE_EMPTY = {"d04_sensitive", "u06_downgrades", "p01_decode_latin1"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_oracle(spark, con, name):
    message = compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLE[name], SF_DIR)
    assert message == "" or (message == "empty result" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
