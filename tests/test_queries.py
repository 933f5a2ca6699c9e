"""Every registered query has rows to show on the given tables."""

import os

import pytest

from nocturne import queries
from tests.oracle import connect

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_no_twin_is_empty():
    con = connect(FOLDER)
    empty = [name for name, sql in queries.ORACLES.items() if not con.sql(sql).limit(1).fetchall()]
    assert empty == []


def test_queries_without_a_twin_are_fits():
    """Only iterated fits have no SQL."""
    assert {*queries.QUERIES} - {*queries.ORACLES} == {
        "binomial_glm_with_weight_errors", "intake_mixed_model", "intake_mixed_model_of_females",
        "intake_mixed_grid", "intake_mixed_trends", "intake_cohort_effects"}
