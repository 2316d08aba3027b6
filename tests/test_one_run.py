"""Queries that look at the lines once."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF


@pytest.mark.parametrize("name", ["approaches_pivot", "best_other", "histogram_error_rate", "relative_improvement"])
def test_lines_are_read_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 1
