"""Every registered query with a SQL twin must return the same rows at the smallest scale."""

from __future__ import annotations

import pytest
from check_oracle import difference, oracle_connection
from ledger_cases import SMALL

import __spark_entry__ as registry

# The training-data operators, where installed, have their own tests.
TWINS = {name: twin for name, twin in registry.oracle_sql().items() if name not in registry.ADDED}
# At the smallest scale fixed K values would exceed the rows of a fold or sample; those run at the next scale.
QUERIES = {name: query for name, query in registry.queries().items() if name not in registry.ADDED}


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


def test_every_twin_has_a_query_and_only_models_lack_one():
    assert set(TWINS) <= set(QUERIES)
    without = {name for name in QUERIES if name not in TWINS}
    assert without == {"n1_logistic", "n2_ridge", "n3_lasso", "n4_boosted_trees", "n5_search", "h4_ablation",
                       "j3_tree_reasons", "h1_fitted_models", "h2_fitted_curves", "h3_fitted_selection", "i2_fitted_missed"}


def test_flagship_entry(spark):
    frame = registry.entry(spark)
    assert frame.count() == 1000 and len(frame.columns) == 21


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, connection, name):
    problem = difference(QUERIES[name](spark, SMALL), connection, TWINS[name])
    assert problem is None or problem.startswith("tiny"), problem
