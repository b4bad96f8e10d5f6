"""Queries of the operators for training data against their SQL, on the smallest tables."""

import os

import pytest
from compare import compare, connect

from notegraph.llm import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(D)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    said, good = compare(spark, duck, name, catalog.queries()[name], catalog.oracles().get(name), D)
    assert good, said
