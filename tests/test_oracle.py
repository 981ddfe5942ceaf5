"""Every registered query gives the rows of its SQL on the smallest tables."""

import os

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, n, _, note = compare(spark, SMALL, [name])[name]
    assert ok, note
    assert n > 0
    assert not note.startswith("types"), note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
