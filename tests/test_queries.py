"""Every registered query agrees with its SQL check on whole tables."""

from __future__ import annotations

import os

import pytest

from casetable.drills import all_checks, all_queries
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(all_queries()) == set(all_checks())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, name, FOLDER)
    assert problem is None, problem
