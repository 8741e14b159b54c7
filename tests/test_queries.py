"""Every registered query against its SQL (SITTINGS_SF_DIR picks the scale)."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences
from conftest import ROOT  # noqa: F401  (puts the repository on the path)

import __spark_entry__ as entry

SF_DIR = os.environ.get("SITTINGS_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()


def test_sql_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "artist_name", "track_name", "play_count"]
