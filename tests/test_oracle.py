"""Every query of the extraction against its DuckDB oracle on the whole sf0.01 driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from cohortgraph.plans.registry import QUERIES
from tests.conftest import SF001, SF01
from tests.oracle_check import compare


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF01, sorted(QUERIES))


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(results, name):
    r = results[name]
    assert r["columns_match"], r
    assert r["types_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["actor_id", "pr_id", "weight"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["star_sample", "actor_features", "pr_edges_with_repo", "graph_edges"])
def test_queries_match_oracle_at_sf001(spark, name):
    r = compare(spark, SF001, [name])[name]
    assert r["types_match"] and r["values_match"], r


def test_the_folder_name_does_not_matter(spark, tmp_path):
    other = str(tmp_path / "some_tables")
    os.symlink(SF001, other)
    for name in ("star_sample", "actor_nodes", "top_entities"):
        rows = [sorted(map(repr, E.queries()[name](spark, d).collect())) for d in (SF001, other)]
        assert rows[0] == rows[1], name
