"""The inverted multi-index on tables of a few vectors."""

from __future__ import annotations

import numpy as np
import pytest

from cohortgraph.llm.embeddings import THRESHOLD, MultiIndex, links, unit


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20, 35, 64, 200, 500])
def test_every_vector_visits_its_own_cell(n):
    for seed in range(25):
        x = unit(np.random.default_rng(seed).standard_normal((n, 64)))
        own, visits = MultiIndex(x, n, THRESHOLD, 0.995).cells(x)
        assert [v[0] for v in visits] == own.tolist()
        assert all(len(set(v)) == len(v) for v in visits)


def test_equal_vectors():
    x = np.repeat(unit(np.random.default_rng(1).standard_normal((1, 8))), 30, axis=0)
    own, visits = MultiIndex(x, 30, THRESHOLD, 0.995).cells(x)
    assert all(o in v for o, v in zip(own.tolist(), visits))


@pytest.mark.parametrize("n", [2, 20, 200])
def test_small_tables_with_links(spark, n):
    rng = np.random.default_rng(n)
    base = unit(rng.standard_normal((max(1, n // 4), 64)))
    x = base[rng.integers(0, len(base), n)] + 0.02 * rng.standard_normal((n, 64))
    near = unit(x) @ unit(x).T >= THRESHOLD
    assert near.sum() > n
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in links(spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    least, reach = np.arange(n), near.copy()
    for _ in range(n):
        new = np.array([least[r].min() for r in reach])
        if (new == least).all():
            break
        least = new
    assert got == {i: (int(near[i].sum()) - 1, int(least[i])) for i in range(n)}
