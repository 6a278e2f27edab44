"""Running values with and without groups that are too large for one task."""

from __future__ import annotations

import pytest

from spanloom.operators import blocks
from spanloom.plans import catalog
from test_catalog import SF, duck, plain, pytestmark  # noqa: F401


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["greedy_gap_merge", "reads_over_cap", "split_pieces", "finish_sweep", "pack_requests", "coverage_holes", "partition_faults"])
def test_groups_of_any_size(spark, duck, name, monkeypatch):  # noqa: F811
    q = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    want = sorted(str([plain(dict(zip(names, r))[c]) for c in sorted(names)]) for r in q.fetchall())
    monkeypatch.setattr(blocks, "ROWS", 0)  # all groups go by blocks
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("name, most", [("greedy_gap_merge", 1), ("split_pieces", 1), ("reads_over_cap", 2), ("finish_sweep", 2)])
def test_small_groups_are_dealt_once(spark, name, most):
    assert shuffles(catalog.QUERIES[name](spark, SF)) <= most
