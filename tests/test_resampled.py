"""Replicates by hashes: digests against hashlib, and statements that leave replicates to kernels (their results are compared with the oracle in test_catalog)."""

import hashlib

import numpy as np
import pytest
from conftest import DATA

from tandemetry.functions.digests import Names
from tandemetry.plans import catalog, motion  # noqa: F401  motion adds to the queries of the catalog

DEALT = ["bootstrap_heterogeneity", "bootstrap_ci", "screen_spearman_bh", "half_stability", "null_threshold", "shifted_bootstrap_p", "lambda_permutation", "max_statistic"]


@pytest.mark.parametrize("name", DEALT)
def test_replicates_are_dealt_to_kernels(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert "md5" not in plan and ("MapInArrow" in plan or "Relation" in plan)


@pytest.mark.parametrize("n", [1, 7, 120, 20_000])
def test_digests_are_md5(n):
    items = np.unique(np.random.default_rng(n).integers(-50, 10**7, n))
    names, prefixes = Names(items), ["", "7:", "12:purchase:", "y" * 52]
    full = [[hashlib.md5(f"{p}{i}".encode()).hexdigest() for i in items] for p in prefixes]
    for want, got, draw, order in zip(full, names.each(prefixes), names.draws(prefixes), names.orders(prefixes, items), strict=True):
        assert ["".join(f"{v:08x}" for v in d) for d in got.T] == want
        assert draw.tolist() == [int(h[:8], 16) for h in want]
        assert order.tolist() == sorted(range(len(items)), key=lambda k: (want[k], items[k]))


def test_recurrence_shuffles_series_not_distances(spark):
    plan = catalog.QUERIES["cross_recurrence"](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "Window" not in plan
