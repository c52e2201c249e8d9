import numpy as np
import pytest
from conftest import DATA

from tandemetry.functions import kernels
from tandemetry.plans import catalog, extras  # noqa: F401  extras adds to the queries of the catalog


@pytest.mark.parametrize("name", ["joint_motion", "head_motion", "dyad_share"])
def test_cells_are_shuffled_once(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" in plan


def test_entropy_over_several_blocks():
    x = np.round(np.random.default_rng(0).normal(size=600), 1)
    r = 0.2 * x.std()
    near = []
    for m in (2, 3):
        t = np.lib.stride_tricks.sliding_window_view(x, m)
        near.append(int(np.triu(np.abs(t[:, None] - t[None]).max(axis=2) <= r, 1).sum()))
    assert abs(kernels.sample_entropy(x) + np.log(near[1] / near[0])) < 1e-12
