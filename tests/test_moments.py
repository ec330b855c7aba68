"""Window moments against whole sums over all windows."""

import numpy as np
import pytest

from spanstat.operators.moments import window_moments
from spanstat.plans.queries import ORACLES, QUERIES
from tests.compare import oracle, spark_rows


@pytest.mark.parametrize("n", [2, 61, 200_000])
def test_window_moments(n):
    # Covered in its first part only: running sums grow far above any window's.
    cover = np.zeros(n, np.int64)
    cover[: 2 * n // 3 + 1] = np.random.default_rng(0).integers(0, 300, 2 * n // 3 + 1)
    lengths = sorted({l for l in (1, 5, 20, 45, 1000, n // 2, n // 2 + 1, n - 1) if 0 < l < n})
    mean, var = window_moments(cover / 100, lengths)
    total = np.r_[0, np.cumsum(cover)]
    for l, m, v in zip(lengths, mean, var):
        x = total[l:] - total[:-l]
        exact = ((x.astype(np.longdouble) - np.longdouble(x.sum()) / len(x)) ** 2).mean() / 10000
        assert m == pytest.approx(x.sum() / len(x) / 100, rel=1e-11), l
        assert v == pytest.approx(float(exact), rel=1e-9, abs=1e-12), l


def test_null_moments_at_more_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES["null_moments"](spark, sf)) == oracle(ORACLES["null_moments"], sf)
