import numpy as np
import pytest

from neurospan.operators import discrimination as D
from neurospan.operators.linear_fits import rank_auc


def brute(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    c = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    se = np.sqrt(c.mean(1).var(ddof=1) / len(c) + c.mean(0).var(ddof=1) / c.shape[1])
    return c.mean(), se


def frame(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")


@pytest.mark.parametrize("seed, ties", [(1, 3), (2, 50), (3, 1)])
def test_auc_and_delong_with_ties(spark, seed, ties):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 120)
    s = rng.integers(0, ties, 120) + 0.3 * y * (ties > 1)
    want, se = brute(y, s)
    df = frame(spark, y, s)
    assert D.auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    row = D.delong(df).first()
    assert row["se"] == pytest.approx(se, abs=1e-10)
    assert row["ci_high"] - row["auc"] == pytest.approx(1.959963984540054 * se, abs=1e-9)
    assert D.auc(frame(spark, y, -s)).first()["auc"] == pytest.approx(1 - want, abs=1e-12)
    assert rank_auc(y, s)[0] == pytest.approx(want, abs=1e-12)


def test_single_class_is_null(spark):
    assert D.auc(frame(spark, [1, 1], [0.1, 0.2])).first()["auc"] is None


@pytest.mark.parametrize("aucs, stop, used, p", [
    ([0.9, 0.1, 0.9, 0.9], 3, 4, 3 / 4),  # the last draw is the h-th exceedance
    ([0.9, 0.9, 0.1, 0.1], 2, 2, 1.0),
    ([0.9, 0.1, 0.1], 2, 3, 2 / 4),  # never reached: (b + 1) / (n + 1)
    ([0.1, 0.1], 5, 2, 1 / 3),
])
def test_sequential_p(spark, aucs, stop, used, p):
    null = spark.createDataFrame([("r", i + 1, a) for i, a in enumerate(aucs)], "run_id string, perm_id int, auc double")
    obs = spark.createDataFrame([("r", 0.5)], "run_id string, observed_auc double")
    row = D.permutation_p(null, obs, stop).first()
    assert row["n_perm_used"] == used and row["p_value"] == pytest.approx(p)
