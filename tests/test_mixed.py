import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurospan.operators import mixed as M


def simulate(seed, n=60, tau=0.8, visits=(1, 2, 3)):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        b, g = rng.normal(0, tau), s % 2
        for t in range(visits[s % len(visits)]):
            rows.append((s, float(g), float(t), 1.0 + 0.5 * g - 0.2 * t + b + rng.normal()))
    return rows


def dense_deviance(rows, theta, fixed=None):
    """Likelihood from the full covariance matrix."""
    ids = np.array([r[0] for r in rows])
    x = np.array([[1.0, r[1], r[2]] for r in rows])
    y = np.array([r[3] for r in rows])
    v = np.eye(len(y)) + theta * (ids[:, None] == ids)
    vi = np.linalg.inv(v)
    if fixed is not None:
        y = y - x[:, fixed[0]] * fixed[1]
        x = np.delete(x, fixed[0], axis=1)
    beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
    r = y - x @ beta
    s2 = r @ vi @ r / len(y)
    return np.linalg.slogdet(v)[1] + len(y) * (math.log(s2) + 1 + math.log(2 * math.pi)), beta, s2


def fit(spark, rows):
    df = spark.createDataFrame(rows, "id int, g double, t double, y double")
    spec = M.Spec("m", F.col("y"), {"g": F.col("g"), "t": F.col("t")}, "g")
    return M.fit_models(spark, df, "id", [spec]).first()


@pytest.mark.parametrize("seed, tau", [(1, 0.8), (2, 2.0), (3, 0.0)])
def test_against_dense_likelihood(spark, seed, tau):
    rows = simulate(seed, tau=tau)
    got = fit(spark, rows)
    theta = got["tau2"] / got["sigma2"]
    dev, beta, s2 = dense_deviance(rows, theta)
    assert got["deviance"] == pytest.approx(dev, abs=1e-8)
    assert got["coef"] == pytest.approx(beta[1], abs=1e-8)
    assert got["sigma2"] == pytest.approx(s2, rel=1e-8)
    for other in (theta * 0.8, theta * 1.25, theta + 0.05, 0.0):
        assert dense_deviance(rows, other)[0] >= dev - 1e-7
    for limit in (got["ci_lo"], got["ci_hi"]):
        best = min(dense_deviance(rows, th, (1, limit))[0] for th in np.geomspace(max(theta, 0.01) / 20, max(theta, 0.01) * 20, 150).tolist() + [0.0])
        assert best - dev == pytest.approx(M.CHI2_95, abs=5e-3)
    assert got["ci_lo"] < got["coef"] < got["ci_hi"]
    assert 0 <= got["marginal_r2"] <= got["conditional_r2"] <= 1


def test_balanced_design_has_the_exact_between_subject_df(spark):
    """With equal visits a between-subject effect is a comparison of subject means: df is n under ML."""
    rows = simulate(5, n=40, tau=1.5, visits=(2,))
    got = fit(spark, rows)
    assert got["df"] == pytest.approx(40, rel=0.02)


def test_nulls_drop_per_model(spark):
    rows = simulate(4, n=20)
    df = spark.createDataFrame(rows, "id int, g double, t double, y double").withColumn(
        "t2", F.when(F.col("t") < 2, F.col("t"))
    )
    specs = [
        M.Spec("all", F.col("y"), {"g": F.col("g"), "t": F.col("t")}, "g"),
        M.Spec("some", F.col("y"), {"g": F.col("g"), "t": F.col("t2")}, "g"),
    ]
    got = {r["model"]: r["n_obs"] for r in M.fit_models(spark, df, "id", specs).collect()}
    assert got == {"all": len(rows), "some": sum(1 for r in rows if r[2] < 2)}


def test_battery_families(spark):
    rng = np.random.default_rng(0)
    nets = {n: f"sfc_{n}" for n in M.FDR_FAMILIES}
    rows = []
    for s in range(40):
        for v in range(2):
            rows.append((s, s % 2, float(v), 60.0 + s % 7, "male" if s % 3 else "female", 8.0 + s % 5,
                         float(rng.normal()), *[float(x) for x in rng.normal(size=6)]))
    cols = "id int, flag int, time double, age_1 double, sex string, YoE double, memory double, " + ", ".join(f"{c} double" for c in nets.values())
    out = M.fit_battery(spark, spark.createDataFrame(rows, cols), "id", {"200": nets, "400": nets}).collect()
    assert len(out) == 48 and {r["atlas"] for r in out} == {"200", "400"}
    for r in out:
        assert r["p_value"] <= r["p_fdr"] + 1e-12 <= 1.0 + 1e-9


def test_totals_of_long_and_null_subjects_over_batches(spark):
    """Subjects that span Arrow batches, a missing id and unknown values give the totals of a plain grouping."""
    rng = np.random.default_rng(8)
    rows = [(s, float(s % 2), float(t), float(rng.integers(0, 9))) for s in range(6) for t in range(1 + s * 5)]
    rows += [(None, 1.0, float(t), None if t == 2 else 3.0) for t in range(9)]
    df = spark.createDataFrame(rows, "id int, g double, t double, y double")
    specs = [
        M.Spec("two", F.col("y"), {"g": F.col("g"), "t": F.col("t")}, "g"),
        M.Spec("one", F.col("t"), {"g": F.col("g")}, "g"),
    ]
    want = {}
    for name, cells in (("two", lambda r: [1.0, r[1], r[2], r[3]]), ("one", lambda r: [1.0, r[1], 0.0, r[2]])):
        for subject in {r[0] for r in rows}:
            z = np.array([cells(r) for r in rows if r[0] == subject and None not in cells(r)])
            m, gram, products = want.get((name, len(z)), (0, 0, 0))
            want[name, len(z)] = m + 1, gram + z.T @ z, products + np.outer(z.sum(axis=0), z.sum(axis=0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r["model"], r["n"]): r for r in M.cluster_totals(df, "id", specs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    for key, (m, gram, products) in want.items():
        assert got[key]["m"] == m
        for a in range(4):
            for b in range(a, 4):
                assert got[key][f"g{a}_{b}"] == gram[a, b] and got[key][f"p{a}_{b}"] == products[a, b]


def test_models_are_not_dealt_out_with_their_visits(spark):
    """What is shuffled by subject are the visits, not a row of sums for each subject and model."""
    rows = simulate(6, n=400)
    df = spark.createDataFrame(rows, "id int, g double, t double, y double")
    group, time, y = F.col("g"), F.col("t"), F.col("y")

    def exchanges(models):
        specs = [M.Spec(f"m{k}", y, {"g": group, "t": time}, "g") for k in range(models)]
        plan = M.cluster_totals(df, "id", specs)._jdf.queryExecution().executedPlan().toString()
        return [line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]

    assert exchanges(1) == exchanges(9) == ["model", "id"]
