import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurospan.functions.aggregates import safe_corr
from neurospan.operators import connectivity as N
from neurospan.operators import rollup as R

SCHEMA = "subject_id string, ses string, frame bigint, signal array<double>"


def edges_in_row(series, keys=("subject_id", "ses"), signal="signal"):
    """Same correlations without Python: every frame emits its pairs and Spark aggregates them.

    Costs frames x p(p-1)/2 rows, so it is the cross-check and the choice for few regions.
    """
    # Plain posexplode twice would join; emit the pairs from inside the row instead.
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(signal) - 2),
            lambda a: F.transform(
                F.sequence(a + 1, F.size(signal) - 1),
                lambda b: F.struct(
                    a.alias("i"), b.alias("j"), F.get(signal, a).alias("x"), F.get(signal, b).alias("y")
                ),
            ),
        )
    )
    return (
        series.select(*keys, F.inline(pairs))
        .groupBy(*keys, "i", "j")
        .agg(N.unit(safe_corr("x", "y")).alias("r"))
        .withColumn("z", N.fisher_z(F.col("r")))
    )


def series(spark, arrays, offset=0.0):
    rows = [
        (s, "ses-01", t, [float(v) + offset for v in row])
        for s, x in arrays.items() for t, row in enumerate(x)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ledoit_wolf(x):
    """From the definition: the mean squared distance of each frame's outer product to S."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (n * n * p), delta2)
    rho = beta2 / delta2
    c = (1 - rho) * s + rho * mu * np.eye(p)
    d = np.sqrt(np.diag(c))
    return rho, c / np.outer(d, d)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(6, 6))
    # one subject owns most frames and spans several frame blocks
    return {"hot": rng.normal(size=(1500, 6)) @ mix, "b": rng.normal(size=(40, 6)), "c": rng.normal(size=(25, 6)) @ mix}


@pytest.mark.parametrize("offset", [0.0, 1e4])
@pytest.mark.parametrize("clustered", [False, True])
def test_correlation_matches_numpy(spark, arrays, offset, clustered):
    got = N.functional_edges(series(spark, arrays, offset), clustered=clustered).collect()
    assert len(got) == 3 * 15
    for r in got:
        want = np.corrcoef(arrays[r["subject_id"]].T)[r["i"], r["j"]]
        assert r["r"] == pytest.approx(want, abs=1e-9)
        assert r["z"] == pytest.approx(math.atanh(want), abs=1e-8)


def test_in_row_agrees_with_blocks(spark, arrays):
    df = series(spark, arrays)
    a = {(r["subject_id"], r["i"], r["j"]): r["r"] for r in N.functional_edges(df).collect()}
    b = {(r["subject_id"], r["i"], r["j"]): r["r"] for r in edges_in_row(df).collect()}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-12


@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_shrinkage_matches_definition(spark, arrays, offset):
    want = {s: ledoit_wolf(x) for s, x in arrays.items()}
    for r in N.functional_edges_shrunk(series(spark, arrays, offset)).collect():
        rho, corr = want[r["subject_id"]]
        assert r["rho"] == pytest.approx(rho, abs=1e-7)
        assert r["r"] == pytest.approx(corr[r["i"], r["j"]], abs=1e-7)


def test_constant_region_is_null(spark):
    x = np.random.default_rng(1).normal(size=(20, 3))
    x[:, 1] = 5.0
    got = {(r["i"], r["j"]): r["r"] for r in N.functional_edges(series(spark, {"a": x})).collect()}
    assert got[(0, 1)] is None and got[(1, 2)] is None and got[(0, 2)] is not None


def edges(spark, rows, name):
    return spark.createDataFrame([("s", "ses-01", i, j, float(w)) for i, j, w in rows], f"subject_id string, ses string, i int, j int, {name} double")


def test_coupling_rules(spark):
    """Zero edges on either side leave the profile; one shared partner gives NULL."""
    sc = edges(spark, [(0, 1, 1), (0, 2, 2), (0, 3, 4), (1, 2, 0), (1, 3, 5)], "weight")
    fc = edges(spark, [(0, 1, 0.1), (0, 2, 0.3), (0, 3, 0.2), (1, 2, 0.9), (1, 3, 0.0), (2, 3, 0.5)], "z")
    got = {r["roi"]: r for r in N.coupling(sc, fc).collect()}
    assert got[0]["n_partners"] == 3
    assert got[0]["rho"] == pytest.approx(np.corrcoef([1, 2, 4], [0.1, 0.3, 0.2])[0, 1])
    assert got[1]["n_partners"] == 1 and got[1]["rho"] is None
    scaled = N.coupling(sc.withColumn("weight", F.col("weight") * 7), fc).where("roi = 0").first()
    assert scaled["rho"] == pytest.approx(got[0]["rho"])


def test_structural_edges(spark):
    lines = spark.createDataFrame(
        [("s", "ses-01", a, b, w) for a, b, w in [(1, 2, 1.0), (2, 1, 2.0), (3, 3, 9.0), (1, 3, 4.0), (None, 2, 5.0)]],
        "subject_id string, ses string, node_a int, node_b int, weight double",
    )
    vol = spark.createDataFrame([("s", "ses-01", k, float(v)) for k, v in [(1, 2), (2, 4), (3, 6)]],
                                "subject_id string, ses string, node int, volume double")
    got = {(r["i"], r["j"]): r["weight"] for r in N.structural_edges(lines, vol).collect()}
    assert got == {(1, 2): pytest.approx(3.0 * 2 / 6), (1, 3): pytest.approx(4.0 * 2 / 8)}


def test_strength_counts_absent_edges_as_zero(spark):
    sc = edges(spark, [(0, 1, 6.0)], "weight")
    regions = spark.createDataFrame([(k,) for k in range(4)], "roi int")
    got = {r["roi"]: r["strength"] for r in N.node_strength(sc, regions).collect()}
    assert got == {0: 2.0, 1: 2.0, 2: 0.0, 3: 0.0}


def test_overlap_resolution(spark):
    """Two claims, three claims and a tie (the earlier slot wins)."""
    vox = (
        [(1, 0, 0, 0)] * 8 + [(0, 11, 0, 0)] * 2 + [(1, 11, 0, 0)] * 2  # 20 % of label 1, 50 % of label 11
        + [(2, 12, 0, 0)] * 3  # both labels lose all their voxels: tie
        + [(3, 13, 21, 0)] * 1 + [(3, 0, 0, 0)] * 3 + [(0, 13, 0, 0)] * 1 + [(0, 0, 21, 0)] * 9 + [(0, 0, 0, 0)] * 5
    )
    df = spark.createDataFrame([("s", "ses-01", *v) for v in vox], "subject_id string, ses string, a int, b int, c int, d int")
    slots = ["a", "b", "c", "d"]
    table = R.overlap_table(df, slots)
    got = {(r["a"], r["b"], r["c"]): r["label"] for r in table.where("n_claims > 1").collect()}
    assert got == {(1, 11, 0): 11, (2, 12, 0): 2, (3, 13, 21): 13}
    resolved = R.resolve_voxels(df, table, slots)
    assert resolved.count() == len(vox) and resolved.where("label = 0").count() == 5
    assert R.atlas_completeness(table, 6).first()["n_labels"] == 6
