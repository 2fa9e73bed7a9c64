from dataclasses import replace

import numpy as np
import pytest

from neurospan.operators import linear_fits as L
from neurospan.operators import ordered as O
from neurospan.operators import resampling as S
from neurospan.session import scratch_dir


def data(n=120, p=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.5 * rng.normal(size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(f"s{i:03d}", int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))],
                                 "subject_id string, y int, x array<double>")


def test_elastic_net_meets_its_optimality_conditions():
    x, y = data()
    for c, ratio in ((0.1, 0.5), (1.0, 0.1)):
        w = L.elastic_net(x, y, c, ratio, tol=1e-10, max_iter=50_000)
        design = np.hstack([x, np.ones((len(x), 1))])
        sign = np.where(y > 0, 1.0, -1.0)
        grad = -c * design.T @ (sign / (1 + np.exp(sign * (design @ w))))
        grad[:-1] += (1 - ratio) * w[:-1]
        assert abs(grad[-1]) < 1e-5
        for g, v in zip(grad[:-1], w[:-1]):
            assert abs(g + ratio * np.sign(v)) < 1e-5 if v else abs(g) <= ratio + 1e-5


def test_elastic_net_equals_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x, y = data(80, 4)
    c, ratio = 0.5, 0.3
    df = frame(spark, x, y).withColumn("v", array_to_vector("x"))
    ml = LogisticRegression(featuresCol="v", labelCol="y", regParam=1 / (c * len(x)), elasticNetParam=ratio,
                            standardization=False, maxIter=1000, tol=1e-12).fit(df)
    w = L.elastic_net(x, y, c, ratio, tol=1e-12, max_iter=50_000)
    assert np.allclose(w[:-1], ml.coefficients.toArray(), atol=1e-4)
    assert w[-1] == pytest.approx(ml.intercept, abs=1e-4)


def test_svm_gradient_vanishes():
    x, y = data()
    for c in (1e-3, 1.0, 100.0):
        w = L.linear_svm(x, y, c)
        design = np.hstack([x, np.ones((len(x), 1))])
        sign = np.where(y > 0, 1.0, -1.0)
        gap = np.maximum(1 - sign * (design @ w), 0)
        assert np.abs(w - 2 * c * design.T @ (sign * gap)).max() < 1e-5 * max(1, c)


PLAN = S.Plan("elastic_net", c_grid=(0.01, 0.1, 1.0), l1_grid=(0.1, 0.5), outer=4, inner=3, importance_repeats=4)


def test_nested_cv(spark):
    x, y = data()
    features = frame(spark, x, y)
    res = S.nested_cv(spark, features, PLAN)
    oof = {r["subject_id"]: r["score"] for r in res.oof.collect()}
    assert len(oof) == len(y)
    assert res.observed_auc.first()["auc"] > 0.85
    imp = {r["feature"]: r["perm_importance_mean"] for r in res.features.collect()}
    assert len(imp) == 6 and max(imp, key=imp.get) == 0
    again = S.nested_cv(spark, features.repartition(5), PLAN)
    assert {r["subject_id"]: r["score"] for r in again.oof.collect()} == pytest.approx(oof)


def test_every_subject_is_scored_beyond_the_fit_sample(spark):
    """The bound limits what models are fitted on, nothing else."""
    x, y = data(200, 4)
    features = frame(spark, x, y)
    plan = S.Plan("elastic_net", c_grid=(0.1,), l1_grid=(0.5,), outer=2, inner=2, importance_repeats=2)
    whole, part = S.nested_cv(spark, features, plan), S.nested_cv(spark, features, replace(plan, fit_rows=100))
    a = {r["subject_id"]: r["score"] for r in whole.oof.collect()}
    b = {r["subject_id"]: r["score"] for r in part.oof.collect()}
    assert a.keys() == b.keys() and len(a) == 200
    assert a != b and np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.9


def test_shuffle_partitions_do_not_matter(spark):
    x, y = data(80, 4)
    plan = S.Plan("linear_svm", c_grid=(0.01, 0.1), outer=3, inner=2, importance_repeats=2)
    out, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append({r["subject_id"]: r["score"] for r in S.nested_cv(spark, frame(spark, x, y), plan).oof.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == pytest.approx(out[1], abs=1e-9)


def test_folds_and_shuffles_are_those_of_spark(spark):
    x, y = data(50, 2)
    rows = frame(spark, x, y).select("subject_id", "y")
    got = O.stratified_folds(rows, "subject_id", "y", 4, 7 + 1 + 2).orderBy("subject_id").toPandas()
    uid, own = got["subject_id"].astype(str).to_numpy(), got["y"].to_numpy().astype(int)
    assert (S._inner_folds(uid, own, 4, 7, 2) == got["fold"].to_numpy()).all()
    shuffled = S._labels({"uid": uid, "y": own}, 3, 7)
    assert sorted(shuffled) == sorted(own) and (shuffled != own).any()


def test_class_checks(spark):
    x, y = data(20)
    with pytest.raises(ValueError, match="per class"):
        S.nested_cv(spark, frame(spark, x, np.zeros(20, int)), PLAN)
    with pytest.raises(ValueError, match="0 or 1"):
        S.nested_cv(spark, frame(spark, x, np.full(20, 2)), PLAN)


def test_null_resumes_and_refuses_other_data(spark):
    x, y = data(60, 3)
    features = frame(spark, x, y)
    plan = S.Plan("linear_svm", c_grid=(0.01,), outer=3, inner=2)
    path = scratch_dir(spark, "test-null")
    S.resumable_null(spark, features, plan, 2.0, path, n_perm=2, batch=2)
    first = {r["perm_id"]: r["auc"] for r in spark.read.parquet(path).collect()}
    S.resumable_null(spark, features, plan, 2.0, path, n_perm=4, batch=3)
    all_rows = {r["perm_id"]: r["auc"] for r in spark.read.parquet(path).collect()}
    assert sorted(all_rows) == [1, 2, 3, 4] and all(all_rows[k] == first[k] for k in first)
    straight = {r["perm_id"]: r["auc"] for r in S.permutation_aucs(
        spark, features, plan, spark.range(1, 5).withColumnRenamed("id", "perm_id")).collect()}
    assert straight == pytest.approx(all_rows)
    with pytest.raises(ValueError, match="different data"):
        S.resumable_null(spark, frame(spark, x + 1, y), plan, 2.0, path, n_perm=4)
    # stopping: every null reaches an observed AUC of 0
    stop_path = scratch_dir(spark, "test-stop")
    S.resumable_null(spark, features, plan, 0.0, stop_path, n_perm=8, batch=2, stop=2)
    assert spark.read.parquet(stop_path).count() == 2


def test_grid_order(spark):
    rows = S.parameter_grid(spark, S.Plan()).orderBy("candidate").collect()
    assert len(rows) == 40 and rows[0]["c"] == pytest.approx(1e-4) and rows[-1]["c"] == pytest.approx(1e3)
    assert S.parameter_grid(spark, S.Plan("linear_svm")).count() == 10


def test_null_batches_share_folds_and_sample(spark, monkeypatch):
    """Folds and the fit sample are made once for all batches, and a training set's folds are read from the shared order."""
    rng = np.random.default_rng(4)
    rows = [(f"s{k}", k % 2, [float(v) for v in rng.normal(size=3)]) for k in range(40)]
    features = spark.createDataFrame(rows, "subject_id string, y int, x array<double>")
    plan = S.Plan("linear_svm", c_grid=(0.01, 1.0), outer=3, inner=2)
    made, ship = [], S._ship
    monkeypatch.setattr(S, "_ship", lambda *a: made.append(1) or ship(*a))
    path = scratch_dir(spark, "t-null")
    S.resumable_null(spark, features, plan, 2.0, path, n_perm=4, batch=2)
    assert len(made) == 1

    data = ship(S.with_outer_folds(features, plan), plan, "subject_id").value
    for outer in range(plan.outer):
        train = data["outer"] != outer
        y = S._labels(data, 5, plan.seed)[train]
        assert (S._train_folds(data, train, y, plan, outer) == S._inner_folds(data["uid"][train], y, plan.inner, plan.seed, outer)).all()
    assert (S._labels(data, 5, plan.seed) == S._labels({"uid": data["uid"], "y": data["y"]}, 5, plan.seed)).all()


@pytest.mark.parametrize("c", [1e-4, 1e-2, 1.0, 1000.0])
def test_svm_with_a_shared_gram_matrix(c):
    """With most points inside the margin the shared Gram matrix is used; the gradient vanishes at the result."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 2, 400)
    shared = L.with_ones(x)
    w = L.linear_svm(x, y, c, shared=shared)
    assert np.abs(w - L.linear_svm(x, y, c)).max() < 1e-9
    design, sign = shared[0], np.where(y > 0, 1.0, -1.0)
    gap = np.maximum(1.0 - sign * (design @ w), 0.0)
    assert (gap > 0).mean() > 0.5
    assert np.abs(w - 2 * c * (design.T @ (sign * gap))).max() < 1e-8 * max(1.0, c)


def test_models_are_fitted_on_every_labelled_subject(spark):
    """Beyond 20,000 labelled subjects, too: all are sent to the tasks that fit and tune."""
    n = 20_400
    features = spark.range(n).selectExpr(
        "cast(id as string) AS subject_id", "cast(id % 2 as int) AS y", "array(cast(id % 7 as double), cast(id % 11 as double)) AS x"
    )
    for model in ("linear_svm", "elastic_net"):
        plan = S.Plan(model)
        data = S._ship(S.with_outer_folds(features, plan), plan, "subject_id").value
        assert len(set(data["uid"])) == len(data["y"]) == len(data["x"]) == n
        assert np.bincount(data["outer"]).tolist() == [n // plan.outer] * plan.outer


def _path(x, y, cs, rows=None):
    """``svm_path`` from the sums over [x, 1], as the tasks call it."""
    design, sign = np.hstack([x, np.ones((len(x), 1))]), np.where(y > 0, 1.0, -1.0)
    back, gram, target, _ = L.scaled_sums(design.T @ design, sign @ design, np.ptp(x, axis=0) == 0)
    radius = np.linalg.norm(x, axis=1).max()
    return L.svm_path(gram, target, np.array(cs), back, radius, rows or (lambda: (design, sign)))


@pytest.mark.parametrize("kind", ["noise", "predictive", "few", "one class", "constant"])
def test_svm_from_sums_is_the_svm(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * [1, 2, 0.5, 1, 1, 1]
    y = rng.integers(0, 2, 500)
    if kind == "predictive":
        y = (x[:, 0] + 0.1 * rng.normal(size=500) > 0).astype(int)
    elif kind == "few":
        y = (rng.random(500) < 0.03).astype(int)
    elif kind == "one class":
        y[:] = 1
    elif kind == "constant":
        x[:, 2] = 0.0
    cs = S.Plan().c_grid
    mean, sd = L.scale_fit(x)
    got = _path(x, y, cs)
    for c, w in zip(cs, got):
        assert np.abs(w - L.linear_svm((x - mean) / sd, y, c)).max() < 1e-7


def test_svm_needs_no_rows_where_none_can_leave_the_margin():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(5000, 4)), rng.integers(0, 2, 5000)

    def rows():
        raise AssertionError("the sums are enough")

    mean, sd = L.scale_fit(x)
    for c, w in zip((1e-4, 1.0, 1e3), _path(x, y, (1e-4, 1.0, 1e3), rows)):
        assert np.abs(w - L.linear_svm((x - mean) / sd, y, c)).max() < 1e-7


def _shipped(spark, x, y, plan):
    features = frame(spark, x, y)
    folded = S.with_outer_folds(features, plan)
    return folded, S._ship(folded, plan, "subject_id")


@pytest.mark.parametrize("kind", ["noise", "predictive", "rare"])
def test_svm_scores_and_refits_equal_fits_on_rows(spark, kind):
    """Sums of the inner folds give the AUCs and weights that fits on the scaled rows of each training set give."""
    rng = np.random.default_rng(8)
    x, y = data(150, 5) if kind == "predictive" else (rng.normal(size=(150, 5)), rng.integers(0, 2, 150))
    x = x * 50 + 1000
    if kind == "rare":
        x[:, 1], x[:, 2] = 0.1, 0.0
        x[7, 2] = 1.0  # the same for all subjects but one, so in some training sets it does not vary
    plan = S.Plan("linear_svm", c_grid=(1e-4, 0.1, 100.0), outer=3, inner=4)
    own = frame(spark, x, y).orderBy("subject_id").toPandas()
    raw = np.stack(own["x"].to_numpy())
    raw[:, 1] = 0.0 if kind == "rare" else raw[:, 1]  # a constant adds nothing
    _, shared = _shipped(spark, x, y, plan)
    got = shared.value
    for perm in (S.OBSERVED, 3):
        labels = S._labels(got, perm, plan.seed)
        for outer in range(plan.outer):
            train = got["outer"] != outer
            folds = S._train_folds(got, train, labels[train], plan, outer)
            for inner, aucs in S._svm_scores(got, labels, plan, outer):
                hold = folds == inner
                assert (np.flatnonzero(train)[hold] == S._hold_rows(got, labels, plan, outer)[inner]).all()
                fit_x, val_x = S._scaled(raw[train][~hold], raw[train][hold])
                for c, score in zip(sorted(plan.c_grid), aucs):
                    w = L.linear_svm(fit_x, labels[train][~hold], c)
                    assert score == pytest.approx(L.rank_auc(labels[train][hold], S._margin(val_x, w))[0], abs=1e-12)
            mean, sd = L.scale_fit(raw[train])
            want = L.linear_svm((raw[train] - mean) / sd, labels[train], 0.1)
            coef, weights, intercept = S._svm_refit(got, labels, outer, 0.1)
            assert np.allclose(coef, want[:-1], atol=1e-7)
            assert np.allclose(raw @ weights + intercept, (raw - mean) / sd @ want[:-1] + want[-1], atol=1e-7)


@pytest.mark.parametrize("model", ["linear_svm", "elastic_net"])
@pytest.mark.parametrize("fit_rows", [None, 60])
def test_null_aucs_are_those_of_the_out_of_fold_scores(spark, model, fit_rows):
    """Scored in the tasks or as rows: every subject counts, also those that a bounded fit leaves out; rows that come twice tie."""
    from neurospan.operators.discrimination import auc

    x, y = data(120, 3)
    x, y = np.vstack([x, x[:9]]), np.append(y, y[:9])
    plan = S.Plan(model, c_grid=(0.01, 1.0), l1_grid=(0.1,), outer=3, inner=2, fit_rows=fit_rows)
    folded, shared = _shipped(spark, x, y, plan)
    perms = spark.range(0, 4).withColumnRenamed("id", "perm_id")
    best = S.best_candidates(S.grid_search(spark, shared, perms, plan), S.parameter_grid(spark, plan))
    models = S.materialise(S.refit(spark, shared, best, plan), scratch_dir(spark, "t-models"))
    got = {r["perm_id"]: r["auc"] for r in S.null_aucs(shared, models, plan).collect()}
    want = {r["perm_id"]: r["auc"] for r in auc(S.out_of_fold(folded, models, plan, "subject_id"), keys=("perm_id",)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got == pytest.approx(want, abs=1e-12)


def test_md5_orders_are_those_of_sorted_digests():
    import hashlib

    uid = np.array([f"s{k % 40}" for k in range(60)], dtype=object)  # some ids come twice
    digests = [hashlib.md5(f"{u}:7:1".encode()).hexdigest() for u in uid]
    assert S._md5_order(uid, "7:1").tolist() == sorted(range(60), key=lambda k: (digests[k], uid[k]))


def test_rank_auc_with_and_without_ties():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 60)
    scores = np.column_stack([rng.normal(size=60), rng.integers(0, 5, 60), np.zeros(60)])
    for k, got in enumerate(L.rank_auc(y, scores)):
        a, b = scores[y == 1, k], scores[y == 0, k]
        assert got == pytest.approx(np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b)), abs=1e-12)


def test_null_is_stored_batch_by_batch(spark, monkeypatch):
    """A batch that cannot be stored ends the run, and the batches before it stay."""
    from neurospan.streaming import incremental as inc

    x, y = data(60, 3)
    plan = S.Plan("linear_svm", c_grid=(0.01,), outer=3, inner=2)
    path, append = scratch_dir(spark, "t-stored"), inc.append_new

    def second_fails(new, *rest):
        if new.where("perm_id = 3").count():
            raise OSError("no space")
        append(new, *rest)

    monkeypatch.setattr(inc, "append_new", second_fails)
    with pytest.raises(OSError, match="no space"):
        S.resumable_null(spark, frame(spark, x, y), plan, 2.0, path, n_perm=8, batch=2)
    assert sorted(r["perm_id"] for r in spark.read.parquet(path).collect()) == [1, 2]
