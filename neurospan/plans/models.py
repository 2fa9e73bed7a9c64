"""Queries: mixed models, feature assembly, nested CV, permutation nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.operators import mixed as M
from neurospan.operators import resampling as S
from neurospan.operators import visits as V
from neurospan.plans import mixed_sql
from neurospan.plans.registry import query, r6, sql6
from neurospan.session import scratch_dir, table
from neurospan.sources.sinks import materialise

# --- mixed models: customers are subjects, their orders are visits --------------------

_NETWORKS = ("global", "hmod", "sensory", "dmn", "control", "salience")


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    people = table(spark, sf, "customer")
    long = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).alias("flag"),
        C.age_by_days(F.lit("1937-06-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age"),
        F.when(F.col("c_custkey") % 3 == 0, "male").otherwise("female").alias("sex"),
        (F.col("c_custkey") % 12 + 8).cast("double").alias("YoE"),
        F.when(F.col("o_orderkey") % 29 != 0, F.col("o_totalprice") / 1000).alias("memory"),
        *[
            ((F.col("o_totalprice") / (1000 + 300 * k)) % (90 + 20 * k) + F.col("c_acctbal") / (400 + 50 * k)).alias(f"sfc_{n}")
            for k, n in enumerate(_NETWORKS)
        ],
        *[
            ((F.col("o_totalprice") / (700 + 200 * k)) % (80 + 15 * k) + F.col("c_acctbal") / (500 + 40 * k)).alias(f"sfc400_{n}")
            for k, n in enumerate(_NETWORKS)
        ],
    )
    timed = V.since_first(long)
    return V.with_baseline(timed, "id", "age", "age", "age_1")


_LME_SQL = """long AS (SELECT c_custkey AS id, (CAST(o_orderdate AS DATE) - DATE '1937-06-01') / 365.25 AS age,
  o_totalprice / 1000 AS y, c_nationkey % 2 AS flag FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT id, 1.0 AS z0, flag::DOUBLE AS z1, age - min(age) OVER (PARTITION BY id) AS z2, y AS z3 FROM long),
per AS (SELECT id, count(*) AS n, sum(z0) s0, sum(z1) s1, sum(z2) s2, sum(z3) s3, sum(z1 * z2) g12, sum(z2 * z2) g22, sum(z2 * z3) g23, sum(z3 * z3) g33
  FROM x GROUP BY id)"""


def _simple_spec() -> M.Spec:
    return M.Spec("price", F.col("y"), {"status": F.col("flag"), "time": F.col("time")}, "status")


def _simple_visits(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).alias("flag"),
        C.age_by_days(F.lit("1937-06-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age"),
        (F.col("o_totalprice") / 1000).alias("y"),
    )
    return V.since_first(base)


@query(
    "lme_sums",
    f"""WITH {_LME_SQL} SELECT n, count(*) AS m, {sql6('sum(g12)', 4)} AS g1_2, {sql6('sum(g22)', 4)} AS g2_2, {sql6('sum(g23)', 2)} AS g2_3,
    {sql6('sum(g33)', 1)} AS g3_3, {sql6('sum(s0 * s2)', 4)} AS p0_2, {sql6('sum(s2 * s3)', 1)} AS p2_3, {sql6('sum(s3 * s3)', 0)} AS p3_3 FROM per GROUP BY n""",
)
def lme_sums(spark, sf):
    totals = M.cluster_totals(_simple_visits(spark, sf), "id", [_simple_spec()])
    digits = {"g1_2": 4, "g2_2": 4, "g2_3": 2, "g3_3": 1, "p0_2": 4, "p2_3": 1, "p3_3": 0}
    return totals.select("n", "m", *[r6(c, d).alias(c) for c, d in digits.items()])


@query(
    "lme_profile",
    f"""WITH per AS (SELECT c_custkey AS id, count(*)::DOUBLE AS n, sum(c_nationkey % 2)::DOUBLE AS x, sum(c_nationkey % 2)::DOUBLE AS xx,
      sum(o_totalprice / 1000) AS y, sum(c_nationkey % 2 * o_totalprice / 1000) AS xy, sum(pow(o_totalprice / 1000, 2)) AS yy
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    g AS (SELECT r.ratio, sum(n) AS nn, sum(ln(1 + n * r.ratio)) AS ld, sum(n - r.ratio / (1 + n * r.ratio) * n * n) AS a00,
      sum(x - r.ratio / (1 + n * r.ratio) * n * x) AS a01, sum(xx - r.ratio / (1 + n * r.ratio) * x * x) AS a11,
      sum(y - r.ratio / (1 + n * r.ratio) * n * y) AS b0, sum(xy - r.ratio / (1 + n * r.ratio) * x * y) AS b1,
      sum(yy - r.ratio / (1 + n * r.ratio) * y * y) AS w FROM per, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (2.0::DOUBLE)) r(ratio) GROUP BY 1),
    s AS (SELECT *, (a11 * b0 - a01 * b1) / (a00 * a11 - a01 * a01) AS c0, (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) AS c1 FROM g),
    t AS (SELECT *, (w - b0 * c0 - b1 * c1) / nn AS s2 FROM s),
    d AS (SELECT *, ld + nn * (ln(s2) + 1 + ln(2 * pi())) AS dev FROM t)
    SELECT ratio, 'intercept' AS term, {sql6('c0', 5)} AS coef, {sql6('s2', 3)} AS sigma2, {sql6('dev', 4)} AS deviance FROM d
    UNION ALL SELECT ratio, 'status', {sql6('c1', 5)}, {sql6('s2', 3)}, {sql6('dev', 4)} FROM d""",
)
def lme_profile(spark, sf):
    """Coefficients and deviance along the variance ratio, the function the fit minimises."""
    spec = M.Spec("price", F.col("y"), {"status": F.col("flag")}, "status")
    out = M.gls_at(spark, _simple_visits(spark, sf), "id", spec, [0.0, 0.25, 2.0])
    return out.select("ratio", "term", r6("coef", 5).alias("coef"), r6("sigma2", 3).alias("sigma2"), r6("deviance", 4).alias("deviance"))


def _rounded():
    return [r6(c, d).alias(c) for c, d in mixed_sql.DIGITS.items()]


@query(
    "lme_fit",
    f"""WITH RECURSIVE {_LME_SQL.split("per AS")[0]} y_ AS (SELECT 'price' AS model, id, z0, z2 AS z1, z1 AS z2, z3 FROM x),
    {mixed_sql.fit_sql("y_", 3)} SELECT model, n_obs, n_subjects, {mixed_sql.rounded()} FROM fit""",
)
def lme_fit(spark, sf):
    out = M.fit_models(spark, _simple_visits(spark, sf), "id", [_simple_spec()])
    return out.select("model", "n_obs", "n_subjects", *_rounded())


_ATLASES = {"200": {n: f"sfc_{n}" for n in _NETWORKS}, "400": {n: f"sfc400_{n}" for n in _NETWORKS}}


def _battery_sql() -> str:
    """The visits scaled, one row for each model; the reported term stands last but one."""
    coupling = [
        f"(o_totalprice / ({base} + {step} * {k})) % ({span} + {wider} * {k}) + c_acctbal / ({over} + {more} * {k}) AS {prefix}_{n}"
        for prefix, base, step, span, wider, over, more in (("sfc", 1000, 300, 90, 20, 400, 50), ("sfc400", 700, 200, 80, 15, 500, 40))
        for k, n in enumerate(_NETWORKS)
    ]
    measured = [c for own in _ATLASES.values() for c in own.values()]
    scaled = [*measured, "memory", "time", "age_1", "YoE"]
    z = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_samp({c}) OVER (), 0), 1) AS {c}_z" for c in scaled)
    models = []
    for atlas, own in _ATLASES.items():
        for net, c in own.items():
            shared = "time_z, age_1_z, male, YoE_z"
            models += [
                f"('group|{net}|{atlas}', 1.0, {shared}, 0.0, flag, {c}_z)",
                f"('group_change|{net}|{atlas}', 1.0, {shared}, flag, flag * time_z, {c}_z)",
                f"('memory|{net}|{atlas}', 1.0, {shared}, 0.0, {c}_z, memory_z)",
                f"('memory_change|{net}|{atlas}', 1.0, {shared}, {c}_z, {c}_z * time_z, memory_z)",
            ]
    known = " AND ".join(f"z{k} IS NOT NULL" for k in range(8))
    return f"""visits AS (
      SELECT c_custkey AS id, (c_nationkey % 2)::DOUBLE AS flag, (CAST(o_orderdate AS DATE) - DATE '1937-06-01') / 365.25 AS age,
        CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS male, (c_custkey % 12 + 8)::DOUBLE AS YoE,
        CASE WHEN o_orderkey % 29 <> 0 THEN o_totalprice / 1000 END AS memory, {', '.join(coupling)}
      FROM orders JOIN customer ON o_custkey = c_custkey
    ),
    timed AS (SELECT *, age - min(age) OVER (PARTITION BY id) AS time, min(age) OVER (PARTITION BY id) AS age_1 FROM visits),
    scaled AS (SELECT id, flag, male, {z} FROM timed),
    every_ AS (SELECT id, unnest([{', '.join(f"row{m}" for m in models)}]) AS v FROM scaled),
    named_ AS (SELECT id, v[1] AS model, {', '.join(f"v[{k + 2}]::DOUBLE AS z{k}" for k in range(8))} FROM every_),
    rows_ AS (SELECT * FROM named_ WHERE {known})"""


def _fdr_sql() -> str:
    family = " ".join(f"WHEN '{n}' THEN '{f}'" for n, f in M.FDR_FAMILIES.items())
    return f"""parts AS (SELECT * EXCLUDE (model), split_part(model, '|', 1) AS model, split_part(model, '|', 2) AS network, split_part(model, '|', 3) AS atlas FROM fit),
    fam AS (SELECT *, CASE network {family} END AS family FROM parts),
    placed AS (SELECT *, count(*) OVER (PARTITION BY atlas, model, family) AS m, row_number() OVER (PARTITION BY atlas, model, family ORDER BY p_value) AS place FROM fam),
    adjusted AS (SELECT *, least(1, min(p_value * m / place) OVER (PARTITION BY atlas, model, family ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM placed)"""


def battery_ctes() -> str:
    """SQL twin of ``battery_results``, as a CTE ``adjusted``."""
    return f"{_battery_sql()}, {mixed_sql.fit_sql('rows_', 7)}, {_fdr_sql()}"


def battery_results(spark: SparkSession, sf: str) -> DataFrame:
    return M.fit_battery(spark, _visits(spark, sf), "id", _ATLASES)


@query(
    "lme_battery",
    f"""WITH RECURSIVE {battery_ctes()}
    SELECT model, network, atlas, family, n_obs, n_subjects, {sql6("p_fdr")} AS p_fdr, {mixed_sql.rounded()} FROM adjusted""",
)
def lme_battery(spark, sf):
    """The 48 models: four kinds, six outcomes, two atlases."""
    out = battery_results(spark, sf)
    return out.select("model", "network", "atlas", "family", "n_obs", "n_subjects", r6("p_fdr").alias("p_fdr"), *_rounded())


# --- classifier features ------------------------------------------------------------


def _region_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding is a subject; its first and second 32 values are the two sessions' regions."""
    cells = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("subject_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "value")
    )
    return cells.select(
        "subject_id", F.when(F.col("k") < 32, "ses-01").otherwise("ses-02").alias("ses"), (F.col("k") % 32).alias("roi"), "value"
    )


def _people(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        key.cast("string").alias("subject_id"), (F.col("label") % 2).cast("int").alias("flag"),
        (key % 20 + 60).cast("double").alias("age_1"), (key % 20 + 60 + F.when(key % 50 == 0, 0).otherwise(key % 3 + 1)).cast("double").alias("age_2"),
        (key % 9 + 8).cast("double").alias("YoE"), F.when(key % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def _features(spark: SparkSession, sf: str, with_slope: bool) -> DataFrame:
    return V.assemble_features(_region_values(spark, sf), _people(spark, sf), with_slope=with_slope)


@query(
    "feature_assembly",
    f"""WITH e AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    r AS (SELECT vec_id, label % 2 AS y, k % 32 AS roi, max(v) FILTER (k < 32) AS v1, max(v) FILTER (k >= 32) AS v2,
                 vec_id % 3 + 1 AS gap FROM e WHERE vec_id % 50 <> 0 GROUP BY ALL)
    SELECT CAST(vec_id AS VARCHAR) AS subject_id, CAST(y AS INT) AS y, roi AS pos, {sql6('v1')} AS value FROM r
    UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(y AS INT), roi + 32, {sql6('(v2 - v1) / gap')} FROM r
    UNION ALL SELECT DISTINCT CAST(vec_id AS VARCHAR), CAST(y AS INT), 64, {sql6('vec_id % 20 + 60')} FROM r
    UNION ALL SELECT DISTINCT CAST(vec_id AS VARCHAR), CAST(y AS INT), 65, {sql6('vec_id % 9 + 8')} FROM r
    UNION ALL SELECT DISTINCT CAST(vec_id AS VARCHAR), CAST(y AS INT), 66, {sql6('CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END')} FROM r""",
)
def feature_assembly(spark, sf):
    return _features(spark, sf, True).select("subject_id", "y", F.posexplode("x").alias("pos", "v")).select(
        "subject_id", "y", "pos", r6("v").alias("value")
    )


@query(
    "feature_assembly_baseline",
    f"""WITH e AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT CAST(vec_id AS VARCHAR) AS subject_id, CAST(label % 2 AS INT) AS y, k AS pos, {sql6('v')} AS value FROM e WHERE k < 32
    UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(label % 2 AS INT), 32, {sql6('vec_id % 20 + 60')} FROM embeddings
    UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(label % 2 AS INT), 33, {sql6('vec_id % 9 + 8')} FROM embeddings
    UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(label % 2 AS INT), 34, {sql6('CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END')} FROM embeddings""",
)
def feature_assembly_baseline(spark, sf):
    """Features of the first visit only; subjects whose visits are no time apart stay."""
    return _features(spark, sf, False).select("subject_id", "y", F.posexplode("x").alias("pos", "v")).select(
        "subject_id", "y", "pos", r6("v").alias("value")
    )


@query(
    "penalty_grid",
    f"""WITH grid AS (SELECT k, l, pow(10, -4 + 7 * k / 9.0) AS c, [0.01, 0.1, 0.3, 0.5][l + 1]::DOUBLE AS l1 FROM range(10) a(k) CROSS JOIN range(4) b(l))
    SELECT CAST(k * 4 + l AS INT) AS candidate, {sql6('c')} AS c, l1 AS l1_ratio,
      (SELECT count(*) FROM customer WHERE abs(c_acctbal) / 10 <= grid.c) AS n_below FROM grid""",
)
def penalty_grid(spark, sf):
    """The candidates of the elastic net, log-spaced, and how many balances lie below each penalty."""
    grid = _EN.c_grid
    size = F.abs("c_acctbal") / 10
    row = table(spark, sf, "customer").agg(*[F.count_if(size <= c).alias(f"n{k}") for k, c in enumerate(grid)])
    counts = row.select(F.posexplode(F.array(*[F.col(f"n{k}") for k in range(len(grid))])).alias("k", "n_below"))
    own = S.parameter_grid(spark, _EN).withColumn("of_k", F.floor(F.col("candidate") / len(_EN.ratios)).cast("int"))
    return own.join(counts, F.col("of_k") == F.col("k")).select("candidate", r6("c").alias("c"), "l1_ratio", "n_below")


# The study's grids, folds and repeats are the defaults of Plan.
_EN, _SVM = S.Plan("elastic_net"), S.Plan("linear_svm")


@query("enet_nested_cv")
def enet_nested_cv(spark, sf):
    """Out-of-fold AUC per outer fold with the chosen candidate."""
    res = S.nested_cv(spark, _features(spark, sf, False), _EN)
    return res.fold_auc.join(res.best.select("outer", "c", "l1_ratio"), "outer").select(
        "outer", "c", "l1_ratio", "n_pos", "n_neg", r6("auc").alias("auc")
    )


@query("svm_nested_cv")
def svm_nested_cv(spark, sf):
    res = S.nested_cv(spark, _features(spark, sf, True), _SVM)
    return res.fold_auc.join(res.best.select("outer", "c"), "outer").select("outer", "c", "n_pos", "n_neg", r6("auc").alias("auc"))


@query("perm_importance")
def perm_importance(spark, sf):
    res = S.nested_cv(spark, _features(spark, sf, False), _EN)
    return res.features.select("feature", *[
        r6(c).alias(c) for c in ("coef_mean", "coef_std", "selected_freq", "abs_coef_mean", "perm_importance_mean")
    ])


@query("perm_null")
def perm_null(spark, sf):
    """Null AUCs in stored batches, resumed once, until the study's stopping rule; with the sequential p-value."""
    from neurospan.operators.discrimination import permutation_p
    from neurospan.streaming.incremental import stored

    plan = _SVM
    features = materialise(_features(spark, sf, False), scratch_dir(spark, "perm-null"))  # read by all three steps
    observed = S.nested_cv(spark, features, plan).observed_auc.first()["auc"]
    path = scratch_dir(spark, "null-auc")
    S.resumable_null(spark, features, plan, observed, path, n_perm=20)
    run_id = S.resumable_null(spark, features, plan, observed, path)
    null = stored(spark, path).select("run_id", "perm_id", "auc")
    obs = null.select("run_id").distinct().select("run_id", F.lit(float(observed)).alias("observed_auc"))
    return permutation_p(null.where(F.col("run_id") == run_id), obs, stop=50).drop("run_id")


@query(
    "coefficient_summary",
    f"""WITH c AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings),
    v AS (SELECT feature, CASE WHEN abs(raw) > 0.05 THEN raw ELSE 0 END AS value FROM c),
    per AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS sd, avg(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END) AS f FROM v GROUP BY feature),
    d AS (SELECT CAST(l_partkey % 64 AS INT) AS feature, l_orderkey % 10 AS outer_, avg(l_discount - 0.05) AS d FROM lineitem GROUP BY ALL),
    imp AS (SELECT feature, avg(d) AS d FROM d GROUP BY feature)
    SELECT feature, {sql6('m')} AS coef_mean, {sql6('sd')} AS coef_std, {sql6('f')} AS selected_freq, {sql6('abs(m)')} AS abs_coef_mean, {sql6('d')} AS perm_importance_mean
    FROM per JOIN imp USING (feature)""",
)
def coefficient_summary(spark, sf):
    """Weights over models and importance drops over folds, summarised per feature: every embedding is a model's weights."""
    weights = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v) > 0.05, v).otherwise(0.0))
    coefs = table(spark, sf, "embeddings").select(weights.alias("coef"))
    drops = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("outer"), (F.col("l_partkey") % 64).cast("int").alias("feature"), (F.col("l_discount") - 0.05).alias("drop")
    )
    out = S.summarise_coefficients(coefs, drops)
    return out.select("feature", *[r6(c).alias(c) for c in ("coef_mean", "coef_std", "selected_freq", "abs_coef_mean", "perm_importance_mean")])


@query(
    "out_of_fold_scores",
    f"""WITH m AS (SELECT vec_id AS fold, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE vec_id < 10),
    s AS (SELECT e.vec_id, fold, label % 2 AS y, list_sum(list_transform(range(1, len(w) + 1), lambda k: w[k] * CAST(embedding[k] AS DOUBLE))) + fold / 10.0 AS z
      FROM embeddings e JOIN m ON m.fold = e.vec_id % 10)
    SELECT CAST(vec_id AS VARCHAR) AS subject_id, CAST(fold AS INT) AS "outer", CAST(y AS INT) AS y, {sql6('1 / (1 + exp(-z))')} AS probability, {sql6('z')} AS margin FROM s""",
)
def out_of_fold_scores(spark, sf):
    """Every subject scored by the model of its fold, as a probability and as a margin; ten embeddings serve as models."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    folded = vectors.select(
        F.col("vec_id").cast("string").alias("subject_id"), (F.col("label") % 2).cast("int").alias("y"), "x", (F.col("vec_id") % 10).cast("int").alias("outer")
    )
    models = vectors.where("vec_id < 10").select(
        F.lit(0).cast("bigint").alias("perm_id"), F.col("vec_id").cast("int").alias("outer"), F.col("x").alias("weights"),
        (F.col("vec_id") / 10).alias("intercept"),
    )
    both = [S.out_of_fold(folded, models, plan, "subject_id") for plan in (_EN, _SVM)]
    margin = both[1].select(F.col("subject_id").alias("of"), F.col("score").alias("margin"))
    out = both[0].join(margin, F.col("subject_id") == F.col("of"))
    return out.select("subject_id", "outer", "y", r6("score").alias("probability"), r6("margin").alias("margin"))


@query(
    "model_summary",
    f"""WITH s AS (SELECT o_orderkey % 12 AS run, o_custkey % 2 AS y, o_totalprice AS score FROM orders),
    r AS (SELECT run, y, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS ra,
      rank() OVER (PARTITION BY run, y ORDER BY score) + (count(*) OVER (PARTITION BY run, y, score) - 1) / 2.0 AS rw,
      sum(y) OVER (PARTITION BY run) AS n1, sum(1 - y) OVER (PARTITION BY run) AS n0 FROM s),
    v AS (SELECT run, y, CASE WHEN y = 1 THEN (ra - rw) / n0 ELSE 1 - (ra - rw) / n1 END AS v FROM r),
    d AS (SELECT run, avg(v) FILTER (y = 1) AS auc, sqrt(var_samp(v) FILTER (y = 1) / count(*) FILTER (y = 1)
      + var_samp(v) FILTER (y = 0) / count(*) FILTER (y = 0)) AS se FROM v GROUP BY run),
    n AS (SELECT user_id % 12 AS run, event_id, CAST((event_id * 37 % 1000) / 1000.0::DOUBLE >= auc AS INT) AS hit FROM events JOIN d ON d.run = user_id % 12),
    k AS (SELECT *, row_number() OVER win AS draw, sum(hit) OVER win AS hits FROM n WINDOW win AS (PARTITION BY run ORDER BY event_id)),
    e AS (SELECT run, min(draw) FILTER (hits >= 50 AND hit = 1) AS stop_at, count(*) AS n_done, sum(hit) AS b FROM k GROUP BY run),
    p AS (SELECT d.run, auc, se, coalesce(stop_at, n_done) AS n_perm_used, coalesce(50.0::DOUBLE / stop_at, (b + 1.0::DOUBLE) / (n_done + 1)) AS p_value
      FROM d LEFT JOIN e ON e.run = d.run),
    f AS (SELECT *, run % 2 AS fam, count(p_value) OVER (PARTITION BY run % 2) AS m, count(p_value) OVER (PARTITION BY run % 2 ORDER BY p_value) AS upto FROM p)
    SELECT CASE fam WHEN 0 THEN 'elastic_net' ELSE 'linear_svm' END AS model, run // 2 % 3 AS modality, run // 6 AS feature_set,
      {sql6('auc')} AS auc, {sql6('auc - 1.959963984540054 * se')} AS ci_low, {sql6('auc + 1.959963984540054 * se')} AS ci_high,
      n_perm_used, {sql6('p_value')} AS p_value,
      {sql6('least(1, min(p_value * m / upto) OVER (PARTITION BY fam ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS p_fdr
    FROM f""",
)
def model_summary(spark, sf):
    """The twelve runs, two models x three modalities x two feature sets, with FDR inside each model."""
    from neurospan.operators.discrimination import summarise_runs

    def run(number):
        model = F.when(number % 2 == 0, "elastic_net").otherwise("linear_svm")
        return [model.alias("model"), F.floor(number / 2 % 3).alias("modality"), F.floor(number / 6).alias("feature_set")]

    keys = ["model", "modality", "feature_set"]
    scores = table(spark, sf, "orders").select(
        *run(F.col("o_orderkey") % 12), (F.col("o_custkey") % 2).alias("y"), F.col("o_totalprice").alias("score")
    )
    null = table(spark, sf, "events").select(
        *run(F.col("user_id") % 12), F.col("event_id").alias("perm_id"), ((F.col("event_id") * 37 % 1000) / 1000).alias("auc")
    )
    out = summarise_runs(scores, null, keys, ["model"])
    return out.select(*keys, *[r6(c).alias(c) for c in ("auc", "ci_low", "ci_high")], "n_perm_used", *[r6(c).alias(c) for c in ("p_value", "p_fdr")])


def _agreement_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey")).alias("feature"),
        ((F.col("p_retailprice") * 7) % 13 + F.col("p_size") % 5).alias("en"),
        ((F.col("p_retailprice") * 7) % 13 + F.col("p_size") % 7).alias("svm"),
    )
    return (base.select("feature", F.col("en").alias("perm_importance_mean")),
            base.select("feature", F.col("svm").alias("perm_importance_mean")))


_AGREE_SQL = """b AS (SELECT 'f' || CAST(p_partkey AS VARCHAR) AS feature, (p_retailprice * 7) % 13 + p_size % 5 AS en,
  (p_retailprice * 7) % 13 + p_size % 7 AS svm FROM part)"""


@query(
    "model_agreement",
    f"""WITH {_AGREE_SQL}, r AS (SELECT rank() OVER (ORDER BY en) + (count(*) OVER (PARTITION BY en) - 1) / 2.0 AS ra,
      rank() OVER (ORDER BY svm) + (count(*) OVER (PARTITION BY svm) - 1) / 2.0 AS rb FROM b)
    SELECT {sql6('corr(ra, rb)')} AS spearman_rho, count(*) AS n_features, 20 AS top_n,
      (SELECT count(*) FROM (SELECT feature FROM b ORDER BY en DESC, feature LIMIT 20) WHERE feature IN
        (SELECT feature FROM b ORDER BY svm DESC, feature LIMIT 20)) AS top_n_shared FROM r""",
)
def model_agreement(spark, sf):
    from neurospan.operators.report import model_agreement as agree

    a, b = _agreement_inputs(spark, sf)
    return agree(a, b, 20).withColumn("spearman_rho", r6("spearman_rho"))


@query(
    "model_ranks",
    f"""WITH {_AGREE_SQL} SELECT feature, rank() OVER (ORDER BY en DESC) AS en_rank, rank() OVER (ORDER BY svm DESC) AS svm_rank FROM b""",
)
def model_ranks(spark, sf):
    from neurospan.operators.report import with_model_ranks

    a, b = _agreement_inputs(spark, sf)
    return with_model_ranks(a, b).select("feature", "en_rank", "svm_rank")
