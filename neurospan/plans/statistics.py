"""Queries: descriptive tables, tests, ranks, FDR, AUC, folds, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.operators import discrimination as D
from neurospan.operators import groupstats as G
from neurospan.operators import ordered as O
from neurospan.plans.registry import query, r6, sql6
from neurospan.session import table


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").withColumn("grp", (F.col("c_nationkey") % 2).cast("int"))


@query(
    "describe",
    f"""SELECT c_mktsegment, count(c_acctbal) AS n, {sql6('avg(c_acctbal)')} AS mean, {sql6('stddev_samp(c_acctbal)')} AS sd,
    min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1""",
)
def describe(spark, sf):
    return G.describe(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]).withColumns(
        {"mean": r6("mean"), "sd": r6("sd")}
    )


@query(
    "group_table",
    f"""SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'Whole cohort' ELSE c_mktsegment END AS c_mktsegment, count(*) AS n,
    {sql6('avg(c_acctbal)')} AS mean, {sql6('stddev_samp(c_acctbal)')} AS sd FROM customer GROUP BY GROUPING SETS ((), (c_mktsegment))""",
)
def group_table(spark, sf):
    return G.grouped_with_total(table(spark, sf, "customer"), "c_mktsegment", [
        F.count(F.lit(1)).alias("n"), r6(F.avg("c_acctbal")).alias("mean"), r6(F.stddev_samp("c_acctbal")).alias("sd"),
    ])


@query(
    "overlapping_groups",
    f"""WITH g AS (SELECT 'rich' AS grp, c_acctbal FROM customer WHERE c_acctbal > 5000
      UNION ALL SELECT 'even', c_acctbal FROM customer WHERE c_nationkey % 2 = 0)
    SELECT grp, count(*) AS n, {sql6('avg(c_acctbal)')} AS mean, {sql6('stddev_samp(c_acctbal)')} AS sd FROM g GROUP BY grp""",
)
def overlapping_groups(spark, sf):
    members = {"rich": F.col("c_acctbal") > 5000, "even": F.col("c_nationkey") % 2 == 0}
    return G.overlapping_groups(table(spark, sf, "customer"), members, "c_acctbal").select(
        "grp", "n", r6("mean").alias("mean"), r6("sd").alias("sd")
    )


@query(
    "cross_counts",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
    count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def cross_counts(spark, sf):
    return G.cross_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def _t_tail_sql(t: str, df: str) -> str:
    """Two-sided t tail by Simpson's rule on cos^(df-1) over the angle; independent of the library's method."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    weight = "CASE WHEN u.k IN (0, 2000) THEN 1 WHEN u.k % 2 = 1 THEN 4 ELSE 2 END"
    integral = (
        f"(SELECT sum({weight} * pow(cos({angle} * u.k / 2000.0), {df} - 1)) * {angle} / 6000.0 "
        "FROM range(2001) u(k))"
    )
    beta = f"exp(lgamma(0.5) + lgamma({df} / 2) - lgamma(0.5 + {df} / 2))"
    return f"1 - 2 * {integral} / {beta}"


_WELCH_SQL = """m AS (SELECT c_mktsegment, count(*) FILTER (g = 1) AS n1, avg(c_acctbal) FILTER (g = 1) AS m1, var_samp(c_acctbal) FILTER (g = 1) AS v1,
    count(*) FILTER (g = 0) AS n0, avg(c_acctbal) FILTER (g = 0) AS m0, var_samp(c_acctbal) FILTER (g = 0) AS v0
  FROM (SELECT *, c_nationkey % 2 AS g FROM customer) GROUP BY 1),
w AS (SELECT c_mktsegment, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t,
             pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM m)"""


@query(
    "welch_t",
    f"WITH {_WELCH_SQL} SELECT c_mktsegment, {sql6('t')} AS t, {sql6('df')} AS df, {sql6(_t_tail_sql('t', 'df'))} AS p_value FROM w",
)
def welch_t(spark, sf):
    out = G.welch(_customers(spark, sf), "grp", "c_acctbal", 1, 0, ["c_mktsegment"])
    return out.select("c_mktsegment", r6("t").alias("t"), r6("df").alias("df"), r6("p_value").alias("p_value"))


_CHI_SQL = """c AS (SELECT c_mktsegment, count(*) FILTER (g AND r)::DOUBLE AS a, count(*) FILTER (g AND NOT r)::DOUBLE AS b,
    count(*) FILTER (NOT g AND r)::DOUBLE AS c, count(*) FILTER (NOT g AND NOT r)::DOUBLE AS d
  FROM (SELECT *, c_nationkey % 2 = 1 AS g, c_acctbal > 5000 AS r FROM customer) GROUP BY 1),
x AS (SELECT *, (a + b + c + d) * pow(abs(a * d - b * c) - least(abs(a * d - b * c), (a + b + c + d) / 2), 2)
                / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM c)"""
_CHI_TAIL = (
    "1 - (SELECT sum(CASE WHEN u.k IN (0, 2000) THEN 1 WHEN u.k % 2 = 1 THEN 4 ELSE 2 END "
    "* exp(-pow(sqrt(chi2 / 2) * u.k / 2000.0, 2))) * sqrt(chi2 / 2) / 6000.0 FROM range(2001) u(k)) * 2 / sqrt(pi())"
)


@query(
    "chi2_yates",
    f"WITH {_CHI_SQL} SELECT c_mktsegment, a, b, c, d, {sql6('chi2')} AS chi2, {sql6(_CHI_TAIL)} AS p_value FROM x",
)
def chi2_yates(spark, sf):
    out = G.chi2_two_by_two(
        _customers(spark, sf), F.col("grp") == 1, F.col("c_acctbal") > 5000, ["c_mktsegment"]
    )
    return out.withColumns({"chi2": r6("chi2"), "p_value": r6("p_value")})


@query(
    "histogram20",
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT CAST(least(floor((value - lo) * 20 / (hi - lo)), 19) AS INT) AS bin, count(*) AS n FROM events, b GROUP BY 1""",
)
def histogram20(spark, sf):
    return G.histogram(table(spark, sf, "events"), "value", 20)


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return G.value_counts(table(spark, sf, "events"), "event_type")


@query("distinct_count", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_subjects FROM orders GROUP BY 1")
def distinct_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_subjects"))


@query("sample_n", "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey LIMIT 10")
def sample_n(spark, sf):
    """Random inspection of ten rows, the same ones at every partitioning."""
    draw = F.md5(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.lit("7")))
    return table(spark, sf, "orders").orderBy(draw, "o_orderkey").limit(10)


@query(
    "zscore_global",
    f"""SELECT o_orderkey, {sql6('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)')}
    AS o_totalprice_z FROM orders""",
)
def zscore_global(spark, sf):
    return G.zscore(table(spark, sf, "orders"), ["o_totalprice"]).select("o_orderkey", r6("o_totalprice_z").alias("o_totalprice_z"))


_FOLD_SQL = """folds AS (SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) - 1) % 5 AS INT) AS fold
  FROM labels)"""


@query("strat_folds", f"WITH {_FOLD_SQL} SELECT doc_id, quality, fold FROM folds")
def strat_folds(spark, sf):
    return O.stratified_folds(table(spark, sf, "labels"), "doc_id", "quality", 5, 7).select("doc_id", "quality", "fold")


@query(
    "zscore_train_fold",
    f"""WITH {_FOLD_SQL}, x AS (SELECT f.doc_id, f.fold, d.n_chars::DOUBLE AS v FROM folds f JOIN documents d USING (doc_id)),
    h AS (SELECT DISTINCT fold AS held_out FROM x),
    m AS (SELECT held_out, avg(v) AS mu, stddev_pop(v) AS sd FROM x, h WHERE fold <> held_out GROUP BY 1)
    SELECT doc_id, held_out, {sql6('(v - mu) / sd')} AS z FROM x, m""",
)
def zscore_train_fold(spark, sf):
    folds = O.stratified_folds(table(spark, sf, "labels"), "doc_id", "quality", 5, 7)
    rows = folds.join(table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("v")), "doc_id")
    return G.zscore_by_fold(rows, "fold", 5, "v").select("doc_id", "held_out", r6("z").alias("z"))


# --- ranks and FDR ----------------------------------------------------------------

_P_SQL = """tests AS (SELECT l_orderkey AS id, l_partkey % 3 AS family,
  (sum(CAST(round(l_extendedprice * 100) AS BIGINT)) % 1000)::DOUBLE / 1000 AS p FROM lineitem GROUP BY ALL)"""


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    """One pseudo test per (order, family) with many tied p-values."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 3).alias("family")
    ).agg(((cents % 1000) / 1000).alias("p"))


_BH_SQL = f"""{_P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY family) AS m FROM tests),
q AS (SELECT id, family, p, least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM r)"""


@query("bh_fdr", f"WITH {_BH_SQL} SELECT id, family, p, {sql6('p_fdr')} AS p_fdr FROM q")
def bh_fdr(spark, sf):
    return O.bh_fdr(_tests(spark, sf), "p", ["family"]).withColumn("p_fdr", r6("p_fdr"))


@query(
    "rank_min",
    "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS rank FROM part",
)
def rank_min(spark, sf):
    return O.competition_rank(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size").select(
        "p_partkey", "p_size", "rank"
    )


@query(
    "mid_ranks",
    """SELECT p_size, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY p_size) - (count(*) - 1) / 2.0 AS DOUBLE) AS midrank
    FROM part GROUP BY p_size""",
)
def mid_ranks(spark, sf):
    return O.mid_ranks(table(spark, sf, "part"), "p_size")


@query(
    "row_numbers",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders",
)
def row_numbers(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return O.numbered(rows, ["o_totalprice", "o_orderkey"], keys=["o_orderstatus"]).select("o_orderkey", "row_no")


@query("topk", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topk(spark, sf):
    from neurospan.operators.report import top_features

    return top_features(table(spark, sf, "part"), 20, "p_retailprice", "p_partkey", positive_only=True).select(
        "p_partkey", "p_retailprice"
    )


@query(
    "custom_order",
    """SELECT p_partkey, p_type, row_number() OVER (ORDER BY list_position(['SMALL', 'MEDIUM', 'LARGE'], p_type) NULLS FIRST, p_partkey) AS n
    FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE')""",
)
def custom_order(spark, sf):
    from neurospan.operators.clean import in_listed_order

    rows = table(spark, sf, "part").where("p_type IN ('SMALL', 'MEDIUM', 'LARGE')").select("p_partkey", "p_type")
    order = ["SMALL", "MEDIUM", "LARGE"]
    placed = rows.withColumn("o", F.array_position(F.array(*[F.lit(v) for v in order]), F.col("p_type")))
    numbered = O.numbered(placed, ["o", "p_partkey"], "n").drop("o")
    return in_listed_order(numbered, "p_type", order, "p_partkey")


_TWO_SQL = """two AS (SELECT p_partkey AS id, p_retailprice + (p_size % 7) * 10 AS a, p_retailprice * 0.5 + p_size AS b FROM part)"""


def _two(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") + (F.col("p_size") % 7) * 10).alias("a"),
        (F.col("p_retailprice") * 0.5 + F.col("p_size")).alias("b"),
    )


_SPEARMAN_SQL = f"""{_TWO_SQL}, r AS (SELECT id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM two)"""


@query("spearman", f"WITH {_SPEARMAN_SQL} SELECT {sql6('corr(ra, rb)')} AS rho, count(*) AS n FROM r")
def spearman(spark, sf):
    return G.spearman(_two(spark, sf), "a", "b").select(r6("rho").alias("rho"), "n")


@query(
    "topk_overlap",
    f"""WITH {_TWO_SQL}, x AS (SELECT id FROM two ORDER BY a DESC, id LIMIT 20), y AS (SELECT id FROM two ORDER BY b DESC, id LIMIT 20)
    SELECT count(*) AS n_shared FROM x WHERE id IN (SELECT id FROM y)""",
)
def topk_overlap(spark, sf):
    return D.top_k_overlap(_two(spark, sf), "id", "a", "b", 20)


# --- discrimination -------------------------------------------------------------------

_SCORED_SQL = """s AS (SELECT toxic AS run, quality AS y, (n_chars // 200)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("toxic").alias("run"), F.col("quality").alias("y"), F.floor(F.col("n_chars") / 200).cast("double").alias("score")
    )


_PAIRS_SQL = f"""{_SCORED_SQL}, c AS (SELECT p.run, p.id AS pi, n.id AS ni,
    CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END AS w
  FROM (SELECT *, row_number() OVER () AS id FROM s WHERE y = 1) p JOIN (SELECT *, row_number() OVER () AS id FROM s WHERE y = 0) n ON p.run = n.run)"""


@query("auc", f"WITH {_PAIRS_SQL} SELECT run, count(DISTINCT pi) AS n_pos, count(DISTINCT ni) AS n_neg, {sql6('avg(w)')} AS auc FROM c GROUP BY run")
def auc(spark, sf):
    return D.auc(_scored(spark, sf), keys=["run"]).where("n_pos > 0 AND n_neg > 0").withColumn("auc", r6("auc"))


@query(
    "delong_ci",
    f"""WITH {_PAIRS_SQL}, v10 AS (SELECT run, pi, avg(w) AS v FROM c GROUP BY ALL), v01 AS (SELECT run, ni, avg(w) AS v FROM c GROUP BY ALL),
    a AS (SELECT run, count(*) AS n_pos, avg(v) AS auc, var_samp(v) / count(*) AS x FROM v10 GROUP BY run),
    b AS (SELECT run, count(*) AS n_neg, var_samp(v) / count(*) AS x FROM v01 GROUP BY run)
    SELECT run, n_pos, n_neg, {sql6('auc')} AS auc, {sql6('sqrt(a.x + b.x)')} AS se,
      {sql6('auc - 1.959963984540054 * sqrt(a.x + b.x)')} AS ci_low, {sql6('auc + 1.959963984540054 * sqrt(a.x + b.x)')} AS ci_high
    FROM a JOIN b USING (run)""",
)
def delong_ci(spark, sf):
    out = D.delong(_scored(spark, sf), keys=["run"]).where("n_pos > 0 AND n_neg > 0")
    return out.withColumns({c: r6(c) for c in ("auc", "se", "ci_low", "ci_high")})


_NULL_SQL = """nul AS (SELECT c_nationkey AS run_id, c_custkey AS perm_id, (c_acctbal % 100) / 100 AS auc FROM customer),
obs AS (SELECT n_nationkey AS run_id, 0.5 + (n_nationkey % 5) / 10.0 AS observed_auc FROM nation),
h AS (SELECT *, CAST(auc >= observed_auc AS INT) AS hit, row_number() OVER (PARTITION BY run_id ORDER BY perm_id) AS draw
      FROM nul JOIN obs USING (run_id)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY run_id ORDER BY draw) AS hits FROM h),
f AS (SELECT run_id, min(draw) FILTER (hits >= 10) AS stop_at, count(*) AS n, sum(hit)::BIGINT AS exceedances FROM c GROUP BY run_id)"""


@query(
    "perm_pvalue",
    f"""WITH {_NULL_SQL} SELECT run_id, exceedances, coalesce(stop_at, n) AS n_perm_used,
    {sql6('coalesce(10.0 / stop_at, (exceedances + 1.0) / (n + 1.0))')} AS p_value FROM f""",
)
def perm_pvalue(spark, sf):
    null = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("perm_id"), ((F.col("c_acctbal") % 100) / 100).alias("auc")
    )
    obs = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("run_id"), (F.lit(0.5) + (F.col("n_nationkey") % 5) / 10).alias("observed_auc")
    )
    return D.permutation_p(null, obs, stop=10).withColumn("p_value", r6("p_value"))


# --- characteristics table ---------------------------------------------------------

_MEASURES = ("acctbal", "n_orders", "mean_price")
_CHAR_SQL = """sub AS (SELECT c_custkey, c_nationkey % 2 AS grp, any_value(c_acctbal) AS acctbal, count(o_orderkey)::DOUBLE AS n_orders,
  round(avg(o_totalprice) / 1000, 1) AS mean_price FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
long AS (SELECT grp, 'acctbal' AS measure, acctbal AS value FROM sub UNION ALL SELECT grp, 'n_orders', n_orders FROM sub
         UNION ALL SELECT grp, 'mean_price', mean_price FROM sub),
m AS (SELECT measure, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
   avg(value) FILTER (grp = 1) AS m1, var_samp(value) FILTER (grp = 1) AS v1, count(*) FILTER (grp = 1) AS n1,
   avg(value) FILTER (grp = 0) AS m0, var_samp(value) FILTER (grp = 0) AS v0, count(*) FILTER (grp = 0) AS n0 FROM long GROUP BY 1),
w AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2)
   / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM m)"""


def _bound_sql(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN format('{{:.0f}}', {v}) ELSE format('{{:.1f}}', {v}) END"


@query(
    "sample_characteristics",
    f"""WITH {_CHAR_SQL} SELECT measure, format('{{:.2f}} ({{:.2f}})', mean, sd) AS whole,
    format('{{:.2f}} (', mean) || {_bound_sql('lo')} || '–' || {_bound_sql('hi')} || ')' AS whole_range,
    format('{{:.2f}} ({{:.2f}})', m0, sqrt(v0)) AS group_0, format('{{:.2f}} ({{:.2f}})', m1, sqrt(v1)) AS group_1,
    {sql6('t')} AS t, {sql6('df')} AS df, {sql6(_t_tail_sql('t', 'df'))} AS p_value FROM w""",
)
def sample_characteristics(spark, sf):
    subjects = (
        table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_custkey", "c_nationkey")
        .agg(F.max("c_acctbal").alias("acctbal"), F.count("o_orderkey").cast("double").alias("n_orders"),
             F.round(F.avg("o_totalprice") / 1000, 1).alias("mean_price"))
        .withColumn("grp", F.col("c_nationkey") % 2)
    )
    out = G.sample_characteristics(subjects, _MEASURES, "grp", 1, 0)
    return out.withColumns({c: r6(c) for c in ("t", "df", "p_value")})


_TABLE_SQL = """sub AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(c_nationkey % 2 AS INT) END AS grp,
    c_custkey % 3 = 0 AS woman, any_value(c_acctbal) AS acctbal, count(o_orderkey)::DOUBLE AS n_orders,
    round(avg(o_totalprice) / 1000, 1) AS mean_price FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  long AS (SELECT grp, 'acctbal' AS measure, acctbal AS value FROM sub UNION ALL SELECT grp, 'n_orders', n_orders FROM sub
    UNION ALL SELECT grp, 'mean_price', mean_price FROM sub),
  m AS (SELECT measure, avg(value) AS mean, stddev_samp(value) AS sd, avg(value) FILTER (grp = 1) AS m1, var_samp(value) FILTER (grp = 1) AS v1,
    count(*) FILTER (grp = 1) AS n1, avg(value) FILTER (grp = 0) AS m0, var_samp(value) FILTER (grp = 0) AS v0, count(*) FILTER (grp = 0) AS n0 FROM long GROUP BY 1),
  w AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2)
    / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM m),
  c AS (SELECT count(*) FILTER (grp = 1 AND woman)::DOUBLE AS a, count(*) FILTER (grp = 1 AND NOT woman)::DOUBLE AS b,
    count(*) FILTER (grp = 0 AND woman)::DOUBLE AS c, count(*) FILTER (grp = 0 AND NOT woman)::DOUBLE AS d FROM sub),
  x AS (SELECT *, (a + b + c + d) * pow(abs(a * d - b * c) - least(abs(a * d - b * c), (a + b + c + d) / 2), 2)
    / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM c)"""
_SECTIONS = {"first visit": ("acctbal", "mean_price"), "follow-up": ("n_orders", "mean_price")}


def _women_sql(n: str, total: str) -> str:
    return f"format('{{:.0f}} ({{:.1f}}%)', {n}, 100 * ({n}) / ({total}))"


@query(
    "characteristics_table",
    f"""WITH {_TABLE_SQL}, p(section, measure) AS (VALUES {", ".join(f"('{k}', '{m}')" for k, own in _SECTIONS.items() for m in own)})
    SELECT 'sample' AS section, 'n' AS measure, format('{{:.0f}}', a + b + c + d) AS whole, format('{{:.0f}}', c + d) AS group_0,
      format('{{:.0f}}', a + b) AS group_1, NULL AS p_value FROM x
    UNION ALL SELECT 'sample', 'female', {_women_sql('a + c', 'a + b + c + d')}, {_women_sql('c', 'c + d')}, {_women_sql('a', 'a + b')}, {sql6(_CHI_TAIL)} FROM x
    UNION ALL SELECT section, measure, format('{{:.2f}} ({{:.2f}})', mean, sd), format('{{:.2f}} ({{:.2f}})', m0, sqrt(v0)),
      format('{{:.2f}} ({{:.2f}})', m1, sqrt(v1)), {sql6(_t_tail_sql('t', 'df'))} FROM w JOIN p USING (measure)""",
)
def characteristics_table(spark, sf):
    """Sizes, sex and the measures of each visit; subjects of unknown flag are typical."""
    subjects = (
        table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_custkey", "c_nationkey")
        .agg(F.max("c_acctbal").alias("acctbal"), F.count("o_orderkey").cast("double").alias("n_orders"),
             F.round(F.avg("o_totalprice") / 1000, 1).alias("mean_price"))
        .withColumns({
            "flag": F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey") % 2),
            "sex": F.when(F.col("c_custkey") % 3 == 0, "female").otherwise("male"),
        })
    )
    return G.characteristics_table(subjects, "flag", "sex", _SECTIONS).withColumn("p_value", r6("p_value"))


@query(
    "p_text",
    f"""WITH {_WELCH_SQL}, p AS (SELECT c_mktsegment, t, {_t_tail_sql('t', 'df')} AS p FROM w)
    SELECT c_mktsegment, CASE WHEN p < 0.0001 THEN '<0.0001' ELSE format('{{:.4f}}', p) END AS p_floor,
      format('{{:.4f}}', p) || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS p_stars,
      CASE WHEN p < 0.0001 THEN '<0.0001' ELSE '=' || format('{{:.4f}}', p) END AS p_inline FROM p""",
)
def p_text(spark, sf):
    out = G.welch(_customers(spark, sf), "grp", "c_acctbal", 1, 0, ["c_mktsegment"])
    return out.select(
        "c_mktsegment", C.p_floor_text("p_value").alias("p_floor"), C.p_stars_text("p_value").alias("p_stars"),
        C.p_inline_text("p_value").alias("p_inline"),
    )
