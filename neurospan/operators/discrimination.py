"""ROC AUC, DeLong intervals and permutation p-values, per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.operators.ordered import numbered, running, with_ranges
from neurospan.session import scratch_dir
from neurospan.sources.sinks import materialise

Z_95 = 1.959963984540054  # fixed value: normal quantile at 0.975


def _score_table(df: DataFrame, y: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Distinct scores with class counts and running class counts.

    Replaces the positives x negatives comparison: the data is first reduced to
    one row per score, so ties and hot scores cost nothing extra.
    """
    counts = (
        df.where(F.col(score).isNotNull() & F.col(y).isin(0, 1))
        .groupBy(*keys, score)
        .agg(F.sum(F.col(y).cast("bigint")).alias("n1"), F.sum((1 - F.col(y)).cast("bigint")).alias("n0"))
    )
    return running(with_ranges(counts, keys, [score]), keys, [score], sums={"c1": "n1", "c0": "n0"})


def auc(df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """AUC with ties counted one half; NULL when a class is empty."""
    below = F.col("c0") - F.col("n0") / F.lit(2.0)
    return (
        _score_table(df, y, score, keys).groupBy(*keys)
        .agg(F.sum(F.col("n1") * below).alias("wins"), F.sum("n1").alias("n_pos"), F.sum("n0").alias("n_neg"))
        .select(*keys, "n_pos", "n_neg",
                F.try_divide(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")).alias("auc"))
    )


def delong(df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = (), z: float = Z_95) -> DataFrame:
    """AUC with DeLong standard error and interval from running counts (Sun & Xu 2014)."""
    keys = list(keys)
    table = _score_table(df, y, score, keys)
    totals = table.groupBy(*keys).agg(F.sum("n1").alias("n_pos"), F.sum("n0").alias("n_neg"))
    if keys:
        joined = table.join(totals, keys)
    else:
        joined = table.withColumn("n_pos", totals.select("n_pos").scalar()).withColumn(
            "n_neg", totals.select("n_neg").scalar()
        )
    v10 = F.try_divide(F.col("c0") - F.col("n0") / F.lit(2.0), F.col("n_neg"))
    v01 = F.try_divide(F.col("n_pos") - F.col("c1") + F.col("n1") / F.lit(2.0), F.col("n_pos"))
    sums = joined.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.sum(F.col("n1") * v10).alias("s10"), F.sum(F.col("n1") * v10 * v10).alias("q10"),
        F.sum(F.col("n0") * v01).alias("s01"), F.sum(F.col("n0") * v01 * v01).alias("q01"),
    )

    def var_of_mean(q: str, s: str, n: str):
        count = F.col(n).cast("double")
        ss = F.greatest(F.col(q) - F.try_divide(F.col(s) * F.col(s), count), F.lit(0.0))
        return F.try_divide(F.try_divide(ss, count - 1), count)

    return (
        sums.withColumn("auc", F.try_divide(F.col("s10"), F.col("n_pos")))
        .withColumn("se", F.sqrt(var_of_mean("q10", "s10", "n_pos") + var_of_mean("q01", "s01", "n_neg")))
        .select(*keys, "n_pos", "n_neg", "auc", "se",
                (F.col("auc") - z * F.col("se")).alias("ci_low"), (F.col("auc") + z * F.col("se")).alias("ci_high"))
    )


def permutation_p(null: DataFrame, observed: DataFrame, stop: int = 50, keys: Sequence[str] = ("run_id",),
                  perm: str = "perm_id") -> DataFrame:
    """Sequential permutation p (Besag & Clifford 1991).

    h/L when the h-th exceedance arrives at draw L, otherwise (b + 1)/(n + 1).
    ``null`` is (keys, perm_id, auc), ``observed`` (keys, observed_auc).
    """
    keys = list(keys)
    hits = null.join(observed, keys).withColumn("hit", (F.col("auc") >= F.col("observed_auc")).cast("int"))
    placed = numbered(hits, [perm], "draw", keys)
    counted = running(with_ranges(placed, keys, ["draw"]), keys, ["draw"], sums={"hits": "hit"})
    reached = F.min(F.when((F.col("hits") >= stop) & (F.col("hit") == 1), F.col("draw")))
    summed = counted.groupBy(*keys).agg(
        reached.alias("stop_at"), F.count(F.lit(1)).alias("n_done"), F.sum("hit").alias("exceedances")
    )
    p_all = (F.col("exceedances") + 1.0) / (F.col("n_done") + 1.0)
    return summed.select(
        *keys, "exceedances",
        F.coalesce("stop_at", "n_done").alias("n_perm_used"),
        F.coalesce(F.lit(float(stop)) / F.col("stop_at"), p_all).alias("p_value"),
    )


def summarise_runs(scores: DataFrame, null: DataFrame, keys: Sequence[str], family: Sequence[str], stop: int = 50) -> DataFrame:
    """One row per run: AUC with DeLong interval, sequential permutation p, permutations used, FDR inside ``family``.

    ``scores`` is (keys, y, score) out of fold, ``null`` (keys, perm_id, auc).  A run without permutations keeps its AUC
    and has no p.
    """
    from neurospan.operators.ordered import bh_fdr

    keys = list(keys)
    found = materialise(delong(scores, keys=keys), scratch_dir(scores.sparkSession, "runs"))
    tested = permutation_p(null, found.select(*keys, F.col("auc").alias("observed_auc")), stop, keys)
    return bh_fdr(found.join(tested, keys, "left"), keys=family)


def top_k_overlap(df: DataFrame, uid: str, a: str, b: str, k: int) -> DataFrame:
    """Items both rankings place among their k largest (item id breaks ties)."""
    best_a = df.orderBy(F.col(a).desc(), F.col(uid)).limit(k).select(uid)
    best_b = df.orderBy(F.col(b).desc(), F.col(uid)).limit(k).select(uid)
    return best_a.join(best_b, uid, "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))
