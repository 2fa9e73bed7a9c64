"""Descriptive statistics, group comparisons, scaling and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.functions import tails

WHOLE = "Whole cohort"  # label of the all-groups row


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def grouped_with_total(df: DataFrame, group: str, aggs: Sequence[Column], keys: Sequence[str] = (),
                       total: str = WHOLE) -> DataFrame:
    """Each group and the whole cohort from one aggregation (grouping sets)."""
    sets = [[*map(F.col, keys)], [*map(F.col, keys), F.col(group)]]
    grouped = df.groupingSets(sets, *keys, group).agg(*aggs, F.grouping(group).alias("_whole"))
    return grouped.withColumn(group, F.when(F.col("_whole") == 1, total).otherwise(F.col(group))).drop("_whole")


def overlapping_groups(df: DataFrame, members: Mapping[str, Column], value: str) -> DataFrame:
    """Statistics for groups that may share rows: each row is tagged with every group it is in."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in members.items()]))
    return describe(df.select(F.explode(tags).alias("grp"), value), value, ["grp"])


def welch(df: DataFrame, group: str, value: str, one, zero, keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Welch t-test of two groups per key from one pass of conditional moments."""
    a, b = F.when(F.col(group) == one, F.col(value)), F.when(F.col(group) == zero, F.col(value))
    moments = df.groupBy(*keys).agg(
        *[f(x).alias(f"{name}{k}") for k, x in ((1, a), (0, b))
          for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    se1, se0 = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v0"), F.col("n0"))
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(se1 + se0))
    df_ws = F.try_divide(
        (se1 + se0) * (se1 + se0),
        F.try_divide(se1 * se1, F.col("n1") - 1) + F.try_divide(se0 * se0, F.col("n0") - 1),
    )
    out = moments.withColumn("t", t).withColumn("df", df_ws)
    return out.withColumn("p_value", tails.t_pvalue("t", "df")) if p_value else out


def chi2_two_by_two(df: DataFrame, row: Column, col: Column, keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Independence test of two binary columns with Yates' correction, from four counts.

    The correction never exceeds the deviation itself.
    """
    def cell(r: bool, c: bool) -> Column:
        return F.count_if((row == F.lit(r)) & (col == F.lit(c))).cast("double")

    counts = df.groupBy(*keys).agg(
        cell(True, True).alias("a"), cell(True, False).alias("b"),
        cell(False, True).alias("c"), cell(False, False).alias("d"),
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    corrected = gap - F.least(gap, n / 2)
    stat = F.try_divide(n * corrected * corrected, (a + b) * (c + d) * (a + c) * (b + d))
    out = counts.withColumn("chi2", stat)
    return out.withColumn("p_value", tails.chi2_pvalue("chi2")) if p_value else out


def cross_counts(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """Cross-tab with an explicit level list; absent cells are 0."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.count(F.lit(1))).na.fill(0)


def zscore(df: DataFrame, values: Sequence[str], suffix: str = "_z", ddof: int = 1,
           fit_on: Column | None = None) -> DataFrame:
    """Scale columns by mean and SD of their own non-NULL rows.

    All moments come from one aggregate row read through a scalar subquery, so
    the rows themselves are not shuffled.  ``fit_on`` restricts the fit to
    training rows.  A constant column is divided by 1.
    """
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    cells = []
    for v in values:
        x = F.col(v) if fit_on is None else F.when(fit_on, F.col(v))
        cells += [F.avg(x).alias(f"mean_{v}"), F.nullif(sd(x), F.lit(0.0)).alias(f"sd_{v}")]
    fitted = df.withColumn("_moments", df.agg(F.struct(*cells)).scalar())
    m = F.col("_moments")
    return fitted.withColumns(
        {v + suffix: (F.col(v) - m[f"mean_{v}"]) / F.coalesce(m[f"sd_{v}"], F.lit(1.0)) for v in values}
    ).drop("_moments")


def zscore_by_fold(df: DataFrame, fold: str, n_folds: int, value: str, out: str = "z") -> DataFrame:
    """Every row scaled for every fold, fitted on that fold's training rows (other folds), ddof 0.

    The data is aggregated once, per fold; the training moments of each held-out
    fold merge the moments of the others (folds x folds rows).
    """
    held = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    per = df.groupBy(fold).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    own = Window.partitionBy("held_out")
    gap = F.col("_m") - F.col("_mean")
    fits = (
        per.withColumn("held_out", held).where(F.col(fold) != F.col("held_out"))
        .withColumn("_mean", F.sum(F.col("_n") * F.col("_m")).over(own) / F.sum("_n").over(own))
        .groupBy("held_out")
        .agg(F.max("_mean").alias("_mean"),
             F.sqrt(F.sum(F.col("_n") * (F.col("_v") + gap * gap)) / F.sum("_n")).alias("_sd"))
    )
    spread = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return (
        df.withColumn("held_out", held).join(fits, "held_out")
        .withColumn(out, (F.col(value) - F.col("_mean")) / spread)
        .drop("_mean", "_sd")
    )


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the minimum and maximum; the maximum falls in the last bin."""
    lo, hi = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    position = F.floor((F.col(value) - lo) * bins / F.nullif(hi - lo, F.lit(0.0)))
    bin_no = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over distinct (x, y) pairs, weighted by their counts."""
    from neurospan.operators.ordered import mid_ranks

    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = known.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    rx = mid_ranks(known, x, "rx").drop("n")
    ry = mid_ranks(known, y, "ry").drop("n")
    n = F.col("n")
    moments = pairs.join(rx, x).join(ry, y).agg(
        F.sum("w").alias("n"),
        *[F.sum(F.col("w") * e).alias(name) for name, e in (
            ("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") * F.col("rx")),
            ("syy", F.col("ry") * F.col("ry")), ("sxy", F.col("rx") * F.col("ry")))],
    )
    num = F.col("sxy") - F.col("sx") * F.col("sy") / n
    den = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n))
    return moments.select(F.try_divide(num, den).alias("rho"), "n")


def sample_characteristics(df: DataFrame, measures: Sequence[str], group: str, one, zero,
                           p_value: bool = True) -> DataFrame:
    """Whole-cohort and per-group mean (SD), whole-cohort range and Welch p for many measures.

    All measures are stacked into one long column, so the table costs one
    aggregation however many rows it has.
    """
    stacked = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures
    ])
    long = df.select(group, F.inline(stacked))

    def pair(who: Column | None):
        v = F.col("value") if who is None else F.when(who, F.col("value"))
        return F.avg(v), F.stddev_samp(v)

    g1, g0 = F.col(group) == one, F.col(group) == zero
    tests = welch(long, group, "value", one, zero, ["measure"], p_value)
    cells = long.groupBy("measure").agg(
        C.mean_sd(*pair(None)).alias("whole"),
        C.mean_range(F.avg("value"), F.min("value"), F.max("value")).alias("whole_range"),
        C.mean_sd(*pair(g0)).alias("group_0"),
        C.mean_sd(*pair(g1)).alias("group_1"),
    )
    keep = ["measure", "t", "df"] + (["p_value"] if p_value else [])
    return cells.join(tests.select(*keep), "measure")


def characteristics_table(df: DataFrame, flag: str, sex: str, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """The whole characteristics table: (section, measure, whole, group_0, group_1, p_value).

    Group 1 has flag 1; everyone else, an unknown flag included, is group 0.  The first section holds the group sizes
    and the share of women with a Yates-corrected chi-square; then one section per visit (or any other list of measures).
    """
    named = df.withColumn("_group", F.coalesce((F.col(flag) == 1).cast("int"), F.lit(0)))
    woman = F.lower(F.col(sex)).eqNullSafe("female")
    counts = chi2_two_by_two(named, F.col("_group") == 1, woman)
    of_1, of_0 = F.col("a") + F.col("b"), F.col("c") + F.col("d")

    def women(n: Column, total: Column) -> Column:
        return F.concat(C.fixed(n, 0), F.lit(" ("), C.fixed(F.try_divide(100 * n, total), 1), F.lit("%)"))

    def row(measure: str, whole: Column, group_0: Column, group_1: Column, p: Column) -> Column:
        named_cells = zip(("measure", "whole", "group_0", "group_1", "p_value"), (F.lit(measure), whole, group_0, group_1, p), strict=True)
        return F.struct(*[c.alias(name) for name, c in named_cells])

    cells = F.array(
        row("n", C.fixed(of_1 + of_0, 0), C.fixed(of_0, 0), C.fixed(of_1, 0), F.lit(None).cast("double")),
        row("female", women(F.col("a") + F.col("c"), of_1 + of_0), women(F.col("c"), of_0), women(F.col("a"), of_1), F.col("p_value")),
    )
    out = counts.select(F.lit("sample").alias("section"), F.inline(cells))
    measures = sorted({m for own in sections.values() for m in own})
    rows = sample_characteristics(named, measures, "_group", 1, 0)
    places = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("of")) for s, own in sections.items() for m in own])
    listed = rows.select("*", F.explode(places).alias("place")).where(F.col("place.of") == F.col("measure"))
    return out.unionByName(listed.select(F.col("place.section").alias("section"), "measure", "whole", "group_0", "group_1", "p_value"))
