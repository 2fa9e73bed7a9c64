"""Two-visit tables: wide to long, baseline values, annual change."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.functions.aggregates import set_hash


def to_long(df: DataFrame, uid: str = "id", fixed: Sequence[str] = (), visits: Sequence[int] = (1, 2)) -> DataFrame:
    """``x_1, x_2`` columns -> one row per visit, in a single pass over the table."""
    stems = sorted({m.group(1) for c in df.columns if (m := re.match(r"(.*)_([12])$", c))})
    kinds = {f"{s}_{v}": df.schema[f"{s}_{v}"].dataType for s in stems for v in visits if f"{s}_{v}" in df.columns}

    def cell(stem: str, visit: int):
        name = f"{stem}_{visit}"
        if name in kinds:
            return F.col(name).alias(stem)
        other = next(k for n, k in kinds.items() if n.rsplit("_", 1)[0] == stem)
        return F.lit(None).cast(other).alias(stem)

    rows = F.array(*[F.struct(F.lit(v).alias("timepoint"), *[cell(s, v) for s in stems]) for v in visits])
    return df.select(uid, *fixed, F.inline(rows))


def since_first(long: DataFrame, uid: str = "id", age: str = "age", out: str = "time") -> DataFrame:
    """Years since the subject's first known age.

    Minimum per subject then a join back, so one subject with very many rows is
    aggregated map-side and its join side can be split, which a window cannot.
    """
    first = long.groupBy(uid).agg(F.min(age).alias("_first"))
    return long.join(first, uid).withColumn(out, F.col(age) - F.col("_first")).drop("_first")


def with_baseline(long: DataFrame, uid: str, value: str, order: str, out: str) -> DataFrame:
    """Carry the value of the earliest row to all rows of the subject."""
    base = long.groupBy(uid).agg(F.min_by(value, order).alias(out))
    return long.join(base, uid)


def annual_changes(df: DataFrame, stems: Sequence[str], age: str = "age") -> DataFrame:
    """``<stem>_slope`` for every stem whose two visits and ages exist."""
    have = [s for s in stems if {f"{s}_1", f"{s}_2", f"{age}_1", f"{age}_2"} <= set(df.columns)]
    return df.withColumns(
        {f"{s}_slope": C.annual_change(f"{s}_1", f"{s}_2", f"{age}_1", f"{age}_2") for s in have}
    )


def first_and_last(events: DataFrame, uid: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First and last row per subject as ``<value>_1`` / ``<value>_2``."""
    place = F.struct(*order)
    return events.groupBy(uid).agg(
        F.count(F.lit(1)).alias("n_visits"),
        *[F.min_by(v, place).alias(f"{v}_1") for v in values],
        *[F.max_by(v, place).alias(f"{v}_2") for v in values],
    )


def slopes_between(values: DataFrame, ages: DataFrame, uid: str, keys: Sequence[str], value: str,
                   first: str, second: str) -> DataFrame:
    """Annual change of long per-session values: (uid, keys..., value_1, value_2, has_1, has_2, slope).

    ``has_1`` and ``has_2`` tell whether the visit has a row at all, whatever its value.
    """
    both = values.groupBy(uid, *keys).agg(
        F.max(F.when(F.col("ses") == first, F.col(value))).alias("value_1"),
        F.max(F.when(F.col("ses") == second, F.col(value))).alias("value_2"),
        F.bool_or(F.col("ses") == first).alias("has_1"),
        F.bool_or(F.col("ses") == second).alias("has_2"),
    )
    return both.join(ages, uid).withColumn("slope", C.annual_change("value_1", "value_2", "age_1", "age_2"))


def wide_master(demographics: DataFrame, measures: Sequence[DataFrame], stems: Sequence[str], uid: str = "subject_id") -> DataFrame:
    """One row per subject of ``demographics`` with the visit columns of every measure table and their annual changes.

    Each measure table has one row per subject (``<stem>_1``, ``<stem>_2``); subjects without one keep NULLs.
    """
    out = demographics
    for table in measures:
        out = out.join(table, uid, "left")
    return annual_changes(out, stems)


def assemble_features(regions: DataFrame, demographics: DataFrame, uid: str = "subject_id", roi: str = "roi",
                      value: str = "value", with_slope: bool = False,
                      covariates: Sequence[str] = ("age_1", "YoE", "sex"), label: str = "flag",
                      first: str = "ses-01", second: str = "ses-02") -> DataFrame:
    """(uid, y, x): region values in region order, optional slopes, then covariates.

    A subject needs rows of both sessions; a row drops only for an unknown value among those in use, so a value missing
    at the second visit does not matter to the baseline model.  Subjects whose region set differs from the others' are
    an error, as their values could not stand in the same columns.  The per-subject array holds one element per region,
    so it is bounded by the atlas.
    """
    ages = demographics.select(uid, "age_1", "age_2")
    per_roi = slopes_between(regions, ages, uid, [roi], value, first, second)
    unknown = F.lit(float("nan"))
    cell = F.struct(roi, F.coalesce("value_1", unknown).alias("value_1"), F.coalesce("slope", unknown).alias("slope"))
    packed = per_roi.groupBy(uid).agg(
        F.array_sort(F.collect_list(cell)).alias("cells"),
        F.bool_or("has_1").alias("any_1"), F.bool_or("has_2").alias("any_2"),
        set_hash(roi).alias("roi_hash"),
    ).where("any_1 AND any_2")
    agreed = packed.agg((F.count_distinct("roi_hash") <= 1).alias("agreed")).scalar()
    checked = packed.withColumn("cells", F.when(agreed, F.col("cells")).otherwise(
        F.raise_error(F.lit("subjects differ in their regions")).cast(packed.schema["cells"].dataType)
    ))
    parts = [F.col("cells.value_1")] + ([F.col("cells.slope")] if with_slope else [])
    people = demographics.select(
        uid, F.col(label).alias("y"),
        F.array(*[
            (C.recode("sex", {"male": 1.0, "female": 0.0}) if c == "sex" else F.col(c).cast("double")) for c in covariates
        ]).alias("cov"),
    )
    rows = checked.join(people, uid).select(uid, "y", F.concat(*parts, "cov").alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.where(F.col("y").isNotNull() & good)
