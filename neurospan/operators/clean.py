"""Harmonising subject tables: names, missing codes, visits, unions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.functions.aggregates import first_known

VISIT_PREFIX = (r"^w([12])_(.*)$", r"\2_\1")  # w1_x -> x_1
VISIT_INFIX = (r"^(.*)_tp([12])_(.*)$", r"\1_\3_\2")  # x_tp1_y -> x_y_1


def prefix_columns(df: DataFrame, names: Sequence[str], prefix: str = "w2_") -> DataFrame:
    """Prefix the listed columns that exist."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c in set(names)})


def visit_names(df: DataFrame, rules: Sequence[tuple[str, str]] = (VISIT_PREFIX, VISIT_INFIX)) -> DataFrame:
    """Apply regular-expression rename rules to every column name."""
    names = df.columns
    for pattern, target in rules:
        names = [re.sub(pattern, target, n) for n in names]
    return df.toDF(*names)


def drop_paired_bases(df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Drop ``x`` where ``x_1`` or ``x_2`` exists."""
    bases = {re.sub("_[12]$", "", c) for c in df.columns if re.search("_[12]$", c)}
    return df.drop(*[c for c in df.columns if c in bases and c not in keep])


def require_then_unmask(df: DataFrame, required: Sequence[str], sentinel: float = -1,
                        unmask: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``required``, then turn the sentinel into NULL.

    The order matters: a sentinel counts as present, so its row stays with a NULL.
    """
    kept = df.na.drop(subset=list(required))
    return kept.withColumns({c: C.sentinel_to_null(c, sentinel) for c in (unmask or required)})


def differing(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two values differ; an unknown value counts as different."""
    return df.where(~F.col(a).eqNullSafe(F.col(b)) | F.col(a).isNull())


def not_equal_or_unknown(df: DataFrame, c: str, value) -> DataFrame:
    return df.where(F.col(c).isNull() | (F.col(c) != value))


def long_enough_followup(df: DataFrame, age1: str, age2: str, years: float = 1.5) -> DataFrame:
    """Keep people followed longer than ``years``; a missing age does not exclude."""
    gap = F.col(age2) - F.col(age1)
    return df.where(gap.isNull() | (gap > years))


def blank_listed(df: DataFrame, uid: str, rules: Mapping[str, Sequence]) -> DataFrame:
    """NULL a column for the listed ids: ``{column: ids}``."""
    def listed(ids: Sequence) -> Column:
        return F.coalesce(F.col(uid).isin(list(ids)), F.lit(False))

    blanked = {c: F.when(~listed(ids), F.col(c)) for c, ids in rules.items() if ids}
    return df.withColumns(blanked)


def blank_by_table(df: DataFrame, uid: str, invalid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Same from a table ``(uid, column)`` of any size: one marker row per id, then a left join."""
    marks = invalid.groupBy(uid).agg(
        *[F.max((F.col("column") == c).cast("int")).alias(f"_bad_{c}") for c in columns]
    )
    joined = df.join(marks, uid, "left")
    return joined.withColumns(
        {c: F.when(F.coalesce(F.col(f"_bad_{c}"), F.lit(0)) == 0, F.col(c)) for c in columns}
    ).drop(*[f"_bad_{c}" for c in columns])


def comments_to_read(df: DataFrame, first: str, second: str, boring_first: Sequence[str] = C.BOILERPLATE_COMMENTS,
                     boring_second: Sequence[str] = C.BOILERPLATE_COMMENTS,
                     boring_pattern: str | None = None) -> DataFrame:
    """Drop rows whose two comments are both empty or boilerplate."""
    a = F.coalesce(F.col(first), F.lit(""))
    empty_a = a.isin(*boring_first)
    if boring_pattern:
        empty_a = empty_a | a.rlike(boring_pattern)
    return df.where(~(empty_a & F.coalesce(F.col(second), F.lit("")).isin(*boring_second)))


def stack_cohorts(a: DataFrame, b: DataFrame, text: Sequence[str] = ("id", "sex")) -> DataFrame:
    """Union by name; shared columns other than ``text`` are read as numbers, bad values NULL."""
    shared = [c for c in a.columns if c in b.columns and c not in text]

    def numeric(df: DataFrame) -> DataFrame:
        return df.withColumns({c: C.number(c) for c in shared})

    return numeric(a).unionByName(numeric(b), allowMissingColumns=True)


def first_known_per_key(sources: Sequence[DataFrame], uid: str, value: str, order: Sequence[str]) -> DataFrame:
    """First non-NULL value per id over several sources, in source order then ``order``."""
    stacked = None
    for k, s in enumerate(sources):
        part = s.select(uid, value, *order).withColumn("_source", F.lit(k))
        stacked = part if stacked is None else stacked.unionByName(part)
    return (
        stacked.where(F.col(value).isNotNull()).groupBy(uid)
        .agg(first_known(value, F.col("_source"), *[F.col(o) for o in order]).alias(value))
    )


def on_spine(spine: DataFrame, values: DataFrame, uid: str) -> DataFrame:
    """Keep exactly the spine's rows; absent values become NULL."""
    return spine.join(values, uid, "left")


def common_subjects(tables: Sequence[DataFrame], uid: str, complete: DataFrame | None = None,
                    required: Sequence[str] = ()) -> DataFrame:
    """Ids present in every table and, in ``complete``, with no required value missing."""
    out = tables[0].select(uid).distinct()
    for t in tables[1:]:
        out = out.join(t.select(uid), uid, "left_semi")
    if complete is not None:
        out = out.join(complete.na.drop(subset=list(required)).select(uid), uid, "left_semi")
    return out


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted keys without a stored result."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def in_listed_order(df: DataFrame, column: str, order: Sequence, *then: Column | str) -> DataFrame:
    """Sort by a custom order list, then by the rest."""
    return df.orderBy(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column)), *then)
