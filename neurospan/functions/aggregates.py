"""Aggregate expressions that stay defined on degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from neurospan.functions.columns import as_col


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r; NULL below two pairs, with a constant side (``corr`` raises there under ANSI) or an infinite value."""
    both = as_col(x).isNotNull() & as_col(y).isNotNull()
    a, b = F.when(both, as_col(x)), F.when(both, as_col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(~F.isnan(r), r)


def weighted_mean(value: Column | str, weight: Column | str, where: Column | None = None) -> Column:
    """Sum(v*w)/sum(w) over known values (neither NULL nor NaN); NULL when the weights sum to zero."""
    v, w = as_col(value), as_col(weight)
    known = v.isNotNull() & ~F.isnan(v.cast("double"))
    keep = known if where is None else known & where
    return F.try_divide(F.sum(F.when(keep, v * w)), F.sum(F.when(keep, w)))


def set_hash(c: Column | str) -> Column:
    """Order-independent fingerprint of a column's values.

    Mergeable partial aggregates only: nothing is collected per group.
    """
    h = F.xxhash64(as_col(c))
    return F.concat_ws(
        ":",
        F.count(as_col(c)).cast("string"),
        F.sum(h.cast("decimal(20,0)")).cast("string"),
        F.bit_xor(h).cast("string"),
    )


def first_known(value: Column | str, *priority: Column) -> Column:
    """First non-NULL value in an explicit order (never the arrival order)."""
    v = as_col(value)
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)])
    return F.min_by(v, F.when(v.isNotNull(), order))
