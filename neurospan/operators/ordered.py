"""Running totals, ranks and FDR over data no single task could hold.

A window without a selective PARTITION BY sorts everything in one task.  Here
the (key, value) order is cut into ranges, each range is a window of its own,
and a small table of range totals carries the running value across.  Cut points
only balance the work; every row is kept whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurospan.session import scratch_dir
from neurospan.sources.sinks import materialise

RANGE = "_range"


def with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add ``_range``: a contiguous slice number in (keys, order), dealt by Spark's range partitioning.

    There are as many slices as shuffle partitions unless ``ranges`` says otherwise; raise that setting with the data.
    The rows are stored, because the slices of a second evaluation could be cut elsewhere.
    """
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = df.repartitionByRange(count, *[F.col(c) for c in [*keys, *order]]).withColumn(RANGE, F.spark_partition_id())
    return materialise(cut, scratch_dir(df.sparkSession, "ranges"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str] | None = None,
            min_from_end: Mapping[str, str] | None = None) -> DataFrame:
    """Add running columns to a table prepared by :func:`with_ranges`.

    ``sums``: output -> input, inclusive running sum in (keys, order).
    ``min_from_end``: output -> input, minimum over this row and all later ones.
    (keys, order) must identify a row; aggregate to distinct values first.
    """
    sums, min_from_end = dict(sums or {}), dict(min_from_end or {})
    keys = list(keys)
    within = Window.partitionBy(*keys, RANGE).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = within.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # one row per (key, range): at most ranges + number of keys
    per_range = df.groupBy(*keys, RANGE).agg(
        *[F.sum(src).alias(f"_s_{out}") for out, src in sums.items()],
        *[F.min(src).alias(f"_m_{out}") for out, src in min_from_end.items()],
    )
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(RANGE)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    carried = per_range.select(
        *keys, RANGE,
        *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_s_{o}") for o in sums],
        *[F.min(f"_m_{o}").over(later).alias(f"_m_{o}") for o in min_from_end],
    )
    # a missing key is a group of its own, so keys are compared null-safely
    right = carried.withColumnsRenamed({c: f"_on_{c}" for c in [*keys, RANGE]})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in keys], F.col(RANGE) == F.col(f"_on_{RANGE}"))
    joined = df.join(right, same)
    return joined.select(
        *df.columns,
        *[(F.sum(src).over(upto) + F.col(f"_s_{o}")).alias(o) for o, src in sums.items()],
        # least() skips NULL, which is what the last range carries
        *[F.least(F.min(src).over(onward), F.col(f"_m_{o}")).alias(o) for o, src in min_from_end.items()],
    )


def latest_known(df: DataFrame, known: DataFrame, keys: Sequence[str], at: str, known_at: str, value: str, out: str) -> DataFrame:
    """As-of merge: ``df`` with the ``value`` of the last row of ``known`` at or before ``at``, per key.

    Both tables are put into one order and each row looks back to the last known value; ranges of that order are
    windows of their own and hand their last value on, so a hot key is many tasks.  Of several known rows at one place
    the largest value counts.  NULL where nothing is known before; a missing key or place gives NULL.
    """
    keys = list(keys)
    placed = df.withColumn("_at", F.col(at)).withColumn("_value", F.lit(None).cast(known.schema[value].dataType)).withColumn("_side", F.lit(1))
    usable = known.where(F.col(known_at).isNotNull() & F.col(value).isNotNull())
    marks = usable.select(*keys, F.col(known_at).alias("_at"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    order = ["_at", "_side", "_value"]
    cut = with_ranges(placed.unionByName(marks, allowMissingColumns=True), keys, order)
    within = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by("_value", F.struct("_at", "_value")).alias("_last")
    per_range = cut.where("_side = 0").groupBy(*keys, RANGE).agg(last).unionByName(
        cut.select(*keys, RANGE).distinct().withColumn("_last", F.lit(None).cast(known.schema[value].dataType))
    ).groupBy(*keys, RANGE).agg(F.max("_last").alias("_last"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select(*keys, RANGE, F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    right = carried.withColumnsRenamed({c: f"_on_{c}" for c in [*keys, RANGE]})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in [*keys, RANGE]])
    usable_key = reduce(and_, [F.col(c).isNotNull() for c in [at, *keys]])
    merged = cut.withColumn("_found", F.last("_value", ignorenulls=True).over(within)).where("_side = 1").join(right, same)
    found = F.when(usable_key, F.coalesce("_found", "_carried"))
    return merged.select(*df.columns, found.alias(out))


def mid_ranks(df: DataFrame, value: str, out: str = "midrank", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their average rank: (keys..., value, n, out)."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cut = with_ranges(distinct, keys, [value])
    return running(cut, keys, [value], sums={"_upto": "n"}).select(
        *keys, value, "n", (F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).alias(out)
    )


def competition_rank(df: DataFrame, value: str, out: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Rank 1 = largest; ties share the smallest rank; rows with NULL keep NULL."""
    distinct = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_neg", -F.col(value))
    )
    cut = with_ranges(distinct, keys, ["_neg"])
    ranked = running(cut, keys, ["_neg"], sums={"_upto": "_n"}).select(
        *keys, value, (F.col("_upto") - F.col("_n") + 1).alias(out)
    )
    return df.join(ranked, [*keys, value], "left")


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_no", keys: Sequence[str] = ()) -> DataFrame:
    """1..k in order, per key; ``order`` must be unique within the key."""
    cut = with_ranges(df.withColumn("_one", F.lit(1)), keys, order)
    return running(cut, keys, order, sums={out: "_one"}).drop("_one", RANGE)


def bh_fdr(df: DataFrame, p: str = "p_value", keys: Sequence[str] = (), out: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p per family (1995).

    The tests are stored once and read from there, so a p that a second evaluation would give in another last digit still
    meets its family.  Ties are collapsed to (value, count) first, so a third of all tests sharing one p costs one row.
    Both running columns use one range assignment.  A p outside [0, 1] is an error; NULL stays NULL.
    """
    keys, spark = list(keys), df.sparkSession
    wrong = (F.col(p) < 0) | (F.col(p) > 1) | F.isnan(p)
    tests = df.withColumn(p, F.when(wrong, F.raise_error(F.lit("p-value outside [0, 1]"))).otherwise(F.col(p)))
    tests = materialise(tests, scratch_dir(spark, "tests"))
    distinct = tests.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"))
    cut = with_ranges(distinct, keys, [p])
    family = keys or [F.lit(0)]

    def carried(per_range: DataFrame, *cells) -> DataFrame:
        found = per_range.select(*keys, RANGE, *cells)
        return found.withColumnsRenamed({c: f"_on_{c}" for c in [*keys, RANGE]})

    def met(columns: Sequence[str]):
        return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in columns])

    across = Window.partitionBy(*family).orderBy(RANGE)
    counts = carried(
        cut.groupBy(*keys, RANGE).agg(F.sum("_n").alias("_s")),
        F.coalesce(F.sum("_s").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_s").over(Window.partitionBy(*family)).alias("_m"),
    )
    within = Window.partitionBy(*keys, RANGE).orderBy(p)
    upto = F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    scaled = cut.join(counts, met([*keys, RANGE])).withColumn("_q", F.col(p) * F.col("_m") / upto)
    least = F.min("_q").over(within.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scaled = materialise(scaled.select(*keys, p, RANGE, least.alias("_q")), scratch_dir(spark, "scaled"))
    later = carried(
        scaled.groupBy(*keys, RANGE).agg(F.min("_q").alias("_l")),
        F.min("_l").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    # least() skips NULL, which is what the last range carries
    adjusted = scaled.join(later, met([*keys, RANGE])).select(*keys, p, F.least("_q", "_later", F.lit(1.0)).alias(out))
    return tests.join(adjusted, [*keys, p], "left")


def hash_numbered(df: DataFrame, uid: str, salt: str, keys: Sequence[str] = (), out: str = "row_no") -> DataFrame:
    """Reproducible random numbering per key: 1..k in the order of md5(uid, salt).

    The hash is uniform, so its leading digits are the range and no cut points are needed: three digits (4,096 ranges)
    per key, more if the session has more shuffle partitions.  Identical in any engine with md5, whatever the partitioning.
    """
    h = F.md5(F.concat_ws(":", F.col(uid).cast("string"), F.lit(salt)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    digits = max(3, math.ceil(math.log(max(parts, 1), 16)))
    cut = (
        df.withColumn("_h", h).withColumn("_one", F.lit(1))
        .withColumn(RANGE, F.conv(F.substring("_h", 1, digits), 16, 10).cast("bigint"))
    )
    return running(cut, keys, ["_h", uid], sums={out: "_one"}).drop("_h", "_one", RANGE)


def stratified_folds(df: DataFrame, uid: str, y: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Class-balanced fold number 0..k-1 per row, by hashed order within each class."""
    return hash_numbered(df, uid, str(seed), keys=(y,), out="_no").withColumn(
        out, ((F.col("_no") - 1) % k).cast("int")
    ).drop("_no")
