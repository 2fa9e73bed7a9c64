"""Mixing sources to target weights, in DataFrame expressions only.

Each source gets a share of the mix by weight, up to a multiple of its size; what lies above is shared out again.  A
source whose target exceeds its size is taken in complete epochs first.  The rest is selected by Efraimidis-Spirakis
sampling: each document draws an exponential key scaled by its quality weight, and documents are taken in the order of
their keys until the words left are used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurospan.llm.shared import same, stored
from neurospan.operators.ordered import running, with_ranges

#: Weights of the sources in code point order, repeating; size of the mix against all sizes; most repeats of a source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = 17


def words(text: str = "text") -> Column:
    """The words of a text: runs without ASCII white space; a null text has none."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def varied(found: Column) -> Column:
    """The default quality weight: a tenth and the share of distinct words."""
    return F.lit(0.1) + F.when(F.size(found) > 0, F.size(F.array_distinct(found)) / F.size(found)).otherwise(0.0)


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def sized(docs: DataFrame, quality: str | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key): words of each document and its exponential key over its weight.

    A weight that is null, NaN or not above zero counts as 1e-9: such documents come last.
    """
    found = docs.select("doc_id", "source", words().alias("words"), *([F.col(quality).cast("double").alias("weight")] if quality else []))
    weight = F.col("weight") if quality else varied(F.col("words"))
    rows = found.select("doc_id", "source", F.size("words").cast("long").alias("size"), weight.alias("weight"))
    usable = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(1e-9)
    return rows.select("doc_id", "source", "size", (-F.log(draw(F.col("doc_id"), seed)) / usable).alias("key"))


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, ..., target) for (source, source_size, ...): shares by weight, none above ``most`` times its size.

    Sharing out what lies above the limits again, until none is above, ends where all other sources stand at one level
    of words per weight.  A source is at its limit exactly if filling every source up to this one's level of words per
    weight does not use up the mix, so one running total in the order of these levels decides for all sources.
    ``share`` must not exceed ``most``.
    """
    if not 0 < share <= most:
        raise ValueError("the mix cannot be larger than all limits together")
    last = totals.withColumn("_none", F.col("source").isNull()).withColumn("_one", F.lit(1))
    placed = running(with_ranges(last, [], ["_none", "source"]), [], ["_none", "source"], sums={"_place": "_one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    placed = placed.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    placed = stored(placed.withColumn("_level", F.col("_limit") / F.col("_weight")).drop("_range", "_none", "_one"))
    filled = running(with_ranges(placed, [], ["_level", "_place"]), [], ["_level", "_place"], sums={"_limits": "_limit", "_weights": "_weight"})
    whole = placed.agg((F.sum("source_size") * F.lit(float(share))).alias("mix"), F.sum("_weight").alias("weight")).first()
    if whole["mix"] is None:
        return totals.withColumn("target", F.lit(0.0))
    full = F.col("_limits") + F.col("_level") * (F.lit(whole["weight"]) - F.col("_weights")) <= F.lit(whole["mix"])
    filled = stored(filled.withColumn("_full", full).drop("_range"))
    used = filled.filter("_full").agg(F.sum("_limit").alias("limit"), F.sum("_weight").alias("weight")).first()
    left = whole["weight"] - (used["weight"] or 0.0)
    level = (whole["mix"] - (used["limit"] or 0.0)) / left if left else 0.0
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.lit(level) * F.col("_weight")))
    return filled.select(*totals.columns, target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    quality: str | None = None, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, extra, taken): how many words the mix takes of each document.

    A document is taken ``epochs`` times whole and ``extra`` words besides: all of them, none, or, for the one document
    of a source at which its budget ends, the first words that are left.  So the words taken of a source are its target,
    rounded.  ``quality`` names a column of weights (see ``sized``); by default the share of distinct words counts.
    Keys depend on ids and seed, so reruns agree.  Equal keys go by id, then size.  A null source is a source like any
    other, the last one; documents without words take nothing; no rows give no rows.  Other columns are not looked at.

    A source's documents are dealt into cells of rising keys, about as many cells as documents in a cell.  Sums per cell
    find the one where the budget ends; only that cell is sorted.
    """
    rows = stored(sized(docs, quality, seed))
    totals = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"), F.avg(F.least(F.col("key"), F.lit(1e6))).alias("_mean")
    )
    budget = F.round("target").cast("long")
    plan = source_targets(stored(totals), weights, share, most).withColumn("_budget", budget)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("_rest", F.col("_budget") - F.col("epochs") * F.col("source_size"))
    plan = stored(plan.withColumn("_cells", F.ceil(F.sqrt("_rows"))).drop("_budget", "_rows"))

    def celled(known: DataFrame) -> DataFrame:
        known = known.withColumnRenamed("source", "_of")
        cell = F.floor(F.col("_cells") * (1 - F.exp(-F.col("key") / F.greatest(F.col("_mean"), F.lit(1e-300)))))
        return rows.join(known, same(F.col("source"), F.col("_of"))).withColumn("_cell", F.least(cell, F.col("_cells") - 1))

    sums = celled(plan.filter("_rest > 0")).groupBy("source", "_cell", "_rest").agg(F.sum("size").alias("_own"))
    upto = F.sum("_own").over(Window.partitionBy("source").orderBy("_cell"))
    ends = sums.withColumn("_upto", upto).filter("_upto >= _rest and _upto - _own < _rest")
    ends = ends.select(F.col("source").alias("_at"), F.col("_cell").alias("_end"), (F.col("_rest") - F.col("_upto") + F.col("_own")).alias("_left"))
    plan = stored(plan.join(ends, same(F.col("source"), F.col("_at")), "left").drop("_at"))
    placed = celled(plan)
    kept = [*rows.columns, "source_size", "target", "epochs"]
    away = placed.filter("_end is null or _cell <> _end")
    away = away.select(*kept, F.when(F.col("_cell") < F.col("_end"), F.col("size")).otherwise(0).alias("extra"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.filter("_cell = _end").withColumn("_before", F.sum("size").over(order) - F.col("size"))
    inside = inside.select(*kept, F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_before"))).alias("extra"))
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")
    return away.union(inside).select("doc_id", "source", "size", "source_size", "target", "epochs", F.col("extra").cast("long").alias("extra"), taken)
