"""Region signals and streamlines -> edge tables -> structure-function coupling.

Connectivity lives in one long edge table ``(keys..., i, j, weight)`` with
``i < j``.  Dense matrices exist only inside bounded Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.functions.aggregates import safe_corr
from neurospan.functions.columns import edge_ends
from neurospan.operators.quality import finite_array
from neurospan.session import scratch_dir
from neurospan.sources.sinks import materialise

KEYS = ("subject_id", "ses")
Measure = Callable[[np.ndarray], tuple]

#: Frames per grouped-map call.  Bounds every Python group whatever the number
#: of frames one subject owns (512 frames x 414 regions is under 2 MB).
FRAME_BLOCK = 512


# --- region signals ----------------------------------------------------------------


def label_mean_series(voxels: DataFrame, keys: Sequence[str] = (*KEYS, "frame"), label: str = "label",
                      value: str = "value") -> DataFrame:
    """Mean signal of each non-background label per frame (partial sums before the shuffle)."""
    return voxels.where(F.col(label) != 0).groupBy(*keys, label).agg(F.avg(value).alias("mean_value"))


def voxel_counts(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Voxels per non-background label: the weights of the roll-ups."""
    return voxels.where(F.col(label) > 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_voxels"))


def incomplete_series(means: DataFrame, n_labels: int, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Keys that lost a label: their series must not be used."""
    return (
        means.groupBy(*keys).agg(F.count_distinct(label).alias("n_labels")).where(F.col("n_labels") < n_labels)
    )


def signal_moments(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key, from its block rows: frame count and the mean of every region.

    A key holding a frame that cannot be used, or frames of different widths, is left out (``unusable_signals`` lists
    it).  One row per (block, region) is summed with map-side partials; only p values per key become an array.
    """
    per_region = (
        blocks.select(*keys, "n_k", F.posexplode_outer("mean_k").alias("pos", "m"))
        .groupBy(*keys, "pos")
        .agg(F.sum("n_k").alias("n"), (F.sum(F.col("n_k") * F.col("m")) / F.sum("n_k")).alias("mean"))
    )
    usable = ~F.bool_or(F.col("pos").isNull()) & (F.min("n") == F.max("n"))
    return (
        per_region.groupBy(*keys)
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("r"), usable.alias("usable"))
        .where("usable").select(*keys, "n", F.col("r.mean").alias("mean"))
    )


def unusable_signals(series: DataFrame, keys: Sequence[str] = KEYS, signal: str = "signal") -> DataFrame:
    """Keys that connectivity leaves out, with the number of their frames and of the unusable ones.

    A frame is unusable if it is NULL or empty or holds a NULL or non-finite value; a key also if its frames differ in width.
    """
    bad = F.col(signal).isNull() | (F.size(signal) == 0) | ~finite_array(signal)
    width = F.when(~bad, F.size(signal))
    return (
        series.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(bad).alias("n_bad"), F.min(width).alias("min_width"), F.max(width).alias("max_width"))
        .where((F.col("n_bad") > 0) | (F.col("min_width") != F.col("max_width")))
    )


def _co_moments(x: np.ndarray) -> tuple:
    """Of one block of frames: mean, cross products above the diagonal, squares, sum of |z|^2 z, sum of |z|^4."""
    mean = x.mean(axis=0)
    z = x - mean
    sq = np.einsum("ij,ij->i", z, z)
    cross = z.T @ z
    return mean, cross[np.triu_indices(len(mean), k=1)], np.diag(cross), sq @ z, float(sq @ sq)


def _signals(column: pa.ChunkedArray | pa.Array) -> np.ndarray | None:
    """Frames as a matrix; None if one is missing, of another width, or holds an unknown or non-finite value."""
    merged = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = merged.flatten()
    widths = merged.value_lengths().to_numpy(zero_copy_only=False)
    if merged.null_count or values.null_count or not len(values) or (widths != widths[0]).any():
        return None
    x = values.to_numpy(zero_copy_only=False).astype("float64").reshape(len(merged), -1)
    return x if np.isfinite(x).all() else None


def _moment_schema(series: DataFrame, keys: Sequence[str]) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    fields = [T.StructField(k, series.schema[k].dataType) for k in keys]
    fields += [T.StructField("n_k", T.LongType())]
    fields += [T.StructField(c, numbers) for c in ("mean_k", "cross_k", "square_k", "skew_k")]
    fields += [T.StructField("quart_k", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("failed_at", T.TimestampType())]
    return T.StructType(fields)


UNUSABLE = "frames are missing, of different widths, or not finite"


def _moment_row(frames: pa.ChunkedArray | pa.Array, key: Sequence, measure: Measure) -> list:
    """A block that is unusable or raises has no moments, which takes its key out of the result; it says why and when."""
    try:
        x = _signals(frames)
        found, error = (None, UNUSABLE) if x is None else (measure(x), None)
    except Exception as e:  # noqa: BLE001 - whatever a block raises must not end the other keys
        found, error = None, f"{type(e).__name__}: {e}"
    when = None if error is None else datetime.now(timezone.utc)
    return [*key, len(frames), *([None] * 5 if found is None else found), error, when]


def _moment_table(rows: list[list], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True))
    return pa.table([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=list(names))


def block_moments(series: DataFrame, keys: Sequence[str] = KEYS, signal: str = "signal",
                  frame: str = "frame", clustered: bool = False, measure: Measure = _co_moments) -> DataFrame:
    """Co-moment matrices of bounded blocks of frames.

    ``measure`` computes them from a matrix of frames.  An exception inside a block does not end the job: the block has
    no moments, and ``error`` and ``failed_at`` instead.

    ``clustered=True``: the input already stores each key's frames together (one
    file or sorted run per key), so the work happens in scan order without any
    shuffle of frames.  Otherwise frames are grouped by (key, frame block); a key
    owning a third of all frames is spread over its many blocks.
    """
    schema = _moment_schema(series, keys)
    names = schema.fieldNames()
    arrow = [f.type for f in _arrow_schema(schema)]

    if clustered:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                frame_keys = batch.select(list(keys)).to_pandas()
                rows = [
                    _moment_row(batch.column(signal).take(pa.array(idx)),
                                key if isinstance(key, tuple) else (key,), measure)
                    for key, idx in frame_keys.groupby(list(keys), sort=False, dropna=False).indices.items()
                ]
                if rows:
                    yield from _moment_table(rows, names, arrow).to_batches()

        return series.select(*keys, signal).mapInArrow(scan, schema)

    def per_block(key: tuple, block: pa.Table) -> pa.Table:
        values = [k.as_py() for k in key[: len(keys)]]
        return _moment_table([_moment_row(block.column(signal), values, measure)], names, arrow)

    return (
        series.select(*keys, F.floor(F.col(frame) / FRAME_BLOCK).alias("block"), signal)
        .groupBy(*keys, "block")
        .applyInArrow(per_block, schema)
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def stored_moments(series: DataFrame, keys: Sequence[str] = KEYS, signal: str = "signal", frame: str = "frame",
                   clustered: bool = False, measure: Measure = _co_moments) -> DataFrame:
    """``block_moments`` computed once: totals, re-centring and error reports read them from there."""
    return materialise(block_moments(series, keys, signal, frame, clustered, measure), scratch_dir(series.sparkSession, "blocks"))


def failed_blocks(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., reason, failed_at, n_blocks): the keys that left no result, with their first reason in text order."""
    return blocks.where(F.col("error").isNotNull()).groupBy(*keys).agg(
        F.min("error").alias("reason"), F.min("failed_at").alias("failed_at"), F.count(F.lit(1)).alias("n_blocks")
    )


def pair_covariances(blocks: DataFrame, keys: Sequence[str] = KEYS, fourth: bool = False) -> DataFrame:
    """Population covariance of every region pair: ``(keys..., i, j, n, cov, var_i, var_j[, fourth])``.

    ``blocks`` are stored co-moments.  Keys with a block that has none (see ``failed_blocks``) give no rows.
    Block co-moments are re-centred on the key's own means (so no precision is
    lost to large signal offsets), spread to one row per pair by a generator and
    summed with map-side combining, all in generated code.  ``fourth`` summed
    over a key's pairs is the mean of |z|^4, needed by the shrinkage estimate.
    """
    met = blocks.join(signal_moments(blocks, keys), list(keys))
    centred = met.withColumn("d", F.zip_with("mean_k", "mean", lambda a, b: a - b))
    extra = []
    if fourth:
        # |z|^4 of the block about the key's mean; its cross terms are added pair by pair below
        def total(e: Column) -> Column:
            return F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)

        dd = total(F.transform("d", lambda v: v * v))
        centred = centred.withColumn("quart", F.col("quart_k") + 4 * total(F.zip_with("d", "skew_k", lambda a, b: a * b))
                                     + 4 * total(F.zip_with("d", "square_k", lambda a, b: a * a * b))
                                     + 2 * dd * total(F.col("square_k")) + F.col("n_k") * dd * dd)
        extra = ["quart"]
    spread = centred.select(*keys, "n", "n_k", "d", "square_k", *extra, F.posexplode("cross_k").alias("pos", "c"))
    # row-major position above the diagonal -> (i, j)
    odd = 2 * F.size("d") - 1
    i = F.floor((odd - F.sqrt((odd * odd - 8 * F.col("pos")).cast("double"))) / 2).cast("int")
    j = F.col("pos") - (F.col("i") * (odd - F.col("i")) / 2).cast("int") + F.col("i") + 1
    shift = F.get("d", F.col("i")) * F.get("d", F.col("j"))
    sums = [F.sum((F.col("c") + F.col("n_k") * shift) / F.col("n")).alias("cov")]
    if fourth:
        first = F.when(F.col("pos") == 0, F.col("quart")).otherwise(0.0)
        sums.append(F.sum((first + 8 * shift * F.col("c")) / F.col("n")).alias("fourth"))

    def variance(end: str) -> Column:
        off = F.get("d", F.col(end))
        return F.sum((F.get("square_k", F.col(end)) + F.col("n_k") * off * off) / F.col("n")).alias(f"var_{end}")

    return (
        spread.withColumn("i", i).withColumn("j", j.cast("int"))
        .groupBy(*keys, "i", "j")
        .agg(F.max("n").alias("n"), variance("i"), variance("j"), *sums)
    )


def unit(r: Column) -> Column:
    """A correlation within rounding noise of a perfect one (two points, say) becomes exactly +-1."""
    return F.when(F.abs(r) > 1 - 1e-12, F.signum(r)).otherwise(r)


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def functional_edges(series: DataFrame, keys: Sequence[str] = KEYS, signal: str = "signal",
                     frame: str = "frame", clustered: bool = False) -> DataFrame:
    """Pearson correlation of every region pair, with its Fisher z."""
    return edges_of(stored_moments(series, keys, signal, frame, clustered), keys)


def edges_of(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``functional_edges`` from stored co-moments."""
    r = F.try_divide(F.col("cov"), F.sqrt(F.col("var_i") * F.col("var_j")))
    return pair_covariances(blocks, keys).select(
        *keys, "i", "j", unit(r).alias("r")
    ).withColumn("z", fisher_z(F.col("r")))


def functional_edges_shrunk(series: DataFrame, keys: Sequence[str] = KEYS, signal: str = "signal",
                            frame: str = "frame", clustered: bool = False) -> DataFrame:
    """Correlation from the Ledoit-Wolf (2004) shrunk covariance of each key's frames.

    The trace and the squared norm are sums over the key's own pairs -- at most
    p(p-1)/2 rows whatever the number of frames -- so a window per key serves and
    the signals are processed once.
    """
    keys = list(keys)
    own = Window.partitionBy(*keys)

    def over_pairs(e: Column) -> Column:
        return F.sum(e).over(own)

    pairs = pair_covariances(stored_moments(series, keys, signal, frame, clustered), keys, fourth=True).select(
        "*",
        over_pairs(F.lit(1.0)).alias("m"),
        over_pairs(F.col("var_i") + F.col("var_j")).alias("sum_var"),
        over_pairs(F.col("var_i") * F.col("var_i") + F.col("var_j") * F.col("var_j")).alias("sum_var2"),
        over_pairs(2 * F.col("cov") * F.col("cov")).alias("off2"),
        over_pairs(F.col("fourth")).alias("q"),
    )
    # every region is in p - 1 of the m = p(p-1)/2 pairs
    p, others = F.col("p"), F.col("p") - 1
    fitted = (
        pairs.withColumn("p", (1 + F.sqrt(1 + 8 * F.col("m"))) / 2)
        .withColumns({"mu": F.col("sum_var") / others / p, "fro2": F.col("off2") + F.col("sum_var2") / others})
        .withColumn("delta2", (F.col("fro2") - p * F.col("mu") * F.col("mu")) / p)
        .withColumn("beta2", F.least((F.col("q") - F.col("fro2")) / (p * F.col("n")), F.col("delta2")))
        .withColumn("rho", F.coalesce(F.try_divide(F.col("beta2"), F.col("delta2")), F.lit(0.0)))
    )
    keep = 1 - F.col("rho")

    def shrunk(var: str) -> Column:
        return keep * F.col(var) + F.col("rho") * F.col("mu")

    r = F.try_divide(keep * F.col("cov"), F.sqrt(shrunk("var_i") * shrunk("var_j")))
    return (
        fitted.select(*keys, "i", "j", "rho", r.alias("r"))
        .withColumn("z", fisher_z(F.col("r")))
    )


def regions_subset(series: DataFrame, subsets: Mapping[str, Sequence[int]], keys: Sequence[str] = KEYS,
                   signal: str = "signal", frame: str = "frame") -> DataFrame:
    """One series per named subset of region positions (network, all subcortical, bilateral pair).

    Shrinkage depends on the subset, so a subset's connectivity must be
    re-estimated from its own series instead of filtered from the full result.
    """
    members = F.array(*[
        F.struct(F.lit(name).alias("subset"), F.array(*[F.lit(int(i)) for i in idx]).alias("idx"))
        for name, idx in subsets.items()
    ])
    return (
        series.select(*keys, frame, signal, F.inline(members))
        .select(*keys, "subset", frame,
                F.transform("idx", lambda i: F.get(signal, i)).alias(signal))
    )


def edges_within(edges: DataFrame, region_group: DataFrame, group: str = "network") -> DataFrame:
    """Keep edges whose two ends share ``group``; ``region_group`` is (roi, group), one row per region.

    The groups are an atlas' worth, so they travel as one map and the edges are not shuffled.
    """
    entries = F.collect_list(F.when(F.col(group).isNotNull(), F.struct("roi", group)))
    packed = region_group.select("roi", group).distinct().agg(F.map_from_entries(entries)).scalar()
    named = edges.withColumn("_groups", packed)
    ends = [F.try_element_at("_groups", F.col(e)) for e in ("i", "j")]
    return named.withColumn(group, ends[0]).where(ends[0] == ends[1]).drop("_groups")


# --- structural connectivity ----------------------------------------------------------


def connections(streamlines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., node_a, node_b, weight, n): streamlines counted per pair of ends and stored, at most an atlas squared per key.

    Edges, node volumes and shared weights are sums over these rows, so the streamlines themselves are read once.
    """
    summed = streamlines.groupBy(*keys, "node_a", "node_b").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return materialise(summed, scratch_dir(streamlines.sparkSession, "connections"))


def structural_edges(streamlines: DataFrame, node_volumes: DataFrame, keys: Sequence[str] = KEYS, count: str | None = None) -> DataFrame:
    """Sum of streamline weights per unordered node pair, scaled by 2 / (volume_a + volume_b).

    Streamlines collapse to one row per pair first (map-side), and only that
    bounded result meets the volumes.  Unassigned ends (NULL) and self loops drop.
    ``count`` names the number of streamlines of a row of ``connections``.
    """
    keys = list(keys)
    summed = (
        streamlines.where(F.col("node_a") != F.col("node_b"))
        .groupBy(*keys, F.least("node_a", "node_b").alias("i"), F.greatest("node_a", "node_b").alias("j"))
        .agg(F.sum("weight").alias("raw_weight"), F.sum(F.col(count) if count else F.lit(1)).alias("n_streamlines"))
    )
    # one row per key with its node volumes (an atlas' worth), so the edges move once
    packed = node_volumes.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("node", "volume"))).alias("volumes")
    )
    va, vb = (F.try_element_at("volumes", F.col(e)) for e in ("i", "j"))
    return (
        summed.join(packed, keys).where(va.isNotNull() & vb.isNotNull())
        .select(*keys, "i", "j", "n_streamlines", F.try_divide(F.col("raw_weight") * 2, va + vb).alias("weight"))
    )


# --- shape changes --------------------------------------------------------------------


def mirror(edges: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = ("weight",)) -> DataFrame:
    """Both directions of every edge as (keys..., roi, partner, values...)."""
    both = F.array(
        F.struct(F.col("i").alias("roi"), F.col("j").alias("partner")),
        F.struct(F.col("j").alias("roi"), F.col("i").alias("partner")),
    )
    return edges.select(*keys, F.inline(both), *values)


def matrix_rows(edges: DataFrame, regions: DataFrame, keys: Sequence[str] = KEYS, value: str = "weight") -> DataFrame:
    """Symmetric matrix, one row per (key, roi): partner-ordered values with a zero diagonal.

    ``regions`` is (roi) -- one row per region; absent edges are zero.
    """
    order = regions.agg(F.array_sort(F.collect_set("roi")).alias("o"))
    filled = mirror(edges, keys, (value,)).groupBy(*keys, "roi").agg(
        F.map_from_entries(F.collect_list(F.struct("partner", value))).alias("m")
    )
    with_order = filled.withColumn("o", order.scalar())
    return with_order.select(
        *keys, "roi",
        F.transform("o", lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("row"),
    )


def wide_edges(edges: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS, edge: str = "edge",
               value: str = "weight") -> DataFrame:
    """One row per key, one column per named edge; for export of a chosen list only."""
    return edges.groupBy(*keys).pivot(edge, list(names)).agg(F.max(value))


def edges_from_wide(wide: DataFrame, keys: Sequence[str] = KEYS, value: str = "weight") -> DataFrame:
    """Back from ``roi1-roi2`` columns to the long edge table."""
    long = wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "edge", value)
    i, j = edge_ends("edge")
    return long.where(F.col(value).isNotNull()).select(*keys, i.alias("i"), j.alias("j"), value)


# --- coupling ------------------------------------------------------------------------


def coupling(structural: DataFrame, functional: DataFrame, keys: Sequence[str] = KEYS,
             sc: str = "weight", fc: str = "z") -> DataFrame:
    """Per region: correlation of its SC and FC profiles over partners where both are non-zero.

    The inner join already drops absent (zero) SC edges.  ``rho`` is NULL with
    fewer than two shared partners or a constant profile.
    """
    keys = list(keys)
    joined = structural.select(*keys, "i", "j", F.col(sc).alias("sc")).join(
        functional.select(*keys, "i", "j", F.col(fc).alias("fc")), [*keys, "i", "j"]
    ).where((F.col("sc") != 0) & (F.col("fc") != 0))
    return (
        mirror(joined, keys, ("sc", "fc"))
        .groupBy(*keys, "roi")
        .agg(unit(safe_corr("sc", "fc")).alias("rho"), F.count(F.lit(1)).alias("n_partners"))
        .withColumn("rho_z", fisher_z(F.col("rho")))
    )


def node_strength(edges: DataFrame, regions: DataFrame, keys: Sequence[str] = KEYS,
                  value: str = "weight", subjects: DataFrame | None = None) -> DataFrame:
    """Row mean without the diagonal; edges absent from the table count as zero.

    Zeros never need to be materialised: the mean is sum / (regions - 1).  ``subjects`` (one row per key) adds the keys
    that have no edge at all, with zeros for every region.
    """
    listed = regions.agg(F.array_sort(F.collect_set("roi")).alias("o")).scalar()
    totals = mirror(edges, keys, (value,)).groupBy(*keys, "roi").agg(F.sum(value).alias("total"))
    # one entry per region, so the map is bounded by the atlas
    per_key = totals.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("roi", "total"))).alias("m")
    )
    if subjects is not None:
        per_key = subjects.select(*keys).distinct().join(per_key, list(keys), "left").withColumn(
            "m", F.coalesce("m", F.create_map().cast(per_key.schema["m"].dataType))
        )
    per_key = per_key.withColumn("listed", listed)
    return per_key.select(
        *keys, "m", (F.size("listed") - 1).cast("double").alias("others"), F.explode("listed").alias("roi")
    ).select(
        *keys, "roi",
        F.try_divide(F.coalesce(F.try_element_at("m", F.col("roi")), F.lit(0.0)), F.col("others")).alias("strength"),
    )


def group_mean_edges(edges: DataFrame, by: Sequence[str] = ("i", "j"), value: str = "weight") -> DataFrame:
    """Element-wise mean over subjects, ignoring NULL."""
    return edges.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_subjects"))
