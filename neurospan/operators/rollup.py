"""Weighted roll-ups of region values and group difference maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.functions.aggregates import weighted_mean

KEYS = ("subject_id", "ses")
ROLLUP_NETWORKS = {"SalVentAttn": "salience", "Cont": "control", "Default": "dmn"}  # fixed values


def attach_weights(values: DataFrame, shared: DataFrame, own: DataFrame | None = None,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Cortical regions take the weight shared by everyone, subcortical ones the key's own count."""
    out = values.join(shared.select("roi", F.col("weight").alias("shared_weight")), "roi", "left")
    if own is None:
        return out.withColumnRenamed("shared_weight", "weight")
    out = out.join(own.select(*keys, "roi", F.col("weight").alias("own_weight")), [*keys, "roi"], "left")
    weight = F.when(C.is_subcortical("roi"), F.col("own_weight")).otherwise(F.col("shared_weight"))
    return out.withColumn("weight", weight).drop("own_weight", "shared_weight")


def missing_weights(weighted: DataFrame) -> DataFrame:
    """Regions without a weight; must be empty before rolling up."""
    return weighted.where(F.col("weight").isNull()).select("roi").distinct()


def weighted_rollup(weighted: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                    prefix: str = "sfc") -> DataFrame:
    """Global, domain and network weighted means in one aggregation pass.

    A region with a known value and no weight is an error: dropping it would shift every mean without a word.
    """
    lost = F.col(value).isNotNull() & F.col("weight").isNull()
    message = F.concat(F.lit("no weight for region "), F.col("roi").cast("string"))
    checked = F.when(lost, F.raise_error(message).cast("double")).otherwise(F.col("weight"))
    weighted = weighted.withColumn("weight", checked)
    named = weighted.withColumn("_domain", C.domain("roi")).withColumn(
        "_network", F.when(~C.is_subcortical("roi"), C.network("roi"))
    )
    parts = [weighted_mean(value, "weight").alias(f"{prefix}_weighted_mean")]
    parts += [
        weighted_mean(value, "weight", F.col("_domain") == d).alias(f"{prefix}_{d}") for d in ("sensory", "hmod")
    ]
    parts += [
        weighted_mean(value, "weight", F.col("_network") == net).alias(f"{prefix}_{name}")
        for net, name in ROLLUP_NETWORKS.items()
    ]
    return named.groupBy(*keys).agg(*parts)


def visits_to_columns(rollup: DataFrame, sessions: dict[str, str], subject: str = "subject_id",
                      ses: str = "ses") -> DataFrame:
    """One row per subject with ``<measure>_<suffix>`` columns for the listed sessions."""
    measures = [c for c in rollup.columns if c not in (subject, ses)]
    cells = [
        F.max(F.when(F.col(ses) == name, F.col(m))).alias(f"{m}_{suffix}")
        for name, suffix in sessions.items()
        for m in measures
    ]
    return rollup.groupBy(subject).agg(*cells)


def pivot_regions(values: DataFrame, regions: Sequence, keys: Sequence[str] = KEYS, roi: str = "roi",
                  value: str = "value") -> DataFrame:
    """Subject x region table with an explicit region list (no extra job to find it)."""
    return values.groupBy(*keys).pivot(roi, list(regions)).agg(F.max(value))


def difference_map(values: DataFrame, flags: DataFrame, by: Sequence[str] = ("ses", "roi"),
                   subject: str = "subject_id", value: str = "rho", flag: str = "flag") -> DataFrame:
    """Mean Fisher z of group 1 minus group 0; subjects with an unknown flag take no part.

    ``flags`` has one row per subject, or per (subject, ses) from :func:`session_flags`.
    """
    z = F.atanh(value)
    on = [subject, "ses"] if "ses" in flags.columns else [subject]
    return (
        values.join(flags.select(*on, flag), on)
        .groupBy(*by)
        .agg(
            F.avg(F.when(F.col(flag) == 1, z)).alias("mean_1"),
            F.avg(F.when(F.col(flag) == 0, z)).alias("mean_0"),
        )
        .select(*by, (F.col("mean_1") - F.col("mean_0")).alias("difference"))
    )


def session_flags(people: DataFrame, label: str, sessions: dict[str, str], subject: str = "subject_id") -> DataFrame:
    """(subject, ses, flag): the longitudinal flag for both sessions, or each session's own.

    ``label`` is ``long`` or ``visit``; ``sessions`` maps session -> suffix of the flag column.
    """
    cells = [
        F.struct(F.lit(ses).alias("ses"), F.col("flag_long" if label == "long" else f"flag_{k}").alias("flag"))
        for ses, k in sessions.items()
    ]
    return people.select(subject, F.inline(F.array(*cells)))


def average_over_sessions(maps: DataFrame, roi: str = "roi") -> DataFrame:
    return maps.groupBy(roi).agg(F.avg("difference").alias("difference"))


def overlap_table(voxels: DataFrame, slots: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Resolve voxels claimed by several labels, working on label combinations, not voxels.

    ``slots`` are label columns whose non-zero ranges do not intersect.  Each
    distinct combination with two or more labels goes to the label that loses
    the largest share of its own voxels to it; the earlier slot wins ties.
    """
    keys = list(keys)
    combos = voxels.groupBy(*keys, *slots).agg(F.count(F.lit(1)).alias("n_overlap"))
    claims = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(s).alias("label")) for k, s in enumerate(slots)])
    long = combos.select(*keys, *slots, "n_overlap", F.inline(claims)).where("label <> 0")
    totals = long.groupBy(*keys, "slot", "label").agg(F.sum("n_overlap").alias("label_total"))
    share = F.col("n_overlap") * F.lit(100.0) / F.col("label_total")
    return (
        long.join(totals, [*keys, "slot", "label"])
        .withColumn("pct", share)
        .groupBy(*keys, *slots)
        .agg(
            F.max("n_overlap").alias("n_overlap"),
            F.count(F.lit(1)).alias("n_claims"),
            F.max("pct").alias("best_pct"),
            F.max_by("label", F.struct("pct", -F.col("slot"))).alias("label"),
        )
    )


def resolve_voxels(voxels: DataFrame, table: DataFrame, slots: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Final label of every voxel; background (no claim) is 0.

    A voxel with at most one claim keeps it, so the background and the plain
    voxels -- nearly all of them -- never take part in the join.
    """
    claims = sum(((F.col(s) != 0).cast("int") for s in slots), F.lit(0))
    total = sum((F.col(s) for s in slots), F.lit(0))
    on = [*keys, *slots]
    contested = voxels.where(claims > 1).join(table.where("n_claims > 1").select(*on, "label"), on)
    plain = voxels.where(claims <= 1).withColumn("label", total.cast(table.schema["label"].dataType))
    return plain.unionByName(contested)


def atlas_completeness(table: DataFrame, expected: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct labels left after overlap resolution; ``complete`` is false when some vanished."""
    return table.groupBy(*keys).agg(F.count_distinct("label").alias("n_labels")).withColumn(
        "complete", F.col("n_labels") == expected
    )
