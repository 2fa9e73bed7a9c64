"""Row and group checks, eligibility funnels, motion filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.functions.aggregates import set_hash

FD_THRESHOLD_MM = 0.5  # fixed values
MAX_HIGH_MOTION_PERCENT = 30.0

ELIGIBLE = "eligible"


def first_failure(rules: Sequence[tuple[str, Column]], passed: str = ELIGIBLE) -> Column:
    """Name of the first rule whose condition holds; unknown conditions do not fire."""
    out = None
    for reason, failed in rules:
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out.otherwise(passed)


def funnel(df: DataFrame, rules: Sequence[tuple[str, Column]], keys: Sequence[str] = (),
           details: Mapping[str, Column] | None = None) -> DataFrame:
    """Count of rows per first failing reason (and of the eligible rest); ``details`` adds a rule's own text to its reason."""
    reason = first_failure(rules)
    out = reason
    for name, text in (details or {}).items():
        out = F.when(reason == name, F.concat(F.lit(f"{name}: "), text)).otherwise(out)
    return df.groupBy(*keys, out.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def split_valid(df: DataFrame, rules: Sequence[tuple[str, Column]], stage: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows with stage, reason and time) from one rule chain."""
    tagged = df.withColumn("reason", first_failure(rules))
    valid = tagged.where(F.col("reason") == ELIGIBLE).drop("reason")
    rejected = tagged.where(F.col("reason") != ELIGIBLE)
    return valid, rejected.withColumns({"stage": F.lit(stage), "logged_at": F.current_timestamp()})


def finite_array(c: Column | str) -> Column:
    """True when the array and all its values are known and finite."""
    known = F.forall(
        C.as_col(c), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    return F.coalesce(known, F.lit(False))


def signal_rules(n_labels: int, signal: str = "signal") -> list[tuple[str, Column]]:
    """Why a frame cannot be used: empty, wrong width, unreadable values."""
    return [
        ("empty", F.col(signal).isNull() | (F.size(signal) == 0)),
        ("wrong_width", F.size(signal) != n_labels),
        ("not_finite", ~finite_array(signal)),
    ]


def label_layout(labels: DataFrame, n_cortical: int, n_sub: int) -> DataFrame:
    """Check the label dictionary (roi_idx from 1, roi): count, numbering, hemisphere blocks."""
    half = n_cortical // 2
    idx = F.col("roi_idx")
    expected_side = (
        F.when(idx <= half, "LH").when(idx <= n_cortical, "RH")
        .when(idx <= n_cortical + n_sub // 2, "LH").otherwise("RH")
    )
    return labels.agg(
        (F.count(F.lit(1)) == n_cortical + n_sub).alias("count_ok"),
        ((F.min(idx) == 1) & (F.max(idx) == F.count_distinct(idx))).alias("numbering_ok"),
        (F.count_if(C.is_subcortical("roi") != (idx > n_cortical)) == 0).alias("blocks_ok"),
        (F.count_if(~C.hemisphere("roi").eqNullSafe(expected_side)) == 0).alias("sides_ok"),
    )


def label_sets(df: DataFrame, keys: Sequence[str], roi: str = "roi") -> DataFrame:
    """One order-free fingerprint of the region set per key."""
    return df.groupBy(*keys).agg(F.count_distinct(roi).alias("n_rois"), set_hash(roi).alias("roi_hash"))


def label_agreement(df: DataFrame, keys: Sequence[str], roi: str = "roi") -> DataFrame:
    """Do all keys carry the same region set?"""
    return label_sets(df, keys, roi).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_distinct("roi_hash").alias("n_distinct_sets"),
        F.min("n_rois").alias("min_rois"),
        F.max("n_rois").alias("max_rois"),
    )


def square_check(edges: DataFrame, keys: Sequence[str], row: str = "i", col: str = "j") -> DataFrame:
    """Row and column labels of a full matrix listing must be the same set."""
    ends = F.array(
        F.struct(F.lit(1).alias("is_row"), F.col(row).alias("label")),
        F.struct(F.lit(0).alias("is_row"), F.col(col).alias("label")),
    )
    seen = edges.select(*keys, F.inline(ends)).groupBy(*keys, "label").agg(
        F.max("is_row").alias("as_row"), F.max(1 - F.col("is_row")).alias("as_col")
    )
    return seen.groupBy(*keys).agg(
        F.sum("as_row").alias("n_rows"), F.sum("as_col").alias("n_cols"),
        (F.count_if(F.col("as_row") != F.col("as_col")) == 0).alias("labels_agree"),
    )


def motion_summary(frames: DataFrame, keys: Sequence[str], fd: str = "fd",
                   threshold: float = FD_THRESHOLD_MM, limit: float = MAX_HIGH_MOTION_PERCENT) -> DataFrame:
    """Mean displacement, percent of frames over the threshold, and the exclusion flag.

    An unreadable displacement counts as a still frame in the percentage.
    """
    high = F.coalesce((F.col(fd) > threshold).cast("int"), F.lit(0))
    pct = F.avg(high) * 100
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg(fd).alias("mean_fd"), pct.alias("pct_high"),
        (F.max(high) == 1).alias("needs_scrubbing"), (pct > limit).alias("exclude_motion"),
    )


def choose_source(candidates: DataFrame, need: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pick one file per key: the only scrubbed file where scrubbing is needed, else the original.

    ``candidates`` is (keys, path, kind in {original, scrubbed}); ``need`` is
    (keys, needs_scrubbing).  Anything else is rejected with a reason.
    """
    def kind(k: str) -> Column:
        return F.col("kind") == k

    counts = candidates.groupBy(*keys).agg(
        F.count_if(kind("scrubbed")).alias("n_scrubbed"), F.count_if(kind("original")).alias("n_original"),
        F.min(F.when(kind("scrubbed"), F.col("path"))).alias("scrubbed"),
        F.min(F.when(kind("original"), F.col("path"))).alias("original"),
    )
    joined = need.join(counts, list(keys), "left").na.fill(0, ["n_scrubbed", "n_original"])
    scrub = F.col("needs_scrubbing")
    reason = (
        F.when((F.col("n_scrubbed") == 0) & (F.col("n_original") == 0), "no source")
        .when(scrub & (F.col("n_scrubbed") != 1), "not exactly one scrubbed source")
        .when(~scrub & (F.col("n_original") == 0), "no original source")
    )
    path = F.when(reason.isNull(), F.when(scrub, F.col("scrubbed")).otherwise(F.col("original")))
    return joined.select(*keys, "needs_scrubbing", path.alias("chosen_path"), reason.alias("reject_reason"))


def work_list(subjects: DataFrame, sessions: Sequence[str], available: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Every subject x session with whether its input exists (missing ones are kept and counted)."""
    spine = subjects.select(subject).distinct().withColumn(
        "ses", F.explode(F.array(*[F.lit(s) for s in sessions]))
    )
    have = available.select(subject, "ses").distinct().withColumn("present", F.lit(True))
    return spine.join(have, [subject, "ses"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def name_map_audit(regions: DataFrame, mapping: Mapping[str, str], valid: Sequence[str], name: str = "name") -> DataFrame:
    """Status of each region name: mapped, unmapped, or mapped to a name the target does not know."""
    target = C.recode(F.lower(F.col(name)), {k.lower(): v for k, v in mapping.items()})
    status = F.when(target.isNull(), "unmatched").when(~target.isin(*valid), "invalid target").otherwise("ok")
    return regions.select(name).distinct().select(name, target.alias("target"), status.alias("status"))
