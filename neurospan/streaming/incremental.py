"""Incremental batches: store only what is not stored yet.

The study has no event streams; what it has is "work on subjects without a
stored result".  Result tables are Parquet folders partitioned by a hash bucket
of their key, so a batch reads and rewrites only the buckets it touches.  A table
that has outgrown its buckets is written again with more of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators.clean import pending
from neurospan.session import scratch_dir
from neurospan.sources.sinks import ROWS_PER_BUCKET, bucket_of, data_folder, grow_buckets, materialise, read_or_none, table_buckets

BUCKET = "_bucket"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    table = read_or_none(spark, data_folder(spark, path))
    return None if table is None else table.drop(BUCKET)


def only_new(new: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored; only key columns are read from the store."""
    old = read_or_none(new.sparkSession, data_folder(new.sparkSession, path))
    if old is None:
        return new
    return pending(new, old.select(*keys).distinct(), keys)


def _batch(new: DataFrame, path: str, keys: Sequence[str], buckets: int | None) -> tuple[DataFrame, list[int]]:
    """The batch, evaluated once and stored, with its buckets; and which buckets it touches (at most as many as there are)."""
    new = materialise(new, scratch_dir(new.sparkSession, "batch"))
    tagged = new.withColumn(BUCKET, bucket_of(keys, table_buckets(new, path, buckets)))
    return tagged, [r[0] for r in tagged.select(BUCKET).distinct().collect()]


def _write(rows: DataFrame, keys: Sequence[str], path: str, mode: str, rows_per_bucket: int) -> None:
    """A few writers per bucket, chosen by row hash, so one hot key is not one task and a bucket is a few files."""
    spark = rows.sparkSession
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != BUCKET]), F.lit(4))
    (
        rows.repartition(F.col(BUCKET), spread).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET).parquet(data_folder(spark, path))
    )
    grow_buckets(spark, path, keys, BUCKET, rows_per_bucket)


def append_new(new: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Idempotent append: running the same batch twice leaves the table unchanged.

    A key that the batch repeats is stored once.  Only the touched buckets' keys are read.
    """
    tagged, touched = _batch(new, path, keys, buckets)
    old = read_or_none(new.sparkSession, data_folder(new.sparkSession, path))
    fresh = tagged.dropDuplicates(list(keys))
    if old is not None:
        fresh = pending(fresh, old.where(F.col(BUCKET).isin(touched)).select(*keys).distinct(), keys)
    _write(fresh, keys, path, "append", rows_per_bucket)


def upsert(new: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None,
           rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Replace the rows of the keys in ``new`` and add the rest.

    Only the buckets that receive rows are read back and swapped in (dynamic
    partition overwrite stages the files before moving them).
    """
    tagged, touched = _batch(new, path, keys, buckets)
    old = read_or_none(new.sparkSession, data_folder(new.sparkSession, path))
    if old is not None:
        kept = old.where(F.col(BUCKET).isin(touched)).join(tagged.select(*keys).distinct(), list(keys), "left_anti")
        tagged = kept.select(*tagged.columns).unionByName(tagged)
    _write(tagged, keys, path, "overwrite", rows_per_bucket)


def append_log(events: DataFrame, path: str) -> None:
    """Run log as JSON lines: (script, cohort, session, step, n_successful, failed)."""
    events.write.mode("append").json(path)


def log_summary(log: DataFrame) -> DataFrame:
    """Counts per script, cohort, session and step with the grand total (rollup over all levels).

    Failed ids are counted here; list them with an explode when needed, so a
    script with very many failures never becomes one cell.
    """
    levels = ["script", "cohort", "session", "step"]
    return (
        log.rollup(*levels)
        .agg(F.sum("n_successful").alias("n_successful"), F.sum(F.size("failed")).alias("n_failed"),
             F.grouping_id().alias("level"))
        .where(F.col("level").isin(0, 15))
    )


def failed_subjects(log: DataFrame) -> DataFrame:
    return log.select("script", "cohort", "session", "step", F.explode("failed").alias("subject_id"))
