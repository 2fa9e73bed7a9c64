"""Bounded samples of rows to fit a model on; everything else reads all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_ids(ids: DataFrame, rows: int, by: str | None = None) -> DataFrame:
    """At most ``rows`` ids (per value 0 and 1 of ``by``, if given), picked by hash: the same at every partitioning."""
    ids = ids.select("doc_id", *([by] if by else [])).filter("doc_id is not null")
    order = F.xxhash64(F.lit(7), "doc_id")
    if by is None:
        return ids.distinct().orderBy(order, "doc_id").limit(rows)
    parts = [ids.filter(F.col(by) == v).orderBy(order, "doc_id").limit(rows) for v in (0, 1)]
    return parts[0].union(parts[1])


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` for a bounded list of ids.  The list is broadcast: its size is the bound of the sample."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def one_label(labels: DataFrame, name: str, keep: Column) -> DataFrame:
    """One known label per id among the rows ``keep``; of several the largest."""
    known = labels.filter(keep & F.col(name).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(name).cast("int").alias(name))
