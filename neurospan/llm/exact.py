"""Exact dedup by content-defined chunk recipes, in DataFrame expressions only.

A text is cut where the two letters before a sentence or line end fall in fixed classes.  The place depends on the text
around it only, so behind an insertion the cuts fall back into place and equal passages share their chunks.  Each distinct chunk gets an identifier; identifiers are verified by comparing the texts of all distinct chunks once.  Texts
are equal exactly when their ordered identifier lists are, and only those lists are grouped and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurospan.llm.shared import cut, same, text_key, without

#: Fewest characters before a cut, and the length at which a chunk without a cut ends.
LEAST_CHARS, MOST_CHARS = 128, 8192
#: About every fourth sentence end is a cut.
CUT = "[a-m][n-z][.!?\\n]"


def chunks(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    """Content-defined chunks of a text, in order; together they are the text. An empty text has none."""
    pattern = f"(?s).{{{least},{most - 3}}}?{CUT}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _distinct_chunks(docs: DataFrame, label: Callable[[Column], Column]) -> DataFrame:
    pieces = docs.select(F.explode(chunks(F.coalesce(F.col("text"), F.lit("")))).alias("chunk"))
    return pieces.select(label(F.col("chunk")).alias("label"), "chunk").distinct()


def recipes(docs: DataFrame, label: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_key, text_sha256, recipe): the ordered verified identifiers of each text's chunks.

    The identifier of a chunk is its 64-bit label.  Labels are verified first: every distinct (label, chunk) pair meets
    its label's other pairs.  Where different chunks share a label, the chunks of those labels are numbered and the
    number becomes part of the identifier, so two chunks have one identifier only if their texts are equal.
    """
    docs = docs.select("doc_id", text_key().alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shared = cut(_distinct_chunks(docs, label).groupBy("label").count().filter("count > 1").select("label"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    if shared.isEmpty():
        return docs.select("doc_id", "text_key", digest, F.transform(chunks(F.col("text")), lambda c: label(c)).alias("recipe"))
    # rare: labels that several chunks share. Only documents holding one are taken apart and joined.
    named = (
        _distinct_chunks(docs, label).join(shared, "label", "left_semi")
        .withColumn("variant", F.row_number().over(Window.partitionBy("label").orderBy("chunk")))
        .withColumnRenamed("chunk", "known")
    )
    rows = docs.withColumn("text_sha256", digest)
    parts = rows.select("text_sha256", F.posexplode_outer(chunks(F.col("text"))).alias("pos", "chunk"))
    parts = parts.withColumn("part_label", label(F.col("chunk")))
    joined = parts.join(named, (F.col("part_label") == F.col("label")) & (F.col("chunk") == F.col("known")), "left")
    name = F.concat_ws(":", F.col("part_label").cast("string"), F.coalesce(F.col("variant"), F.lit(0)).cast("string"))
    lists = joined.filter("pos is not null").groupBy("text_sha256").agg(
        F.sort_array(F.collect_set(F.struct("pos", name.alias("name")))).alias("named")
    )
    lists = lists.select(F.col("text_sha256").alias("of_text"), F.col("named.name").alias("recipe"))
    return rows.join(lists, F.col("text_sha256") == F.col("of_text"), "left").select(
        "doc_id", "text_key", "text_sha256", F.coalesce("recipe", F.slice(F.array(F.lit("")), 1, 0)).alias("recipe")
    )


def exact_groups(docs: DataFrame, label: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256, text_key).

    Of documents with equal texts the one with the largest ``doc_id`` stays.  A null text counts as empty, and empty
    texts are equal to each other.  Rows repeated under one ``doc_id`` count in ``group_size`` and share their decision;
    a null ``doc_id`` stays only if its whole group has none.  Other columns of ``docs`` are not looked at.
    """
    listed = cut(recipes(docs, label))
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # stored, so that both sides of the join are dealt anew and Spark can split the partition of a large group
    copies = cut(groups.filter("group_size > 1")).withColumnRenamed("recipe", "of_recipe")
    out = listed.join(copies, F.col("recipe") == F.col("of_recipe"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        same(F.col("doc_id"), keep).alias("kept"), "text_sha256", "text_key",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies that ``exact_groups`` drops; columns unchanged."""
    return without(docs, exact_groups(docs).filter(~F.col("kept")))
