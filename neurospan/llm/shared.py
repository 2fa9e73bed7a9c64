"""What several of these operators need: cut lineage, safe collects, row filters by id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests, notebooks) one beside the session's tables."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Store the rows in the shared checkpoint folder and go on from there; Spark removes them with the last reference."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_key(text: str = "text") -> Column:
    """Tells rows of one (or no) id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not among ``dropped`` (doc_id, text_key); a null id is an id of its own."""
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    met = same(docs["doc_id"], gone["_gone_id"]) & (text_key() == gone["_gone_key"])
    return docs.join(gone, met, "left_anti")


def free_name(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices with at most ``limit`` bytes in column ``text`` (or a single row).

    Arrow batches have a fixed number of rows, whatever these hold; a worker's memory should not follow the longest ones.
    """
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            before = int(sizes[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(a, b - a)
            a = b
        pa.default_memory_pool().release_unused()


def crc32_fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is hashed as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


#: Bits of a filter of hashes: 8 MB for any number of them.
FILTER_BITS = 1 << 26


def hash_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each 64-bit hash in ``column``: a filter of bounded size that lets all of these pass, and some others."""
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64-bit, signed or not) may be among those of the filter."""
    at = np.ascontiguousarray(hashes).view(np.int64) % (len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
