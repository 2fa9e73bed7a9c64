"""Benchmark decontamination: containment search with size-partitioned MinHash sketches, verified by exact shingles.

An item counts as found in a document when the document holds at least ``threshold`` of the item's word shingles.  Of an
item with n distinct shingles at most (1 - threshold) * n may be missing, so of any floor((1 - threshold) * n) + 1 of
them at least one is there.  The sketch of an item is that many of its smallest hash values; items are partitioned by
size (powers of two) and each partition has the sketch length that its largest size needs.  A document is probed with
all its shingles whatever its length, so no pair is missed; candidates are then checked on the shingles themselves.

Sketches are a table of hashes, joined with the documents' hashes by Spark; no text of an item passes the driver.  A
filter of bounded size keeps shingles that no sketch holds from being dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.llm.shared import hash_filter, passes, pieces, same, stored, text_key, without

WORDS, THRESHOLD = 5, 0.8
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int = WORDS) -> list[bytes]:
    """Runs of ``size`` words; a shorter text is one run, a text without words has none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each shingle, from the hashes of its words."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words)) or 1
    mix = [_MIX[j % len(_MIX)] + np.uint64(2 * (j // len(_MIX))) for j in range(size)]
    n = len(words) - size + 1 if words else 0
    out = np.full(max(n, 0), size, np.uint64)
    for j in range(size if n > 0 else 0):
        out += h[j : j + n] * mix[j]
    return out ^ (out >> np.uint64(29))


def sketch(text: str | None, threshold: float = THRESHOLD, size: int = WORDS) -> np.ndarray:
    """The smallest hashes of an item's shingles, as many as its size partition needs; none for a text without words."""
    words = words_of(text)
    known = len(set(shingles(words, size)))
    largest = (1 << known.bit_length()) - 1  # of the item's size partition
    return np.unique(_hashes(words, size))[: int((1 - threshold) * largest + 1e-9) + 1 if known else 0]


def _hash_rows(df: DataFrame, keep: list[str], hashes) -> DataFrame:
    """(keep..., hash): a row for each hash of the text, which is the last column."""
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(keep)):
            found = [hashes(t) for t in batch.column(len(keep)).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(h) for h in found]))
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(row) for k in range(len(keep))], pa.array(flat)], names=[*keep, "hash"])

    return df.select(*keep, "text").mapInArrow(run, T.StructType([*fields, T.StructField("hash", T.LongType())]))


def _candidates(docs: DataFrame, items: DataFrame, threshold: float, size: int) -> DataFrame:
    """(of_id, of_key, item_row): documents that share a sketch hash with an item."""
    sketches = stored(_hash_rows(items, ["item_row"], lambda t: sketch(t, threshold, size)))
    bits = hash_filter(sketches, "hash")

    def probed(text: str | None) -> np.ndarray:
        found = np.unique(_hashes(words_of(text), size))
        return found[passes(bits, found)]

    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    met = _hash_rows(keyed, ["doc_id", "text_key"], probed).join(sketches.withColumnRenamed("hash", "of_hash"), F.col("hash") == F.col("of_hash"))
    return stored(met.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "item_row").distinct())


def _verified(docs: DataFrame, items: DataFrame, threshold: float, size: int) -> DataFrame:
    """(doc_id, text_key, item_id, shared, item_shingles) of every item contained in a document."""
    items = stored(items.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "text"))
    found = _candidates(docs, items, threshold, size)
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    met = keyed.join(found, same(F.col("doc_id"), F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    item = items.select(F.col("item_row").alias("of_row"), "item_id", F.col("text").alias("item_text"))
    met = met.join(item, F.col("item_row") == F.col("of_row")).select("doc_id", "text_key", "item_id", "text", "item_text")
    schema = T.StructType([*met.schema.fields[:3], T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, hashes = None, [], np.zeros(0, np.uint64)
        for batch in pieces(batches, 3):
            keep, counts, sizes = [], [], []
            for text, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if text != last:
                    last, words = text, words_of(text)
                    hashes = _hashes(words, size)
                known = set(shingles(words_of(item), size))
                places = np.flatnonzero(np.isin(hashes, _hashes(words_of(item), size)))
                run_length = min(size, len(words))
                shared = len(known.intersection(b" ".join(words[p : p + run_length]) for p in places.tolist()))
                keep.append(shared >= threshold * len(known) - 1e-9)
                counts.append(shared)
                sizes.append(len(known))
            columns = [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames()).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every item contained in a document.

    Repeated rows on either side give repeated pairs.  Null and wordless texts contain nothing and are in nothing.  A
    text of fewer than ``size`` words is one shingle, so a short item is found only in a document that is the same
    words.  Empty tables give no rows.  Other columns are not looked at.
    """
    found = _verified(docs, items, threshold, size)
    return found.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """``docs`` without the documents that contain an item; columns unchanged."""
    return without(docs, stored(_verified(docs, items, threshold, size).select("doc_id", "text_key").distinct()))
