"""Near-duplicates by exact similarity of word shingles.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8.  Candidates come
from the SimHash operator (fingerprints of the same shingles in BK-trees) and from independent MinHash bands, because
fingerprints alone are too coarse at 0.8.  Every link is then decided on the whole sets.

A pair at the threshold agrees in 20 of the 48 bands on average, in fewer than three with a chance of 6e-9.  So pairs are
taken from buckets of a few texts if they meet in three of them; a pair that meets in a larger bucket belongs to the group
of texts that larger buckets connect.  Such a group is described by a core, the shingles most of
its texts hold, and each text x by its difference D(x) from the core.  Similarity s means that the symmetric difference
of two sets is at most the share (1 - s) / (1 + s) of their sizes, and the symmetric difference of the sets is that of
their differences.  With slack(x) = |D(x)| - share * |x|, texts whose slacks add up to no more than zero are linked
without looking, and all of these are linked to the text with the least slack: one star.  What a star leaves of a group
is dealt out in pairs of blocks, each of which is compared in one task by an index of its shingles; a text goes to as
many tasks as there are blocks, a bounded number.  In a group too large for that any other linked pair shares
at least half the sum of its slacks in shingles of D, hence one of the rarest few of each: these shingles make smaller
groups with cores of their own.  No table holds all pairs of a group, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurospan.llm import simhash
from neurospan.llm.components import components
from neurospan.llm.decontaminate import _hashes, words_of
from neurospan.llm.shared import cut, hash_filter, passes, pieces, same, stored, text_key, without

WORDS, SIMILARITY = 5, 0.8
#: Minima in a band, bands, and bands in which a pair of texts must agree: at 0.8 a band agrees with 0.8 ** 4 = 0.41.
BAND_ROWS, BANDS, LEAST_BANDS = 4, 48, 3
#: Texts of a bucket or group that is compared pair by pair.
FEW = 8
#: Texts of a group that is compared in pairs of blocks, and of a block (about, they are dealt by hash).
WHOLE, BLOCK = 4096, 256
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_FLIP, _FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)
_SLICE = 256


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; a text of fewer words is one shingle, one without words none."""
    return np.unique(_hashes(words_of(text), words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; texts without words share theirs."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _FACTOR[0]
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE, None]
        least = np.minimum(least, (((part ^ (part >> np.uint64(31))) ^ _FLIP) * _FACTOR).min(axis=0))
    mixed = ((least ^ (least >> np.uint64(29))) * _FLIP).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)
    mixed += np.arange(BANDS, dtype=np.uint64) * _FACTOR[1]
    return mixed ^ (mixed >> np.uint64(32))


def is_similar(one: np.ndarray, other: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Jaccard similarity of two sets; two empty sets are equal."""
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared >= similarity * (len(one) + len(other) - shared) - 1e-9


def _banded(nodes: DataFrame, words: int) -> DataFrame:
    """(node, key): the band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            keys = np.concatenate([band_keys(shingle_set(t, words)) for t in batch.column(1).to_pylist()])
            row = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(keys.view(np.int64))], names=["node", "key"])

    return nodes.select("node", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "node bigint, key bigint")


def _sets(nodes: DataFrame, words: int) -> DataFrame:
    """(node, size, diff): the shingle set of each text, which is its difference from an empty core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            diff = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), diff], names=["node", "size", "diff"])

    rows = nodes.select("node", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "node bigint, size int, diff array<bigint>")


def _candidates(nodes: DataFrame, words: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to be compared, and groups (node, root) that hold all other partners of their members."""
    prints = simhash.near_groups(nodes.select(F.col("node").alias("doc_id"), "text"), words=words)
    prints = prints.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).filter("a < b")
    banded = stored(_banded(nodes, words))
    buckets = banded.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # stored, so that both sides of the join are dealt anew and Spark can split the partition of a large bucket
    buckets = cut(buckets).select(F.col("key").alias("of_key"), "low", "n")
    bits = hash_filter(buckets, "of_key")  # most keys belong to a single text and need not be dealt again

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column(1).to_numpy())))

    met = cut(banded.mapInArrow(shared, banded.schema).join(buckets, F.col("key") == F.col("of_key")).select("key", "node", "low", "n"))
    small = met.filter(F.col("n") <= few)
    other = small.select(F.col("key").alias("of_key"), F.col("node").alias("b"))
    pairs = small.join(other, (F.col("key") == F.col("of_key")) & (F.col("node") < F.col("b"))).groupBy(F.col("node").alias("a"), "b").count()
    pairs = pairs.filter(F.col("count") >= LEAST_BANDS).select("a", "b").union(prints).distinct()
    large = met.filter((F.col("n") > few) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b"))
    return cut(pairs), cut(components(large.distinct()))


def _share(similarity: float) -> float:
    return (1 - similarity) / (1 + similarity)


def _linked(pairs: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The pairs (path, a, b) whose texts are similar, decided on their differences from one core, as (a, b)."""
    one = rows.select(F.col("path").alias("a_path"), F.col("node").alias("a_node"), F.col("size").alias("a_size"), F.col("diff").alias("a_diff"))
    other = rows.select(F.col("path").alias("b_path"), F.col("node").alias("b_node"), F.col("size").alias("b_size"), F.col("diff").alias("b_diff"))
    met = pairs.join(one, (F.col("path") == F.col("a_path")) & (F.col("a") == F.col("a_node")))
    met = met.join(other, (F.col("path") == F.col("b_path")) & (F.col("b") == F.col("b_node")))
    apart = F.size("a_diff") + F.size("b_diff") - 2 * F.size(F.array_intersect("a_diff", "b_diff"))
    return met.filter(apart <= share * (F.col("a_size") + F.col("b_size")) + 1e-9).select("a", "b")


def _pairs(members: DataFrame, group: list[str]) -> DataFrame:
    """(path, a, b): pairs of the members (group..., node, root) of small groups that are not connected yet."""
    members = members.select(*group, "node", "root")
    other = members.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("node").alias("b"), F.col("root").alias("b_root"))
    met = (F.col("node") < F.col("b")) & (F.col("root") != F.col("b_root"))
    for c in group:
        met = met & (F.col(c) == F.col(f"of_{c}"))
    return members.join(other, met).select("path", F.col("node").alias("a"), "b").distinct()


def _centred(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The rows described from their group's core, with their slack; and the shingles (path, e, n) of these differences."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("all")).withColumnRenamed("path", "in_path")
    counts = rows.select("path", F.explode("diff").alias("e")).groupBy("path", "e").agg(F.count(F.lit(1)).alias("n"))
    # a shingle of one text is in no core and in no smaller group
    counts = cut(counts.filter("n > 1").join(sizes, F.col("path") == F.col("in_path")).drop("in_path"))
    core = counts.filter(2 * F.col("n") > F.col("all")).groupBy(F.col("path").alias("of_path")).agg(F.collect_list("e").alias("core"))
    core = cut(core)
    nothing = F.slice("diff", 1, 0)
    met = rows.join(core, F.col("path") == F.col("of_path"), "left").withColumn("core", F.coalesce("core", nothing))
    diff = F.concat(F.array_except("diff", "core"), F.array_except("core", "diff"))
    centred = met.select("path", "node", "size", diff.alias("diff")).withColumn("slack", F.size("diff") - share * F.col("size"))
    n = F.when(2 * F.col("n") > F.col("all"), F.col("all") - F.col("n")).otherwise(F.col("n"))
    return cut(centred), counts.select("path", "e", n.alias("n"))


def _subgroups(rows: DataFrame, shingles: DataFrame) -> DataFrame:
    """(path, group, node, root, n): texts by the rarest shingles of their differences, enough for every pair still to be found.

    A text whose ``need`` shingles must be shared has one of them among its rarest, all but ``need - 1``.  Groups of the
    same texts are kept once: neighbouring shingles of one change are held by the same texts.
    """
    held = rows.select("path", "node", F.explode("diff").alias("e"))
    known = shingles.filter("n > 1").select(F.col("path").alias("of_path"), F.col("e").alias("of_e"), "n")
    held = held.join(known, (F.col("path") == F.col("of_path")) & (F.col("e") == F.col("of_e"))).select("path", "node", "e", "n")
    own = Window.partitionBy("path", "node")
    held = held.withColumn("shared", F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("n", "e")))
    texts = rows.select(F.col("path").alias("of_path"), F.col("node").alias("of_node"), "root", F.size("diff").alias("long"), "need")
    held = held.join(texts, (F.col("path") == F.col("of_path")) & (F.col("node") == F.col("of_node")))
    # shingles that no other text holds come first; they make no groups
    held = cut(held.filter("long - shared + place <= long - need + 1").select("path", "e", "node", "root"))
    mark = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"mark{k}") for k in (1, 2)]
    groups = held.groupBy("path", "e").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *mark)
    groups = groups.filter("n > 1 and low < high").groupBy("path", "n", "mark1", "mark2").agg(F.min("e").alias("of_e"))
    groups = cut(groups.select(F.col("path").alias("of_path"), "of_e", "n", F.monotonically_increasing_id().alias("group")))
    met = held.join(groups, (F.col("path") == F.col("of_path")) & (F.col("e") == F.col("of_e")))
    return met.select("path", "group", "node", "root", "n")


def _in_blocks(rows: DataFrame, share: float, block: int) -> DataFrame:
    """(a, b): links among the rows (path, node, size, diff, root, n) of groups of n texts, enough to connect their roots."""
    blocks = F.ceil(F.col("n") / block)
    dealt = rows.withColumns({"own": F.pmod(F.xxhash64("node"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))})
    dealt = dealt.select("path", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "size", "root", "diff")

    def per_pair(key: tuple, texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("own")
        node, size, root, own = (texts.column(c).to_numpy() for c in ("node", "size", "root", "own"))
        diff = pa.concat_arrays(texts.column("diff").chunks)
        # the texts of the lower block come first; of one block with itself each text meets those before it
        first = int(np.searchsorted(own, key[2].as_py())) if key[1] != key[2] else None
        a, b = _compared(node, size, root, diff.value_lengths().to_numpy(), diff.flatten().to_numpy(), first, share)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.groupBy("path", "low", "high").applyInArrow(per_pair, "a bigint, b bigint")


def _compared(
    node: np.ndarray, size: np.ndarray, root: np.ndarray, lengths: np.ndarray, shingles: np.ndarray, first: int | None, share: float
) -> tuple[list[int], list[int]]:
    """Links of the texts from ``first`` on with those before it (None: of all texts), none between texts connected already."""
    lengths, a, b = lengths.astype(np.int64), [], []
    if not len(node) or first in (0, len(node)):
        return a, b
    root, ends = root.copy(), np.cumsum(lengths)
    place = np.unique(shingles, return_inverse=True)[1]
    holders = np.repeat(np.arange(len(node)), lengths)[np.argsort(place, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(place))])
    for x in range(first or 0, len(node)):
        upto = x if first is None else first
        own = place[ends[x] - lengths[x] : ends[x]]
        held = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        apart = lengths[x] + lengths[:upto] - 2 * np.bincount(holders[at], minlength=len(node))[:upto]
        near = np.flatnonzero(apart <= share * (size[x] + size[:upto].astype(np.int64)) + 1e-9)
        while len(near := near[root[near] != root[x]]):
            a.append(int(node[near[0]]))
            b.append(int(node[x]))
            root[root == root[near[0]]] = root[x]
    return a, b


def links(
    nodes: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, few: int = FEW, whole: int = WHOLE, block: int = BLOCK
) -> DataFrame:
    """(a, b): pairs of similar texts among ``nodes`` (node, text), enough to connect all that are linked."""
    share = _share(similarity)
    pairs, groups = _candidates(nodes, words, few)
    used = pairs.select("a").union(pairs.select("b")).union(groups.select("node")).distinct().withColumnRenamed("a", "of_node")
    used = stored(used)  # its size is known then, and while it is small the texts are not dealt out
    sets = stored(_sets(nodes.join(used, F.col("node") == F.col("of_node"), "left_semi"), words))
    alone = F.lit(-1).cast("bigint")
    near = [cut(_linked(pairs.withColumn("path", alone), sets.withColumn("path", alone), share))]
    groups = groups.select(F.col("node").alias("of_node"), F.col("root").alias("path"))
    rows = cut(sets.join(groups, F.col("node") == F.col("of_node")).select("path", "node", "size", "diff"))
    while not rows.isEmpty():
        rows, shingles = _centred(rows, share)
        leads = rows.groupBy("path").agg(F.min(F.struct("slack", "node")).alias("lead")).withColumnRenamed("path", "of_path")
        leads = cut(leads)
        met = rows.join(leads, F.col("path") == F.col("of_path")).drop("of_path")
        star = met.filter((F.col("node") != F.col("lead.node")) & (F.col("slack") + F.col("lead.slack") <= 1e-9))
        near.append(cut(star.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()))
        roots = components(_union(near)).withColumnsRenamed({"node": "of_node", "root": "of_root"})
        need = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.col("lead.slack")) / 2 - 1e-9)).cast("int").alias("need")
        rooted = met.join(roots, F.col("node") == F.col("of_node"), "left")
        rooted = cut(rooted.select("path", "node", "size", "diff", F.coalesce("of_root", "node").alias("root"), need))
        left = rooted.filter(F.size("diff") >= F.col("need"))
        apart = left.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
        apart = cut(apart.select(F.col("path").alias("of_path"), "n"))
        blocks = left.join(apart.filter(F.col("n") <= whole), F.col("path") == F.col("of_path"))
        near.append(cut(_in_blocks(blocks, share, block)))
        apart = apart.filter(F.col("n") > whole)
        if apart.isEmpty():
            break
        left = left.join(apart, F.col("path") == F.col("of_path"), "left_semi")
        held = cut(_subgroups(left, shingles))
        near.append(cut(_linked(_pairs(held.filter(F.col("n") <= few), ["path", "group"]), rooted, share)))
        large = held.filter(F.col("n") > few).select(F.col("path").alias("of_path"), "group", F.col("node").alias("of_node"))
        deeper = rooted.join(large, (F.col("path") == F.col("of_path")) & (F.col("node") == F.col("of_node")))
        rows = cut(deeper.select(F.col("group").alias("path"), "node", "size", "diff"))
    return _union(near)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, few: int = FEW) -> DataFrame:
    """(doc_id, component_id, text_key) for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links; equal texts are linked, texts without words (null
    and empty ones too) are equal to each other.  Null ids take part but cannot name a component unless nothing else
    does.  An empty table gives no rows.  Other columns are not looked at.
    """
    nodes = stored(docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", "text"))
    joined = components(links(nodes, similarity, words, few)).withColumnRenamed("node", "of_node")
    rooted = nodes.select("node", "doc_id", text_key().alias("text_key")).join(joined, F.col("node") == F.col("of_node"), "left")
    rooted = cut(rooted.select("doc_id", "text_key", F.coalesce("root", "node").alias("root")))
    # stored, so that both sides of the join are dealt anew and Spark can split the partition of a large group
    least = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))).withColumnRenamed("root", "of_root")
    return rooted.join(least, F.col("root") == F.col("of_root")).select("doc_id", "component_id", "text_key")


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group; columns unchanged.

    Rows without an id stay only where their whole group has none.
    """
    dropped = similar_groups(docs, similarity, words).filter(~same(F.col("doc_id"), F.col("component_id")))
    return without(docs, stored(dropped.select("doc_id", "text_key").distinct()))
