"""SimHash near-duplicates with BK-trees.

Fingerprints within the radius agree on some choice of bit blocks (pigeonhole), so each choice deals them into shards
that hold all partners.  A shard becomes a BK-tree whose children are keyed by their Hamming distance to the parent;
a search follows only the edges within the radius.  Shards larger than a tree may be are cut into parts whose trees
are searched by the later parts as well, so no task holds more than one bounded tree and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.llm.components import components
from neurospan.llm.shared import cut, pieces, same, text_key, without

WORDS, RADIUS, SEED = 4, 4, 42
#: Bit blocks (two more than the radius: two blocks agree) and fingerprints in one tree.
BLOCKS, TREE_ROWS = RADIUS + 2, 4096
_SLICE = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(words, len(parts)) - 1 :]
    total, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, _SLICE):
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp): one row per row of ``docs``; null texts count as empty and have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            found = np.array([fingerprint(t or "", words) for t in batch.column(2).to_pylist()], np.uint64)
            kept = [batch.column(0), batch.column(1), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(kept, names=["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


class BKTree:
    """Fingerprints of one shard part, linked into components while they are added.

    A subtree whose nodes all belong to the searcher's own component is not entered again: its links add nothing.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[bool] = []
        self.up: list[int] = []
        self.checked = 64

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def _new(self, fp: int) -> int:
        self.fps.append(fp)
        self.up.append(len(self.up))
        return len(self.up) - 1

    def _recheck(self) -> None:
        """Mark the subtrees that are in one component by now, children first (they have larger numbers)."""
        for k in range(len(self.children) - 1, -1, -1):
            own = self.root(k)
            self.uniform[k] = all(self.uniform[c] and self.root(c) == own for c in self.children[k].values())
        self.checked *= 2

    def links(self, fp: int, add: bool) -> list[int]:
        """One fingerprint from each component within the radius; then the fingerprint joins them (and the tree)."""
        found, own = [], None
        stack, r = [0] if self.children else [], self.radius
        while stack:
            k = stack.pop()
            if own is not None and self.uniform[k] and self.root(k) == own:
                continue
            d = (fp ^ self.fps[k]).bit_count()
            if d <= r and (mine := self.root(k)) != own:
                found.append(self.fps[k])
                if own is not None:
                    self.up[own] = mine
                own = self.root(mine)
            kids = self.children[k]
            if len(kids) <= 2 * r + 1:
                stack += [c for e, c in kids.items() if d - r <= e <= d + r]
            else:
                stack += [kids[e] for e in range(d - r, d + r + 1) if e in kids]
        if add:
            self._insert(fp, own)
        return found

    def _insert(self, fp: int, own: int | None) -> None:
        me = len(self.fps)
        k = 0
        while self.children:
            d = (fp ^ self.fps[k]).bit_count()
            if d == 0:
                return
            if self.root(k) != own:
                self.uniform[k] = False
            if d not in self.children[k]:
                self.children[k][d] = me
                break
            k = self.children[k][d]
        self._new(fp)
        self.children.append({})
        self.uniform.append(True)
        if own is not None:
            self.up[me] = own
        if len(self.fps) >= self.checked:
            self._recheck()


def _link_shards(radius: int):
    """Arrow batches sorted by (key, part, probe) to links; one tree is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = BKTree(radius), None
        for batch in batches:
            key, part, probe, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            turns = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.concatenate([[0], turns]), np.concatenate([turns, [len(key)]])
            work = ends - starts > 1
            work[[0, -1]] = True  # these may go on in another batch
            a, b = [], []
            for s, e in zip(starts[work].tolist(), ends[work].tolist(), strict=True):
                if (key[s], part[s]) != now:
                    tree, now = BKTree(radius), (key[s], part[s])
                for x, q in zip(fp[s:e].view(np.uint64).tolist(), probe[s:e].tolist(), strict=True):
                    for y in tree.links(x, not q):
                        a.append(x)
                        b.append(y)
            pair = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(pair, names=["a", "b"])

    return run


def _shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """A key for each choice of ``blocks - radius`` blocks: two fingerprints within the radius share at least one."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(n).cast("long")
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(value, fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.explode(F.array(*keys))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(a, b): enough pairs of distinct fingerprints within the radius to connect all that are linked.

    ``blocks`` must exceed the radius; more blocks give longer keys, hence smaller shards and more of them, and never
    change what is linked.  Two keys that fall together by hashing only share a shard.
    """
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    keyed = fps.select("fp").distinct().select(_shard_keys(F.col("fp"), blocks, radius).alias("key"), "fp")
    sizes = keyed.groupBy("key").count()
    large = sizes.filter(F.col("count") > tree_rows).select(
        F.col("key").alias("large_key"), F.ceil(F.col("count") / tree_rows).cast("int").alias("parts")
    )
    dealt = keyed.join(large, F.col("key") == F.col("large_key"), "left")
    own = F.coalesce(F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int"), F.lit(0))
    dealt = dealt.select("key", "fp", own.alias("own"))
    rows = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("part"))
    rows = rows.select("key", "part", (F.col("part") != F.col("own")).alias("probe"), "fp")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "probe", "fp")
    return rows.mapInArrow(_link_shards(radius), "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_key) for every row of ``docs``.

    Fingerprints with at most ``radius`` differing bits are linked; ``component_id`` is the smallest ``doc_id``
    reachable over links.  Null and empty texts have fingerprint zero, which is linked like any other.  Null ids take
    part but cannot name a component unless nothing else does.  An empty table gives no rows.  Shingles have ``words``
    words.
    """
    fps = cut(fingerprints(docs, words))
    joined = components(links(fps, radius, blocks, tree_rows)).withColumnRenamed("node", "linked_fp")
    rooted = fps.join(joined, F.col("fp") == F.col("linked_fp"), "left").select(
        "doc_id", "text_key", "fp", F.coalesce("root", "fp").alias("root")
    )
    # stored, so that both sides of the join are dealt anew and Spark can split the partition of a large group
    least = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))).withColumnRenamed("root", "of_root")
    out = rooted.join(least, F.col("root") == F.col("of_root"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group; columns unchanged.

    Rows without an id stay only where their whole group has none.
    """
    return without(docs, near_groups(docs).filter(~same(F.col("doc_id"), F.col("component_id"))))
