"""Alignment of two tokenizers on one text, and corpus-wide counts of the ids that end together.

Both tokenizers cut the same bytes, so tokens are compared by where they end.  The merged order of both lists of ends is
divided by merge-path partitioning: a binary search on each of some equally spaced diagonals finds where the merge
stands after so many steps, which cuts it into pieces of equal work that need nothing of each other.  Each piece gives
the ends that both lists have; an end whose two tokens fall into neighbouring pieces is found when these are stitched.
Common ends cut a text into groups.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.sentencepieces import BYTE, MARK, NORMAL, parse_model
from neurospan.llm.shared import pieces, stored

#: Largest tokenizer file that tasks may carry.
FILE_LIMIT_BYTES = 64 * 1024 * 1024
#: Steps of the merge in one piece, and bytes of text handled at once.
PIECE_STEPS, SLICE_BYTES = 1 << 14, 1 << 20

#: How byte-level tokenizers split a text before joining bytes.  Fixed value of the public format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(FILE_LIMIT_BYTES + 1)
    if len(data) > FILE_LIMIT_BYTES:
        raise ValueError(f"the tokenizer file is larger than {FILE_LIMIT_BYTES} bytes")
    return data


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class TokenTable:
    """The bytes of every id: token lengths and the joined bytes of a list of ids."""

    def __init__(self, shown: list[bytes | None]):
        self.known = np.array([x is not None for x in shown])
        self.sizes = np.array([len(x or b"") for x in shown], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(x or b"" for x in shown), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


class ByteLevel:
    """A byte-level BPE file; the strings of special tokens are ordinary text."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError("not a plain byte-level BPE file")
        special = {t["id"] for t in spec["added_tokens"]}
        shown: list[bytes | None] = [None] * (max([*model["vocab"].values(), *special]) + 1)
        for token, k in model["vocab"].items():
            if k not in special:
                shown[k] = bytes(letters[c] for c in token)
        self.table = TokenTable(shown)
        joins = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        made = [model["vocab"][a + b] for a, b in joins]
        plain = made == sorted(set(made)) and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"]["add_prefix_space"]
        if plain:  # ids rise with the rank of the join that makes them, so the faster library gives the same ids
            import tiktoken

            ranks = {x: k for k, x in enumerate(shown) if x is not None}
            core = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [core.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            core = Tokenizer.from_str(data.decode())
            core.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in core.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model; a marker stands for a space and ``<0xHH>`` for a byte."""

    def __init__(self, data: bytes):
        import sentencepiece

        core = sentencepiece.SentencePieceProcessor(model_proto=data)
        shown = [
            bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind == NORMAL else None
            for p, _, kind in parse_model(data).pieces
        ]
        self.table = TokenTable(shown)
        self.encode = lambda texts: core.encode(texts, num_threads=1)


def split_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many items of ``a`` are among the first d of the merge of two rising lists (of equal items, a's comes first)."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = np.flatnonzero(open_)
        before = a[middle[at]] <= b[diagonals[at] - middle[at] - 1]
        low[at[before]] = middle[at[before]] + 1
        high[at[~before]] = middle[at[~before]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the values that both rising lists have, by merge-path pieces."""
    diagonals = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    cut_a = split_points(a, b, diagonals)
    cut_b = diagonals - cut_a
    found = []
    for i0, i1, j0, j1 in zip(cut_a[:-1].tolist(), cut_a[1:].tolist(), cut_b[:-1].tolist(), cut_b[1:].tolist(), strict=True):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:  # its tokens lie on both sides of the cut
            found.append(np.array([[i0 - 1], [j0]]))
        own = a[i0:i1]
        at = np.searchsorted(own, b[j0:j1])
        hit = np.flatnonzero(at < len(own))
        hit = hit[own[at[hit]] == b[j0:j1][hit]]
        found.append(np.stack([at[hit] + i0, hit + j0]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


class _Digits:
    """Decimal ids with the mark behind them, written into one buffer."""

    def __init__(self, size: int, marks: str):
        shown = [f"{k}{mark}".encode() for mark in marks for k in range(size)]
        self.size, self.table = size, TokenTable(shown)

    def codes(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ids + self.size * last


@dataclass
class Aligned:
    """Of the texts of a batch: group strings and, for each text, its counts and its distinct linked id pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    pairs: list[np.ndarray]
    times: list[np.ndarray]


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, a: bytes, b: bytes, steps: int = PIECE_STEPS):
        self.a, self.b, self.steps = ByteLevel(a), Pieces(b), steps
        self.size_b = len(self.b.table.sizes)
        self.digits_a, self.digits_b = _Digits(len(self.a.table.sizes), ",|"), _Digits(self.size_b, ",;")
        # ids of both lists in one table of written forms
        one, other = self.digits_a.table, self.digits_b.table
        self.written = TokenTable([])
        self.written.sizes = np.concatenate([one.sizes, other.sizes])
        self.written.bytes = np.concatenate([one.bytes, other.bytes])
        self.written.starts = np.cumsum(self.written.sizes) - self.written.sizes

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both; texts that do not come back from the bytes of both have none."""
        none = np.zeros(0, np.int64)
        at = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in at]
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        ids = zip(at, spaced, self.a.encode(spaced), self.b.encode([texts[k] for k in at]), strict=True)
        for k, t, x, y in ids:
            x, y, whole = np.array(x, np.int64), np.array(y, np.int64), t.encode()
            if all(table.known[i].all() and table.joined(i) == whole for table, i in ((self.a.table, x), (self.b.table, y))):
                out_a[k], out_b[k] = x, y
        return out_a, out_b

    def align(self, texts: list[str | None]) -> Aligned:
        """Groups and links of every text; a null, empty or inexact one has none."""
        lists_a, lists_b = self._ids([t or "" for t in texts])
        n_a, n_b = np.array([len(x) for x in lists_a], np.int64), np.array([len(x) for x in lists_b], np.int64)
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (lists_a, lists_b))
        # texts one behind the other: the last tokens of each end together, so no group reaches across
        link_a, link_b = common_ends(np.cumsum(self.a.table.sizes[ids_a]), np.cumsum(self.b.table.sizes[ids_b]), self.steps)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[link_a], last_b[link_b] = True, True
        # a token's place in the written order: all of its own list before it, of the other list whole groups
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.append(link_a, -1) + 1, np.append(-1, link_b) + 1
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + upto_b[group_a]] = self.digits_a.codes(ids_a, last_a)
        codes[np.arange(len(ids_b)) + upto_a[group_b]] = self.digits_b.codes(ids_b, last_b) + 2 * self.digits_a.size
        line = self.written.joined(codes).decode("ascii")
        rows = np.cumsum(n_a + n_b)
        ends = np.concatenate([[0], np.cumsum(self.written.sizes[codes])])
        groups = [line[x : max(x, y - 1)] for x, y in zip(ends[rows - n_a - n_b].tolist(), ends[rows].tolist(), strict=True)]
        keys = ids_a[link_a] * self.size_b + ids_b[link_b]
        cuts = np.searchsorted(link_a, np.concatenate([[0], np.cumsum(n_a)]))
        found = [np.unique(keys[x:y], return_counts=True) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return Aligned(n_a, n_b, np.diff(cuts), groups, [x for x, _ in found], [y for _, y in found])


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(a: bytes, b: bytes, steps: int) -> Aligner:
    """One aligner per worker and pair of files."""
    key = hashlib.sha256(b"%d:%d:" % (steps, len(a)) + a + b).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a, b, steps)
    return _ALIGNERS[key]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *[len(x) for x in rows]]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def align(docs: DataFrame, a: bytes, b: bytes, steps: int = PIECE_STEPS) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, groups, pairs, times): one row per row of ``docs``.

    ``groups`` are the ids of both tokenizers between common ends, ``a1,a2|b1;a3|b2,b3``.  ``pairs`` are the distinct
    linked ids, ``a * size of b + b``, and ``times`` how often each is linked in the text.  ``row`` tells rows apart,
    also those that share an id or have none.  Null and empty texts, and those that one tokenizer does not give back
    exactly, have no tokens and an empty ``groups``.  Other columns are not looked at; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = aligner(a, b, steps), TaskContext.get().partitionId() << 40
        for batch in pieces(batches, 1, SLICE_BYTES):
            out = own.align(batch.column(1).to_pylist())
            columns = [
                batch.column(0), pa.array(np.arange(n, n + batch.num_rows)), pa.array(out.n_a), pa.array(out.n_b),
                pa.array(out.n_groups.astype(np.int64)), pa.array(out.groups, pa.string()),
                _lists(out.pairs, pa.int64()), _lists(out.times, pa.int32()),
            ]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, id_a, id_b, n, best): links of each id pair in the whole corpus; whether its b id has none more frequent.

    Counts are combined inside the tasks, so the shuffle carries distinct pairs.
    """
    counts = stored(_links(aligned).groupBy("pair").agg(F.sum("times").alias("n")))
    counts = counts.withColumn("id_b", F.pmod("pair", F.lit(size_b)))
    most = counts.groupBy(F.col("id_b").alias("of_b")).agg(F.max("n").alias("most"))
    out = counts.join(most, F.col("id_b") == F.col("of_b"))
    id_a = F.expr(f"pair div {size_b}")
    return out.select("pair", id_a.alias("id_a"), "id_b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_totals(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (a stored table) without its lists, and per row n_links, n_best and count_sum.

    The join on the pair is left to Spark, which copies the counts to the tasks only where their stored size is small,
    and splits the partition of a frequent pair where it is not.
    """
    known = counts.select(F.col("pair").alias("of_pair"), "n", "best")
    met = _links(aligned).join(known, F.col("pair") == F.col("of_pair"))
    sums = met.groupBy(F.col("row").alias("of_row")).agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    out = aligned.drop("pairs", "times").join(sums, F.col("row") == F.col("of_row"), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_links", "n_best", "count_sum")}
    return out.withColumns(zero).drop("of_row")


def aligned_totals(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) for every row of ``docs``.

    The texts are encoded once; what is kept of them are digests and distinct linked pairs.  See ``align``.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    kept = stored(align(docs, a, b).select("doc_id", "row", "n_a", "n_b", "n_groups", digest, "pairs", "times"))
    return link_totals(kept, stored(pair_counts(kept, len(parse_model(b).pieces))))
