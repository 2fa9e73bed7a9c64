"""Substring dedup on sliding runs of sentences.

A text is cut behind sentence marks, clause marks and line ends.  Runs of several sentences with enough words meet
globally by hash.  All sentences that a repeated run covers are removed, except in its first place: the smallest document
id, and there the earliest place.

Every run counts, but only the shortest ones are hashed: from each sentence on, and up to each sentence.  A sentence of a
repeated run lies in one of these inside that run (from the sentence on if enough text follows in the run, else in the
one that ends with the run), and a part of a repeated run is repeated too.  So the sentences removed are those of the
full rule, at two hashes a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.llm.shared import cut, free_name, hash_filter, passes, pieces, text_key

#: Sentences and words of a run, at least.  Twenty words in a row do not repeat by chance.
LEAST_SENTENCES, LEAST_WORDS = 2, 20
_CUT = re.compile(r"[^.!?;,:\n]*(?:[.!?;,:\n]+\s*|$)")
_FACTOR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(f, -1, 1 << 64) for f in _FACTOR)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; together they are the text."""
    return [m.span() for m in _CUT.finditer(text) if m.end() > m.start()]


def runs(text: str, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS):
    """Spans of the sentences; first and last sentence of each shortest run, rising; two 64-bit hashes of each run.

    The hash covers the words of the run and where its sentences end, not its white space.
    """
    import xxhash

    spans = sentences(text)
    n = len(spans)
    parts = [text[a:b].split() for a, b in spans]
    words = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if n else np.zeros(1, int)
    each = np.arange(n)
    ends = np.maximum(np.searchsorted(words, words[:-1] + least_words, "left") - 1, each + least_sentences - 1)
    starts = np.minimum(np.searchsorted(words, words[1:] - least_words, "right") - 1, each - least_sentences + 1)
    first, last = np.concatenate([each[ends < n], starts[starts >= 0]]), np.concatenate([ends[ends < n], each[starts >= 0]])
    if not len(first):
        return spans, np.zeros((0, 2), np.int64), np.zeros((0, 2), np.uint64)
    own = np.unique(first * n + last)
    first, last = own // n, own % n
    digests = b"".join(xxhash.xxh3_128_digest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts)
    own = np.frombuffer(digests, "<u8").reshape(-1, 2)
    out = np.empty((len(first), 2), np.uint64)
    for lane in (0, 1):
        power = np.multiply.accumulate(np.full(n, _FACTOR[lane], np.uint64))
        back = np.multiply.accumulate(np.full(n, _INVERSE[lane], np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[:, lane] * power)])
        out[:, lane] = (total[last + 1] - total[first]) * back[first]
    return spans, np.stack([first, last], axis=1), out


def _all_runs(docs: DataFrame, least_sentences: int, least_words: int, bits: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text_key, place, last, again, h1, h2) of every run; ``again`` marks runs the same text had before.

    With ``bits`` only the runs that pass the filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "last", "again", "h1", "h2"]
        for batch in pieces(batches, 2):
            texts = batch.column(2).to_pylist()
            rows, places, again, hashes = [], [], [], []
            for k, t in enumerate(texts):
                _, own, h = runs(t or "", least_sentences, least_words)
                seen = np.zeros(len(h), bool)
                if len(np.unique(h[:, 0])) < len(h):
                    seen[:] = True
                    seen[np.unique(h, axis=0, return_index=True)[1]] = False
                if bits is not None and len(h):
                    may = passes(bits, h[:, 0])
                    own, h, seen = own[may], h[may], seen[may]
                if len(h):
                    rows.append(np.full(len(h), k))
                    places.append(own)
                    again.append(seen)
                    hashes.append(h)
            if rows:
                row, place, h = np.concatenate(rows), np.concatenate(places).astype(np.int32), np.concatenate(hashes).view(np.int64)
                columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))]
                columns += [pa.array(x) for x in (place[:, 0], place[:, 1], np.concatenate(again), h[:, 0], h[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, place int, last int, again boolean, h1 bigint, h2 bigint"
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def repeated_places(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, places): the runs (place, last) that an earlier place has already.

    Counting is combined before the shuffle.  Only runs that pass a filter of the repeated ones are dealt a second time;
    the join back is an ordinary one that Spark splits where a run is hot.  Rows under one id are one document to each
    other; rows without an id come after all others.
    """
    found = _all_runs(docs, least_sentences, least_words)
    firsts = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # stored, so that both sides of the join are dealt anew and Spark can split the partition of a hot run
    firsts = cut(firsts).select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), "first_id")
    found = _all_runs(docs, least_sentences, least_words, hash_filter(firsts, "of1"))
    met = found.join(firsts, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")))
    later = F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    return met.filter(later).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("place", "last")).alias("places"))


def remove_repeats(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, changed_only: bool = False) -> DataFrame:
    """``docs`` with the covered sentences removed from ``text``, and ``removed``: their (start, end) in code points.

    Neighbouring covered sentences are one span.  A null text stays null; texts too short for a run stay as they are;
    a text covered wholly becomes empty, its row stays.  Other columns stay; one called ``removed`` is replaced.
    ``changed_only`` returns just the documents that lost something.
    """
    docs = docs.drop("removed")
    places = repeated_places(docs, least_sentences, least_words).select(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("places").alias(free_name(docs.columns, "places"))
    )
    met = docs["doc_id"].eqNullSafe(places["of_id"]) & (text_key() == places["of_key"])
    joined = docs.join(places, met, "inner" if changed_only else "left").drop(places["of_id"], places["of_key"])
    at = docs.columns.index("text")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts, removed = [], []
            for t, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                gone = []
                if t and places:
                    spans = sentences(t)
                    for first, last in sorted((p["place"], p["last"]) for p in places):
                        a, b = spans[first][0], spans[last][1]
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], b)
                        else:
                            gone.append([a, b])
                    kept = [0, *[x for g in gone for x in g], len(t)]
                    t = "".join(t[a:b] for a, b in zip(kept[::2], kept[1::2], strict=True))
                texts.append(t)
                removed.append([{"start": a, "end": b} for a, b in gone])
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, arrow_span)], names=[*batch.schema.names[:-1], "removed"])

    return joined.mapInArrow(run, schema)
