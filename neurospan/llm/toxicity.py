"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over the set of lower-case words of a text and the beginnings of those words.  In every labelled sentence that names a group the
name is swapped for the other names of its list (and for a neutral noun), and the squared change of the score is part of
the loss: names end up with the weight of the neutral noun, so mentioning a group is not toxic by itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.llm.sampling import bounded_ids, one_label, texts_of
from neurospan.llm.shared import cut, free_name, pieces

#: Labelled rows of each class that the model is fitted on, at most.
FIT_ROWS = 5000
THRESHOLD = 0.3
BUCKETS = 1 << 22
#: Lengths of word beginnings, and the least score of a feature's share in the two classes (a two-sample z) to be used.
BEGINNINGS, LEAST_Z = (4, 5, 6), 3.0

#: Names of groups that may stand for one another, each list with a neutral noun.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("person", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("person", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("person", "black", "white", "asian", "latino", "african", "european", "american", "arab", "mexican", "chinese", "indian"),
    ("person", "immigrant", "refugee", "foreigner", "disabled", "blind", "deaf", "elderly", "old", "young"),
    ("personnes", "femmes", "hommes", "musulmans", "juifs", "noirs", "immigrés"),
    ("menschen", "frauen", "männer", "muslime", "juden", "schwarze", "ausländer"),
    ("personas", "mujeres", "hombres", "musulmanes", "judíos", "negros", "inmigrantes"),
)

_WORDS = re.compile(r"[^\W\d_]+").findall
_SENTENCES = re.compile(r"[.!?\n]+").split


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass(frozen=True)
class ToxicityModel:
    bias: float = -20.0
    weights: dict[int, float] = field(default_factory=dict)
    named: frozenset[str] = frozenset()


def _parts(word: str, named: frozenset[str]) -> list[int]:
    """Feature numbers of a word: itself and its beginnings; of a group's name only the name, as the swaps tie that."""
    beginnings = () if word in named else BEGINNINGS
    return [_bucket(word), *[_bucket(word[:k] + "*") for k in beginnings if len(word) > k]]


class _Known(dict):
    """Features with a weight of each word met so far; a worker remembers a bounded number of words."""

    def __init__(self, model: ToxicityModel, limit: int = 150_000):
        super().__init__()
        self.weights, self.named, self.limit = model.weights, model.named, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = tuple(f for f in _parts(word, self.named) if f in self.weights)
        if len(self) < self.limit:
            self[word] = value
        return value

    def total(self, text: str) -> float:
        found = set().union(*filter(None, map(self.__getitem__, set(_WORDS(text.lower())))))
        return sum(self.weights[f] for f in sorted(found))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _named(terms: Sequence[Sequence[str]]) -> frozenset[str]:
    return frozenset(w for group in terms for w in group)


def _features(terms: Sequence[Sequence[str]]):
    named = _named(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            texts = [t.lower() for t in batch.column(0).to_pylist()]
            words = pa.array([sorted({f for w in set(_WORDS(t)) for f in _parts(w, named)}) for t in texts], pa.list_(pa.int32()))
            swaps = [[sorted(named.intersection(_WORDS(s))) for s in _SENTENCES(t)] if named.intersection(_WORDS(t)) else [] for t in texts]
            swaps = pa.array([[x for x in s if x] for s in swaps], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(1), words, swaps], names=["toxic", "words", "named"])

    return run


def counterfactual_pairs(sentences: Iterable[tuple[Sequence[str], int]], terms: Sequence[Sequence[str]]) -> Counter:
    """How often swapping one word for another was tried: each name in a sentence for every other of its list.

    ``sentences`` are the names of a sentence and how many sentences have just these.
    """
    pairs: Counter = Counter()
    for present, times in sentences:
        for a in present:
            for group in terms:
                if a in group:
                    pairs.update({(a, b): times for b in group if b not in present})
    return pairs


def _minimise(starts, index, width, y, weight, pairs, l1, swap_weight, steps):
    """Accelerated proximal gradient for the weighted logistic loss, the swap penalty and an L1 term."""
    rows = np.repeat(np.arange(len(y)), np.diff(starts))
    weight = weight / weight.sum()
    a, b, c = pairs
    c = swap_weight * c / max(c.sum(), 1.0)

    def times(w):
        return np.bincount(rows, weights=w[index], minlength=len(y))

    def gradient(w, bias):
        r = weight * (_logistic(times(w) + bias) - y)
        g = np.bincount(index, weights=r[rows], minlength=width)
        d = 2 * c * (w[a] - w[b])
        return g + np.bincount(a, weights=d, minlength=width) - np.bincount(b, weights=d, minlength=width), r.sum()

    v, size = np.ones(width) / np.sqrt(width), 1.0
    for _ in range(20):  # largest curvature, by power iteration
        u = np.bincount(index, weights=(weight * (times(v) + 1.0))[rows], minlength=width) * 0.25
        size = np.linalg.norm(u)
        v = u / max(size, 1e-12)
    step = 1.0 / (1.2 * size + 4 * c.sum() + 0.5)
    w = seen = np.zeros(width)
    bias = seen_bias = float(np.log((weight @ y + 1e-6) / (1 - weight @ y + 1e-6)))
    speed = 1.0
    for _ in range(steps):
        g, gb = gradient(seen, seen_bias)
        new = seen - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = seen_bias - step * gb
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        seen = new + (speed - 1) / faster * (new - w)
        seen_bias = new_bias + (speed - 1) / faster * (new_bias - bias)
        w, bias, speed = new, new_bias, faster
    return w, bias


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, rows: int = FIT_ROWS,
    l1: float = 2e-5, swap_weight: float = 1.0, steps: int = 400,
) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents of each class among the label rows ``train``.

    Features that do not tell the classes apart are left out by Spark; what reaches the driver of this bounded sample
    are the numbers of the others.  Rows are weighted back to the class sizes of all training labels.  Null labels and
    labels without a document are ignored; without both classes the model is the bare class rate.
    """
    known = one_label(labels, "toxic", train)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = texts_of(docs, bounded_ids(known, rows, "toxic")).select("text", "toxic")
    kind = "toxic int, words array<int>, named array<array<string>>"
    sample = cut(sample.mapInArrow(_features(terms), kind).withColumn("row", F.monotonically_increasing_id()))
    n = {v: 0 for v in (0, 1)} | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:
        rate = float(n[1] > 0)
        return ToxicityModel(float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    sentences = sample.select(F.explode("named").alias("s")).groupBy("s").count().orderBy("s").collect()
    pairs = counterfactual_pairs([(r["s"], r["count"]) for r in sentences], terms)
    pair_ids = np.array([(_bucket(a), _bucket(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    # features that tell the classes apart at all; swapped words stay in any case
    held = sample.select("row", F.explode("words").alias("f"), "toxic")
    counts = held.groupBy("f").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
    pooled = F.col("n") / F.lit(n[0] + n[1])
    gap = F.col("n1") / F.lit(n[1]) - (F.col("n") - F.col("n1")) / F.lit(n[0])
    z = gap / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n[0] + 1 / n[1]) + F.lit(1e-12))
    telling = F.abs(z) >= LEAST_Z
    if len(pair_ids):
        telling = telling | F.col("f").isin(np.unique(pair_ids).tolist())
    chosen = cut(counts.filter(telling).select(F.col("f").alias("of_f")))
    held = held.join(chosen, F.col("f") == F.col("of_f")).groupBy(F.col("row").alias("of_row")).agg(F.array_sort(F.collect_list("f")).alias("f"))
    got = sample.select("row", "toxic").join(held, F.col("row") == F.col("of_row"), "left").orderBy("row")
    got = got.select("toxic", F.coalesce("f", F.array().cast("array<int>")).alias("f")).toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    lists = got.column("f").combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    used = np.union1d(flat, pair_ids.ravel()).astype(np.int64)
    index = np.searchsorted(used, flat)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    weight = np.array([totals[int(v)] / n[int(v)] for v in y])
    swaps = (np.searchsorted(used, pair_ids[:, 0]), np.searchsorted(used, pair_ids[:, 1]), np.array(list(pairs.values()), float))
    w, bias = _minimise(starts, index, len(used), y, weight, swaps, l1, swap_weight, steps)
    return ToxicityModel(float(bias), {int(k): float(v) for k, v in zip(used, w, strict=True) if v}, _named(terms))


def score(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the score of the whole text; a null text scores as an empty one.

    A column that is called ``into`` already is replaced.
    """
    docs = docs.drop(into)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model)
        for batch in pieces(batches, text):
            sums = [known.total(t or "") for t in batch.column(text).to_pylist()]
            found = pa.array(_logistic(np.array(sums, float) + model.bias), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score at or above the threshold; columns unchanged."""
    name = free_name(docs.columns, "toxicity")
    return score(docs, model, name).filter(F.col(name) < threshold).drop(name)
