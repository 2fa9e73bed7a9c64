"""Quality classifier learned from trusted positives and unlabelled text only.

Documents labelled good are the positives; all other text is unlabelled, good and bad mixed.  The share of good text
among it is estimated from the scores of a classifier that tells positives from unlabelled rows; then the non-negative
unbiased risk is minimised.  Features are shares and counts of a text's characters, words and lines, cut into bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.llm.sampling import bounded_ids, one_label
from neurospan.llm.shared import free_name, pieces, stored

#: Trusted positives and unlabelled documents that the weights are fitted on, at most.
POSITIVE_ROWS, UNLABELLED_ROWS = 5000, 20000
THRESHOLD = 0.3
BINS = 12
CUTS = np.linspace(0, 1, BINS + 2)[1:-1]

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_SIGNS = tuple(s.encode() for s in ".,;:!?%$&*#|<>{}[]()=/\\@_-\"'")


def features(text: str) -> list[float]:
    """Numbers that describe how a text is written, not what it is about."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    letters = max(len(raw) - len(raw.translate(None, _LETTERS)), 1)
    often = Counter(words)
    threes = set(zip(words, words[1:], words[2:], strict=False))
    line_set = set(lines)
    return [
        np.log1p(len(words)), np.log1p(len(lines)), len(text) / n, max(map(len, often), default=0), len(often) / n,
        max(often.values(), default=0) / n, len(threes) / max(n - 2, 1), len(line_set) / m, n / m,
        max(map(len, lines), default=0) / size, (len(raw) - len(raw.translate(None, _UPPER))) / letters, letters / size,
        (len(raw) - len(raw.translate(None, _DIGITS))) / size, raw.count(b"  ") / n,
        sum(x[-1:] in ".!?\"" for x in line_set) / m, *[raw.count(s) / n for s in _SIGNS],
    ]


WIDTH = len(features(""))


@dataclass(frozen=True)
class QualityModel:
    """Edges of the bins of each feature, a weight for each bin, the estimated share of good text."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self.weights[k][np.searchsorted(self.edges[k], x[:, k], "right")] for k in range(len(self.edges)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(edges) * (BINS + 1)), np.float32)
    for k, cuts in enumerate(edges):
        out[np.arange(len(x)), k * (BINS + 1) + np.searchsorted(cuts, x[:, k], "right")] = 1
    return out


def _descend(gradient, width: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam on ``gradient(w)``; the last weight is the bias."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _mean_gradient(x: np.ndarray, w: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the label ``sign`` and its gradient."""
    z = sign * (x @ w[:-1].astype(np.float32) + w[-1])
    r = (-sign * _logistic(-z) / max(len(x), 1)).astype(np.float32)
    return float(np.mean(np.logaddexp(0, -z))), np.append(r @ x, r.sum())


def estimate_prior(held_positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled scores: over all thresholds, the least ratio of the shares above it.

    Each share gets a confidence margin, so thin tails do not win by chance.  The lower end is returned: taking some
    good text for bad lowers scores a little, taking bad text for good would excuse it.
    """
    cuts = prior_cuts(held_positive)
    above = np.append(len(unlabelled) - np.searchsorted(np.sort(unlabelled), cuts, "left"), len(unlabelled))
    return prior_from_counts(held_positive, cuts, above)


def prior_cuts(held_positive: np.ndarray) -> np.ndarray:
    return np.quantile(held_positive, np.linspace(0.02, 0.98, 97))


def prior_from_counts(held_positive: np.ndarray, cuts: np.ndarray, above: np.ndarray) -> float:
    """``estimate_prior`` from the numbers of unlabelled texts that reach each cut, and of all of them (last)."""
    p = 1 - np.searchsorted(np.sort(held_positive), cuts, "left") / len(held_positive)
    u, n = above[:-1] / above[-1], above[-1]
    margin = np.sqrt(np.log(40) / 2) * (len(held_positive) ** -0.5 + n**-0.5)
    best = np.argmin((u + margin) / p)
    return float(np.clip((u[best] - margin) / p[best], 0.01, 0.99))


def first_classifier(p: np.ndarray, u: np.ndarray, steps: int, l2: float) -> np.ndarray:
    """Weights that tell positives from unlabelled rows."""
    return _descend(lambda w: _mean_gradient(p, w, 1)[1] + _mean_gradient(u, w, -1)[1] + 2 * l2 * w, p.shape[1], steps)


def risk_parts(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient) of the non-negative risk, without the penalty.

    The negative part is that of the unlabelled rows less that of the positives among them; below zero it has been
    fitted too closely, counts as zero and gives no gradient.
    """
    good, bad_u, bad_p = _mean_gradient(p, w, 1), _mean_gradient(u, w, -1), _mean_gradient(p, w, -1)
    negative = bad_u[0] - prior * bad_p[0]
    gradient = prior * good[1] + (bad_u[1] - prior * bad_p[1] if negative > 0 else 0)
    return prior * good[0], max(negative, 0.0), gradient


def fit_arrays(
    positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, l2: float = 2e-4,
    edges: np.ndarray | None = None, reaching: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> QualityModel:
    """Fit from feature rows; the prior from a first classifier, then the non-negative risk.

    ``edges`` are the bin edges of the features, by default quantiles of the rows.  ``reaching(edges, weights, cuts)``
    counts the unlabelled texts whose first score reaches each cut, and all of them; by default the rows are counted.
    """
    if edges is None:
        edges = np.quantile(np.concatenate([positive, unlabelled]), CUTS, axis=0).T
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    half = np.arange(len(p)) % 2 == 0
    first = first_classifier(p[half], u, steps // 2, l2)
    prior = 0.5
    if half.sum() < len(p):
        held = p[~half] @ first[:-1]
        if reaching is None:
            prior = estimate_prior(held, u @ first[:-1])
        else:
            cuts = prior_cuts(held)
            prior = prior_from_counts(held, cuts, reaching(edges, first[:-1], cuts))
    w = _descend(lambda w: risk_parts(p, u, prior, w)[2] + 2 * l2 * w, p.shape[1], steps)
    return QualityModel(edges, w[:-1].reshape(len(edges), BINS + 1), float(w[-1]), prior)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_describe, T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _sample(described: DataFrame, ids: DataFrame) -> np.ndarray:
    """Feature rows of a bounded list of ids, which is broadcast: its size is the bound of the sample."""
    rows = described.join(F.broadcast(ids.select("doc_id")), "doc_id").select("x").toArrow()
    return np.array(rows.column("x").to_pylist(), float).reshape(-1, WIDTH)


def _edges(described: DataFrame) -> np.ndarray:
    """Bin edges of the features: their quantiles over all texts, to a ten-thousandth of the ranks."""
    cuts = F.array(*[F.lit(float(c)) for c in CUTS])
    row = described.agg(*[F.percentile_approx(F.col("x")[k], cuts, 10_000).alias(f"x{k}") for k in range(WIDTH)]).first()
    return np.array([row[f"x{k}"] for k in range(WIDTH)], float)


def _reaching(described: DataFrame):
    """Counts over all texts, summed per batch in the tasks."""

    def count(edges: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(0).to_pylist(), float).reshape(-1, WIDTH)
                found = np.sort(_binned(x, edges) @ weights)
                above = np.append(len(x) - np.searchsorted(found, cuts, "left"), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(above))), pa.array(above)], names=["cut", "n"])

        rows = described.select("x").mapInArrow(run, "cut bigint, n bigint").groupBy("cut").agg(F.sum("n").alias("n")).collect()
        return np.array([n for _, n in sorted((r["cut"], r["n"]) for r in rows)], float)

    return count


def fit(
    docs: DataFrame, labels: DataFrame, train_label: Column, train_doc: Column,
    positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS,
) -> QualityModel:
    """Fit on the training documents ``train_doc`` and the trusted labels ``train_label``.

    Labels of bad documents are not used at all.  Bin edges and class prior are statistics of all training documents;
    only the weights are fitted on at most ``positives`` trusted and ``unlabelled`` other documents, which reach the
    driver as feature rows.  Features are computed once and stored.  Without positives or documents every text scores
    one half.
    """
    described = stored(_described(docs.filter(train_doc)))
    trusted = one_label(labels, "quality", train_label).filter("quality = 1")
    p = _sample(described, bounded_ids(trusted, positives))
    u = _sample(described, bounded_ids(described, unlabelled))
    if not len(p) or not len(u):
        return QualityModel(np.zeros((0, BINS)), np.zeros((0, BINS + 1)), 0.0, 0.5)
    return fit_arrays(p, u, edges=_edges(described), reaching=_reaching(described))


def score(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the score of the whole text; a null text scores as an empty one.

    A column that is called ``into`` already is replaced.
    """
    docs = docs.drop(into)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            x = np.array([features(t or "") for t in batch.column(text).to_pylist()], float).reshape(-1, WIDTH)
            z = model.logits(x) if len(model.edges) else np.zeros(len(x))
            found = pa.array(_logistic(z) + np.zeros(len(x)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def drop_poor(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold; columns unchanged."""
    name = free_name(docs.columns, "quality_score")
    return score(docs, model, name).filter(F.col(name) >= threshold).drop(name)
