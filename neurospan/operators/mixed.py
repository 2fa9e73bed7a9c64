"""Random-intercept linear mixed models (maximum likelihood) from distributed sums.

Spark deals the visits out by subject; tasks reduce them to per-subject sums and
those to one row of totals per (model, visits per subject).  The likelihood depends on the data only through
these totals, so the remaining one-dimensional search over the variance ratio
touches one row per distinct number of visits (at most about the square root of
twice the visits).  Models are dealt over the tasks; each search evaluates whole
grids of ratios at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions.tails import t_two_sided
from neurospan.operators.groupstats import zscore

CHI2_95 = 3.841458820694124  # fixed value: 0.95 quantile, one degree of freedom


@dataclass(frozen=True)
class Spec:
    """One model: outcome, fixed-effect columns (intercept is implicit) and the term to report."""

    name: str
    outcome: Column
    terms: Mapping[str, Column]
    report: str


def _upper(q: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(q) for b in range(a, q)]


def cluster_totals(df: DataFrame, subject: str, specs: Sequence[Spec]) -> DataFrame:
    """Totals per (model, cluster size): counts, cross products and products of cluster sums.

    The visits are dealt out once, by subject, with each column that models share (the same object) sent once; a task
    adds its subjects up for all models in subject order and hands on one row per (model, size).  Rows with an unknown
    value drop per model.
    """
    width = max(len(s.terms) for s in specs) + 2  # intercept, terms, outcome
    columns = {id(c): c for s in specs for c in (*s.terms.values(), s.outcome)}
    place = {key: k for k, key in enumerate(columns)}
    shapes = {s.name: [place[id(c)] for c in (*s.terms.values(), s.outcome)] for s in specs}
    pairs = _upper(width)
    sums = [f"{kind}{a}_{b}" for kind in "gp" for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {name: _Sizes(own, width) for name, own in shapes.items()}
        last = []  # the subject that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = ids.indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            goes_on = last == [batch.column(0)[0].as_py()]
            last = [batch.column(0)[batch.num_rows - 1].as_py()]
            orders: dict = {}
            for own in sizes.values():
                own.add(z, starts, goes_on, orders)
        a, b = np.array(pairs).T
        for name, own in sizes.items():
            own.close()
            if own.found:
                n = sorted(own.found)
                cells = np.array([np.concatenate([own.found[k][1][a, b], own.found[k][2][a, b]]) for k in n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(n)), pa.array(n, pa.int64()), pa.array([own.found[k][0] for k in n], pa.int64()), *map(pa.array, cells.T)],
                    ["model", "n", "m", *sums],
                )

    dealt = df.repartition(F.col(subject)).sortWithinPartitions(subject)
    rows = dealt.select(F.col(subject).alias("subject"), *[c.cast("double").alias(f"z{k}") for k, c in enumerate(columns.values())])
    per_task = rows.mapInArrow(run, ", ".join(["model string, n bigint, m bigint", *[f"{c} double" for c in sums]]))
    return per_task.groupBy("model", "n").agg(*[F.sum(c).alias(c) for c in ("m", *sums)])


class _Sizes:
    """One model's totals per cluster size, from batches of visits in subject order.

    ``found``: size -> [subjects, cross products, products of the subjects' sums].  The last subject of a batch stays
    open as its sums and cross products, so a subject may have any number of visits.
    """

    def __init__(self, columns: Sequence[int], width: int):
        self.terms, self.outcome, self.width = list(columns[:-1]), columns[-1], width
        self.found: dict[int, list] = {}
        self.open = np.zeros(width), np.zeros((width, width))

    def add(self, z: np.ndarray, starts: np.ndarray, goes_on: bool, orders: dict) -> None:
        """``starts``: first row of each subject; ``goes_on``: the first one is the open one; ``orders``: shared by the models."""
        x = np.zeros((len(z), self.width))
        x[:, 0] = 1.0
        x[:, 1:len(self.terms) + 1] = z[:, self.terms]
        x[:, -1] = z[:, self.outcome]
        x[np.isnan(x).any(axis=1)] = 0.0  # an unknown value: the row counts nowhere
        sums, gram = np.add.reduceat(x, starts, axis=0), np.zeros((self.width, self.width))
        if goes_on:
            sums[0] += self.open[0]
            gram = self.open[1]
        else:
            self.close()
        tail = x[starts[-1]:]
        if len(starts) == 1:
            self.open = sums[0], gram + tail.T @ tail
            return
        self.open = sums[-1], tail.T @ tail
        sums = sums[:-1]
        n = sums[:, 0].astype(int)
        if goes_on and n[0]:
            self._entry(n[0])[1] += gram
        key = n.tobytes()
        if key not in orders:
            own = np.argsort(n, kind="stable")
            per_row = np.repeat(n, np.diff(starts))
            by_row = np.argsort(per_row, kind="stable")
            values = np.unique(n)
            cuts = [np.searchsorted(of[order], values, side) for of, order in ((n, own), (per_row, by_row)) for side in ("left", "right")]
            orders[key] = own, by_row, list(zip(values.tolist(), *[c.tolist() for c in cuts], strict=True))
        own, by_row, groups = orders[key]
        sums, x = sums[own], x[by_row]
        for size, lo, hi, first, end in groups:
            if size:
                entry = self._entry(size)
                entry[0] += hi - lo
                entry[1] += x[first:end].T @ x[first:end]
                entry[2] += sums[lo:hi].T @ sums[lo:hi]

    def _entry(self, size: int) -> list:
        empty = lambda: np.zeros((self.width, self.width))
        return self.found.setdefault(int(size), [0, empty(), empty()])

    def close(self) -> None:
        sums, gram = self.open
        if sums[0]:
            entry = self._entry(sums[0])
            entry[0] += 1
            entry[1] += gram
            entry[2] += np.outer(sums, sums)
        self.open = np.zeros(self.width), np.zeros((self.width, self.width))


class Totals:
    """Likelihood of one model from its totals; theta is the variance ratio tau^2 / sigma^2.

    Everything is computed for many ratios at once: the likelihood's maximum and both profile limits are
    one-dimensional searches over the ratio, because with one coefficient held at v the residual sum of squares is
    rss + (v - estimate)^2 / variance, all three known functions of the ratio.
    """

    def __init__(self, rows: Sequence[Mapping], width: int, k: int):
        use = [*range(k), width - 1]
        self.sizes = np.array([r["n"] for r in rows], float)
        self.counts = np.array([r["m"] for r in rows], float)

        def fill(prefix: str) -> np.ndarray:
            out = np.zeros((len(rows), k + 1, k + 1))
            for r, row in enumerate(rows):
                for a, ca in enumerate(use):
                    for b, cb in enumerate(use):
                        out[r, a, b] = row[f"{prefix}{min(ca, cb)}_{max(ca, cb)}"]
            return out

        self.gram = fill("g").sum(axis=0)
        self.products = fill("p")
        self.n = float(self.sizes @ self.counts)

    def at(self, theta: np.ndarray):
        """(log determinant, residual sum of squares, coefficients, their covariance without sigma^2) per ratio."""
        theta = np.asarray(theta, float)
        shrink = theta[:, None] / (1.0 + theta[:, None] * self.sizes)
        w = self.gram - np.tensordot(shrink, self.products, axes=1)
        inv = np.linalg.inv(w[:, :-1, :-1])
        beta = (inv @ w[:, :-1, -1:])[:, :, 0]
        rss = np.maximum(w[:, -1, -1] - (w[:, :-1, -1] * beta).sum(axis=1), 1e-300)
        return np.log1p(theta[:, None] * self.sizes) @ self.counts, rss, beta, inv

    def deviance(self, logdet, rss):
        return logdet + self.n * (np.log(rss / self.n) + 1 + math.log(2 * math.pi))

    def fit(self, theta: float):
        """(deviance, beta, sigma2, covariance without sigma2)."""
        logdet, rss, beta, inv = self.at(np.array([theta]))
        return float(self.deviance(logdet, rss)[0]), beta[0], float(rss[0]) / self.n, inv[0]

    def slopes(self, theta: float):
        """First and second derivative by the ratio: of the log determinant, of rss; first one of the covariance."""
        _, beta, _, inv = self.fit(theta)
        scale = 1.0 + self.sizes * theta
        w1 = -np.tensordot(scale**-2, self.products, axes=1)
        w2 = np.tensordot(2 * self.sizes * scale**-3, self.products, axes=1)
        r = np.append(-beta, 1.0)
        turned = (w1 @ r)[:-1]
        rss = float(r @ w1 @ r), float(r @ w2 @ r - 2 * turned @ inv @ turned)
        logdet = float(self.counts @ (self.sizes / scale)), -float(self.counts @ (self.sizes / scale) ** 2)
        return logdet, rss, -inv @ w1[:-1, :-1] @ inv

    def best(self) -> float:
        """Variance ratio with the smallest deviance, searched on u = sqrt(theta) >= 0; below 1e-8 it counts as zero."""

        def gain(u: np.ndarray) -> np.ndarray:
            logdet, rss, *_ = self.at(u * u)
            return -self.deviance(logdet, rss)

        u = _zoom(gain, np.concatenate([[0.0], np.geomspace(1e-3, 1e3, 97)]), 1e-5)
        if u < 1e-4 or gain(np.array([0.0, u])).argmax() == 0:
            return 0.0
        theta = u * u
        for _ in range(20):  # the deviance is flat at its minimum; its derivative is not
            rss = self.fit(theta)[2] * self.n
            (l1, l2), (r1, r2), _ = self.slopes(theta)
            bend = l2 + self.n * (r2 / rss - (r1 / rss) ** 2)
            step = (l1 + self.n * r1 / rss) / bend if bend > 0 else 0.0
            if not abs(step) < 1e-3 * theta:
                break
            theta -= step
            if abs(step) < 1e-14 * theta:
                break
        return theta

    def satterthwaite_df(self, j: int, theta: float) -> float:
        """Degrees of freedom of one coefficient's t (Kuznetsova et al. 2017), in (sqrt(theta), sigma) at the optimum."""
        _, _, sigma2, inv = self.fit(theta)
        (l1, l2), (r1, r2), c1 = self.slopes(theta)
        u, sigma = math.sqrt(theta), math.sqrt(sigma2)
        cross = -4 * u * r1 / sigma**3
        hess = np.array([[2 * (l1 + r1 / sigma2) + 4 * theta * (l2 + r2 / sigma2), cross], [cross, 4 * self.n / sigma2]])
        grad = np.array([sigma2 * 2 * u * c1[j, j], 2 * sigma * inv[j, j]])
        values, vectors = np.linalg.eigh(hess)
        good = values > 1e-8 * max(values.max(), 1e-300)
        cov = 2 * (vectors[:, good] / values[good]) @ vectors[:, good].T
        spread = float(grad @ cov @ grad)
        return 2 * (sigma2 * inv[j, j]) ** 2 / spread if spread > 0 else math.inf

    def profile_limit(self, j: int, theta: float, side: int) -> float:
        """The furthest value of a coefficient whose profiled deviance exceeds the minimum by the 95 % quantile.

        At each ratio the values within the limit are an interval around the estimate, so the limit is the furthest
        end of all these intervals.
        """
        level = self.fit(theta)[0] + CHI2_95

        def end(u: np.ndarray) -> np.ndarray:
            logdet, rss, beta, inv = self.at(u * u)
            over = self.n * np.exp((level - logdet) / self.n - 1 - math.log(2 * math.pi)) - rss
            return np.where(over >= 0, side * beta[:, j] + np.sqrt(np.maximum(over, 0) * inv[:, j, j]), -np.inf)

        u = math.sqrt(theta)
        around = u * np.geomspace(0.1, 10, 97) if u else np.geomspace(1e-3, 1e3, 97)
        return side * float(end(np.array([_zoom(end, np.unique([0.0, u, *around]), 1e-9)]))[0])


def _zoom(value, grid: np.ndarray, precision: float) -> float:
    """Where a function with one peak is largest: ever finer grids around the best place so far."""
    while True:
        found = value(grid)
        at = int(np.argmax(found))
        lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        if hi - lo <= precision * (1e-3 + hi):
            return float(grid[at])
        grid = np.unique([*np.linspace(lo, hi, 17), grid[at]])


def solve(rows: Sequence[Mapping], width: int, k: int, j: int) -> dict:
    """Estimate, 95 % profile interval, Satterthwaite p and R^2 of coefficient ``j``."""
    t = Totals(rows, width, k)
    theta = t.best()
    dev, beta, sigma2, inv = t.fit(theta)
    se = math.sqrt(sigma2 * inv[j, j])
    dof = t.satterthwaite_df(j, theta)
    mean = t.gram[0, 1:-1] / t.n
    cov = t.gram[1:-1, 1:-1] / t.n - np.outer(mean, mean)
    fixed = float(beta[1:] @ cov @ beta[1:]) * t.n / (t.n - 1)
    tau2 = theta * sigma2
    total = fixed + tau2 + sigma2
    stat = beta[j] / se
    return {
        "coef": float(beta[j]), "se": se, "df": dof, "t": float(stat),
        "p_value": t_two_sided(float(stat), dof if math.isfinite(dof) else 1e12),
        "ci_lo": t.profile_limit(j, theta, -1), "ci_hi": t.profile_limit(j, theta, 1),
        "sigma2": sigma2, "tau2": tau2, "marginal_r2": fixed / total, "conditional_r2": (fixed + tau2) / total,
        "n_obs": int(t.n), "n_subjects": int(t.counts.sum()), "deviance": dev,
    }


def _per_model(totals: DataFrame, specs: Sequence[Spec], schema: str, solve_one) -> DataFrame:
    """``solve_one(spec, totals rows)`` for each model, as rows; as many partitions as models, however small they are."""
    # an expression cannot travel to a task, but the shape of a model can
    shapes = {s.name: (list(s.terms), s.report) for s in specs}
    width = max(len(s.terms) for s in specs) + 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["model"].iloc[0]
        terms, report = shapes[name]
        return pd.DataFrame(solve_one(name, terms, report, width, rows.to_dict("records")))

    # a given number of partitions is one that adaptive execution does not put together again
    return totals.repartition(len(specs), "model").groupBy("model").applyInPandas(run, schema)


def gls_at(spark: SparkSession, df: DataFrame, subject: str, spec: Spec, ratios: Sequence[float]) -> DataFrame:
    """Coefficients, residual variance and deviance at given variance ratios: the profile the fit minimises."""

    def at(name, terms, report, width, rows):
        totals = Totals(rows, width, len(terms) + 1)
        for theta in ratios:
            dev, beta, sigma2, _ = totals.fit(theta)
            for term, b in zip(["intercept", *terms], beta, strict=True):
                yield {"ratio": float(theta), "term": term, "coef": float(b), "sigma2": float(sigma2), "deviance": float(dev)}

    schema = "ratio double, term string, coef double, sigma2 double, deviance double"
    return _per_model(cluster_totals(df, subject, [spec]), [spec], schema, at)


RESULT_SCHEMA = (
    "model string, coef double, se double, df double, t double, p_value double, ci_lo double, ci_hi double, "
    "sigma2 double, tau2 double, marginal_r2 double, conditional_r2 double, n_obs bigint, n_subjects bigint, "
    "deviance double"
)


def fit_models(spark: SparkSession, df: DataFrame, subject: str, specs: Sequence[Spec]) -> DataFrame:
    """One result row per model."""

    def fitted(name, terms, report, width, rows):
        yield {"model": name, **solve(rows, width, len(terms) + 1, 1 + terms.index(report))}

    return _per_model(cluster_totals(df, subject, specs), specs, RESULT_SCHEMA, fitted)


# fixed values: network -> FDR family
FDR_FAMILIES = {
    "global": "regional", "hmod": "regional", "sensory": "regional",
    "dmn": "network", "control": "network", "salience": "network",
}


def battery(networks: Mapping[str, str], flag: str = "flag", memory: str = "memory", time: str = "time",
            age: str = "age_1", sex: str = "sex", years: str = "YoE") -> list[Spec]:
    """The four model kinds for every network column (columns already scaled as ``<c>_z``).

    group / group_change: coupling on status (and status x time);
    memory / memory_change: memory on coupling (and coupling x time).
    """
    z = lambda c: F.col(f"{c}_z")
    male = F.when(F.lower(F.col(sex)) == "male", 1.0).when(F.lower(F.col(sex)) == "female", 0.0)
    # one object for each column, so that the models share it
    shared = {"time": z(time), "age": z(age), "sex": male, "years": z(years)}
    status, outcome = F.col(flag).cast("double"), z(memory)
    changed = status * z(time)
    out = []
    for name, column in networks.items():
        coupling = z(column)
        out += [
            Spec(f"group|{name}", coupling, {"status": status, **shared}, "status"),
            Spec(f"group_change|{name}", coupling, {"status": status, **shared, "x": changed}, "x"),
            Spec(f"memory|{name}", outcome, {"coupling": coupling, **shared}, "coupling"),
            Spec(f"memory_change|{name}", outcome, {"coupling": coupling, **shared, "x": coupling * z(time)}, "x"),
        ]
    return out


def fit_battery(
    spark: SparkSession, long: DataFrame, subject: str, networks: Mapping[str, Mapping[str, str]], **columns
) -> DataFrame:
    """All models with FDR inside each (atlas, model kind, family); ``networks`` maps atlas -> network -> column."""
    from neurospan.operators.ordered import bh_fdr

    names = {"flag": "flag", "memory": "memory", "time": "time", "age": "age_1", "sex": "sex", "years": "YoE", **columns}
    measured = list(dict.fromkeys(c for own in networks.values() for c in own.values()))
    scaled = zscore(long, [*measured, names["memory"], names["time"], names["age"], names["years"]])
    specs = [
        replace(s, name=f"{s.name}|{atlas}") for atlas, own in networks.items() for s in battery(own, **names)
    ]
    res = fit_models(spark, scaled, subject, specs)
    parts = F.split("model", r"\|")
    named = res.withColumns({k: F.get(parts, F.lit(n)) for n, k in enumerate(("model", "network", "atlas"))})
    family = F.lit(None).cast("string")
    for net, fam in FDR_FAMILIES.items():
        family = F.when(F.col("network") == net, fam).otherwise(family)
    return bh_fdr(named.withColumn("family", family), keys=("atlas", "model", "family"))
