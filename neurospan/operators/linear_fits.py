"""The two small linear classifiers fitted inside a resampling task (numpy)."""

from __future__ import annotations

import numpy as np


def scale_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column means and population SDs of the training rows; constant columns divide by 1."""
    sd = x.std(axis=0)
    return x.mean(axis=0), np.where(sd > 0, sd, 1.0)


def elastic_net(x: np.ndarray, y: np.ndarray, c: float, l1_ratio: float, start: np.ndarray | None = None,
                tol: float = 1e-6, max_iter: int = 5000) -> np.ndarray:
    """Weights (intercept last) of C * log-loss + elastic-net penalty; the intercept is not penalised.

    Accelerated proximal gradient with restart; ``start`` warm-starts a path over C.
    """
    n, p = x.shape
    design = np.hstack([x, np.ones((n, 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    ridge = (1.0 - l1_ratio) * np.append(np.ones(p), 0.0)
    step = 1.0 / (c * 0.25 * np.linalg.norm(design, 2) ** 2 + (1.0 - l1_ratio))
    cut = np.append(np.full(p, step * l1_ratio), 0.0)
    w = np.zeros(p + 1) if start is None else start.copy()
    v, t = w, 1.0
    for _ in range(max_iter):
        grad = ridge * v - c * (design.T @ (sign / (1.0 + np.exp(np.clip(sign * (design @ v), -500, 500)))))
        moved = v - step * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - cut, 0.0)
        if (v - new) @ (new - w) > 0:
            t = 1.0
        t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        v = new + (t - 1.0) / t_new * (new - w)
        done = np.abs(new - w).max() <= tol * max(1.0, np.abs(new).max())
        w, t = new, t_new
        if done:
            break
    return w


def with_ones(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with the intercept's column, and their Gram matrix: neither depends on labels or penalty."""
    design = np.hstack([x, np.ones((len(x), 1))])
    return design, design.T @ design


def linear_svm(x: np.ndarray, y: np.ndarray, c: float, max_iter: int = 100, shared: tuple | None = None) -> np.ndarray:
    """Weights (intercept last) of 1/2 |w|^2 + C * squared hinge; the intercept is penalised too.

    Newton steps on the points inside the margin, with step halving.  Their Gram matrix is that of all points without the
    others', whichever are fewer; ``shared``: ``with_ones(x)``, if at hand.
    """
    design, gram = shared or with_ones(x)
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(w, side):
        gap = np.maximum(1.0 - side, 0.0)
        return 0.5 * w @ w + c * gap @ gap

    w = np.zeros(design.shape[1])
    for _ in range(max_iter):
        side = sign * (design @ w)
        gap = np.maximum(1.0 - side, 0.0)
        grad = w - 2.0 * c * ((sign * gap) @ design)
        inside = gap > 0
        few = 2 * np.count_nonzero(inside) <= len(inside)
        some = design[inside if few else ~inside]
        hess = np.eye(len(w)) + 2.0 * c * (some.T @ some if few else gram - some.T @ some)
        move = np.linalg.solve(hess, grad)
        if np.abs(move).max() < 1e-9:
            break
        size, here, slope, turn = 1.0, loss(w, side), grad @ move, sign * (design @ move)
        while size > 1e-6 and loss(w - size * move, side - size * turn) > here - 1e-4 * size * slope:
            size /= 2.0
        w = w - size * move
    return w


def scaled_sums(gram: np.ndarray, target: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """What an SVM needs of its training rows, scaled as by :func:`scale_fit`, from sums over the rows [x, 1].

    ``gram`` is [x, 1]' [x, 1] and ``target`` [x, 1]' sign; ``constant`` marks columns that are 0 everywhere.  Returns the
    matrix that takes weights on scaled features to weights on x, both sums on scaled features, and whether they hold: with
    x scaled over more rows, sums do not tell a variance that is very small in these rows from none.
    """
    mean = gram[-1, :-1] / gram[-1, -1]
    var = np.diag(gram)[:-1] / gram[-1, -1] - mean * mean
    varies = var > 1e-6
    sd = np.sqrt(np.where(varies, var, 1.0))
    back = np.diag(np.append(1.0 / sd, 1.0))
    back[-1, :-1] = -mean / sd
    return back, back.T @ gram @ back, target @ back, bool((varies | constant).all())


def svm_path(gram: np.ndarray, target: np.ndarray, cs: np.ndarray, back: np.ndarray, radius: float, rows) -> np.ndarray:
    """Weights of :func:`linear_svm` on scaled features, one row per C, from the sums of :func:`scaled_sums`.

    From zero all points lie inside the margin, so the first Newton step needs the sums only.  It is the minimum if it puts
    no point outside; that is certain, without looking at them, where no row of x (their largest norm is ``radius``) can
    reach a score of 1.  Otherwise ``rows`` gives [x, 1] and the signs, and the steps go on for all such C at once.
    """
    eye = np.eye(len(gram))
    ridge = 2.0 * np.asarray(cs)[:, None]
    w = np.linalg.solve(eye + ridge[:, :, None] * gram, (ridge * target)[:, :, None])[:, :, 0]
    on_x = w @ back.T
    live = np.flatnonzero(~(np.abs(on_x[:, -1]) + np.linalg.norm(on_x[:, :-1], axis=1) * radius < 1.0))
    if len(live):
        design, sign = rows()
        together = max(1, 2_000_000 // max(1, len(sign)))  # as many C as keep the arrays small
        for k in range(0, len(live), together):
            _newton(w, live[k:k + together], gram, ridge, back, design, sign)
    return w


def _newton(w: np.ndarray, live: np.ndarray, gram: np.ndarray, ridge: np.ndarray, back: np.ndarray, design: np.ndarray,
            sign: np.ndarray, max_iter: int = 100) -> None:
    """Newton steps of the rows ``live`` of ``w``, in place, as in :func:`linear_svm`."""
    eye = np.eye(len(gram))
    for _ in range(max_iter):
        side = sign * ((w[live] @ back.T) @ design.T)
        gap = np.maximum(1.0 - side, 0.0)
        grad = w[live] - ridge[live] * (((sign * gap) @ design) @ back)
        hess = np.empty((len(live), *gram.shape))
        for j, k in enumerate(live):
            inside = gap[j] > 0
            few = 2 * np.count_nonzero(inside) <= len(inside)
            some = design[inside if few else ~inside]
            part = back.T @ (some.T @ some) @ back
            hess[j] = eye + ridge[k] * (part if few else gram - part)
        move = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        on = np.flatnonzero(~(np.abs(move).max(axis=1) < 1e-9))
        live, move, grad, side = live[on], move[on], grad[on], side[on]
        if not len(live):
            return
        turn = sign * ((move @ back.T) @ design.T)
        for j, k in enumerate(live):
            c = ridge[k, 0] / 2.0

            def loss(v, s):
                gap = np.maximum(1.0 - s, 0.0)
                return 0.5 * v @ v + c * gap @ gap

            size, here, slope = 1.0, loss(w[k], side[j]), grad[j] @ move[j]
            while size > 1e-6 and loss(w[k] - size * move[j], side[j] - size * turn[j]) > here - 1e-4 * size * slope:
                size /= 2.0
            w[k] -= size * move[j]


def rank_auc(y: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """AUC of each score column with ties counted one half."""
    scores = scores.reshape(len(y), -1)
    n1 = int(y.sum())
    n0 = len(y) - n1
    if n1 == 0 or n0 == 0:
        return np.full(scores.shape[1], np.nan)
    positive = y == 1
    out = np.empty(scores.shape[1])
    for k in range(scores.shape[1]):
        column = np.ascontiguousarray(scores[:, k])
        order = np.argsort(column)
        placed = column[order]
        if (placed[1:] > placed[:-1]).all():  # no ties, nothing unknown
            ranks = np.flatnonzero(positive[order]).sum() + float(n1)
        else:
            _, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
            ranks = (np.cumsum(counts) - (counts - 1) / 2.0)[inverse][positive].sum()
        out[k] = (ranks - n1 * (n1 + 1) / 2.0) / (n1 * n0)
    return out
