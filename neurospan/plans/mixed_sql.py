"""SQL twins of the mixed models: totals, elimination of small systems column by column, and grid searches by recursion."""

from __future__ import annotations

from collections.abc import Sequence

from neurospan.operators.mixed import CHI2_95
from neurospan.plans.registry import sql6

_PI = "pi()"


def _pairs(size: int, start: int = 0) -> list[tuple[int, int]]:
    return [(a, b) for a in range(start, size) for b in range(a, size)]


def _w(a: int, b: int) -> str:
    return f"w{min(a, b)}_{max(a, b)}"


def _weighted(points: str, size: int, keep: Sequence[str]) -> str:
    """The weighted cross products of every (model, u) of ``points``, with the log determinant."""
    cells = ", ".join(f"sum(t.g{a}_{b} - q.u * q.u / (1 + t.n * q.u * q.u) * t.p{a}_{b}) AS w{a}_{b}" for a, b in _pairs(size))
    own = ", ".join(f"q.{c}" for c in ("model", "u", *keep))
    return f"(SELECT {own}, sum(t.m * ln(1 + t.n * q.u * q.u)) AS logdet, sum(t.n * t.m)::DOUBLE AS nn, {cells} FROM {points} q JOIN tot t USING (model) GROUP BY {own})"


def _last(points: str, size: int, keep: Sequence[str]) -> str:
    """rss, estimate ``bj`` and variance ``cjj`` of the last regressor: all columns before it eliminated one by one."""
    inner, own = _weighted(points, size, keep), ", ".join(("model", "u", "logdet", "nn", *keep))
    for p in range(size - 2):
        cells = ", ".join(f"{_w(a, b)} - coalesce({_w(p, a)} * {_w(p, b)} / nullif({_w(p, p)}, 0), 0) AS {_w(a, b)}" for a, b in _pairs(size, p + 1))
        inner = f"(SELECT {own}, {cells} FROM {inner})"
    j, y = size - 2, size - 1
    return f"(SELECT {own}, {_w(j, y)} / {_w(j, j)} AS bj, 1 / {_w(j, j)} AS cjj, {_w(y, y)} - {_w(j, y)} * {_w(j, y)} / {_w(j, j)} AS rss FROM {inner})"


def _swept(points: str, size: int, keep: Sequence[str]) -> str:
    """All coefficients ``b0 ...``: every regressor eliminated from every row."""
    inner, own, y = _weighted(points, size, keep), ", ".join(("model", "u", *keep)), size - 1
    for p in range(size - 1):
        cells = []
        for a in range(size - 1):
            for b in range(size):
                if b <= p:
                    continue  # already a column of the identity
                now = (lambda r, c: f"v{r}_{c}") if p else _w
                own_row = f"coalesce({now(p, b)} / nullif({now(p, p)}, 0), 0)"
                cells.append((own_row if a == p else f"{now(a, b)} - {now(a, p)} * {own_row}") + f" AS v{a}_{b}")
        inner = f"(SELECT {own}, {', '.join(cells)} FROM {inner})"
    return f"(SELECT {own}, {', '.join(f'v{a}_{y} AS b{a}' for a in range(size - 1))} FROM {inner})"


_SCAN = "(SELECT 0.0::DOUBLE AS u UNION ALL SELECT pow(10, -3 + k / 16.0) FROM range(97) r(k))"


def fit_sql(rows: str, regressors: int) -> str:
    """CTEs up to ``fit`` with every column of a fitted model, from a CTE ``rows`` (model, id, z0 .. z<regressors>).

    ``z0`` is the intercept, ``z<regressors - 1>`` the reported term, the last one the outcome; a column of zeros in
    between stands for a term that a model lacks.
    """
    size = regressors + 1
    sums = ", ".join(f"sum(z{k}) AS s{k}" for k in range(size))
    grams = ", ".join(f"sum(z{a} * z{b}) AS g{a}_{b}" for a, b in _pairs(size))
    total = ", ".join(f"sum(g{a}_{b}) AS g{a}_{b}, sum(s{a} * s{b}) AS p{a}_{b}" for a, b in _pairs(size))
    dev = f"logdet + nn * (ln(rss / nn) + 1 + ln(2 * {_PI}))"
    over = f"(nn * exp((level - logdet) / nn - 1 - ln(2 * {_PI})) - rss)"
    end = f"CASE WHEN {over} >= 0 THEN side * bj + sqrt({over} * cjj) ELSE -1e300 END"
    zoomed = "SELECT *, greatest(0, c + hw * (k - 8) / 8) AS u FROM {0} CROSS JOIN range(17) r(k) WHERE lvl < 12"
    around = "(SELECT *, k, u0 * (1 + 0.01::DOUBLE * (k - 2)) AS u FROM top CROSS JOIN range(5) r(k))"
    first = "({p}0 - 8 * {p}1 + 8 * {p}3 - {p}4) / (12 * h)"
    second = "(-{p}0 + 16 * {p}1 - 30 * {p}2 + 16 * {p}3 - {p}4) / (12 * h * h)"
    five = lambda c: ", ".join(f"max({c}) FILTER (k = {k}) AS {c}{k}" for k in range(5))
    by_theta = "(SELECT *, k, theta, sqrt(theta * (1 + 0.01::DOUBLE * (k - 2))) AS u FROM opt CROSS JOIN range(5) r(k))"
    fixed = " + ".join(
        f"b{a} * b{b} * (g{min(a, b)}_{max(a, b)} / nn - g0_{a} * g0_{b} / (nn * nn))" for a in range(1, regressors) for b in range(1, regressors)
    )
    grand = ", ".join(f"sum(g{a}_{b}) AS g{a}_{b}" for a, b in _pairs(regressors))
    return f"""
    per AS (SELECT model, id, count(*)::DOUBLE AS n, {sums}, {grams} FROM {rows} GROUP BY model, id),
    tot AS (SELECT model, n, count(*)::DOUBLE AS m, {total} FROM per GROUP BY model, n),
    scan AS (SELECT model, arg_min(u, {dev}) AS c FROM {_last(f"(SELECT model, u FROM (SELECT DISTINCT model FROM tot) CROSS JOIN {_SCAN})", size, [])} GROUP BY model),
    best(model, lvl, c, hw) AS (
      SELECT model, 0, c, greatest(0.3 * c, 1e-3) FROM scan
      UNION ALL
      SELECT model, lvl + 1, arg_min(u, {dev}), any_value(hw) / 5
      FROM {_last(f"({zoomed.format('best')})", size, ["lvl", "hw"])} GROUP BY model, lvl
    ),
    top AS (SELECT model, CASE WHEN c < 1e-4 THEN 0 ELSE c END AS u0 FROM best WHERE lvl = 12),
    f5 AS (SELECT model, u0, 0.01::DOUBLE * u0 AS h, {five("f")} FROM (SELECT *, {dev} AS f FROM {_last(around, size, ["k", "u0"])}) GROUP BY model, u0),
    opt AS (SELECT model, CASE WHEN u0 = 0 THEN 0 ELSE pow(u0 - {first.format(p="f")} / ({second.format(p="f")}), 2) END AS theta FROM f5),
    at_ AS (
      SELECT model, theta, 0.01::DOUBLE * theta AS h, any_value(nn) AS nn, max(bj) FILTER (k = 2) AS bj, max({dev}) FILTER (k = 2) AS dev,
        {five("logdet")}, {five("rss")}, {five("cjj")}
      FROM {_last(by_theta, size, ["k", "theta"])} GROUP BY model, theta
    ),
    bent AS (
      SELECT *, rss2 / nn AS s2, CASE WHEN theta = 0 THEN 0 ELSE {first.format(p="logdet")} END AS l1, CASE WHEN theta = 0 THEN 0 ELSE {second.format(p="logdet")} END AS l2,
        CASE WHEN theta = 0 THEN 0 ELSE {first.format(p="rss")} END AS r1, CASE WHEN theta = 0 THEN 0 ELSE {second.format(p="rss")} END AS r2,
        CASE WHEN theta = 0 THEN 0 ELSE {first.format(p="cjj")} END AS c1 FROM at_
    ),
    curved AS (
      SELECT *, 2 * (l1 + r1 / s2) + 4 * theta * (l2 + r2 / s2) AS huu, -4 * sqrt(theta) * r1 / pow(s2, 1.5) AS hus, 4 * nn / s2 AS hss,
        s2 * 2 * sqrt(theta) * c1 AS gu, 2 * sqrt(s2) * cjj2 AS gs FROM bent
    ),
    free AS (
      SELECT *, CASE WHEN theta = 0 THEN nn ELSE 2 * pow(s2 * cjj2, 2)
        / (2 * (gu * gu * hss - 2 * gu * gs * hus + gs * gs * huu) / (huu * hss - hus * hus)) END AS df, bj / sqrt(s2 * cjj2) AS t FROM curved
    ),
    sides AS (SELECT model, side, theta, dev + {CHI2_95} AS level FROM free CROSS JOIN (VALUES (-1), (1)) v(side)),
    wide AS (
      SELECT model, side, level, arg_max(u, {end}) AS c FROM {_last(f'''(SELECT model, side, level, u FROM sides CROSS JOIN {_SCAN}
        UNION ALL SELECT model, side, level, sqrt(theta) FROM sides)''', size, ["side", "level"])} GROUP BY model, side, level
    ),
    ends(model, side, level, lvl, c, hw, value) AS (
      SELECT model, side, level, 0, c, greatest(0.3 * c, 1e-3), 0.0::DOUBLE FROM wide
      UNION ALL
      SELECT model, side, level, lvl + 1, arg_max(u, {end}), any_value(hw) / 5, max({end})
      FROM {_last(f"({zoomed.format('ends')})", size, ["side", "level", "lvl", "hw"])} GROUP BY model, side, level, lvl
    ),
    limits AS (SELECT model, max(-value) FILTER (side = -1) AS ci_lo, max(value) FILTER (side = 1) AS ci_hi FROM ends WHERE lvl = 12 GROUP BY model),
    betas AS (SELECT * FROM {_swept("(SELECT model, sqrt(theta) AS u FROM opt)", size, [])}),
    grams AS (SELECT model, sum(m)::BIGINT AS n_subjects, sum(n * m) AS nn, {grand} FROM tot GROUP BY model),
    spread AS (SELECT model, n_subjects, ({fixed}) * nn / (nn - 1) AS explained FROM grams JOIN betas USING (model)),
    -- two-sided t tail: cos(phi)^(df - 1) integrated by Simpson's rule, from the statistic's angle on and from zero on
    arcs AS (
      SELECT model, df, CASE WHEN df < 60 THEN pi() / 2 ELSE 12 / sqrt(df) END AS stop, least(atan(abs(t) / sqrt(df)), CASE WHEN df < 60 THEN pi() / 2 ELSE 12 / sqrt(df) END) AS start FROM free
    ),
    tails AS (
      SELECT model, sum(c * (stop - start) * pow(greatest(cos(start + (stop - start) * k / 2000.0), 0), df - 1)) / sum(c * stop * pow(greatest(cos(stop * k / 2000.0), 0), df - 1)) AS p
      FROM arcs CROSS JOIN (SELECT k, CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(2001) r(k)) GROUP BY model
    ),
    fit AS (
      SELECT model, bj AS coef, sqrt(s2 * cjj2) AS se, df, t, p AS p_value, ci_lo, ci_hi, s2 AS sigma2, theta * s2 AS tau2,
        explained / (explained + theta * s2 + s2) AS marginal_r2, (explained + theta * s2) / (explained + theta * s2 + s2) AS conditional_r2,
        nn::BIGINT AS n_obs, n_subjects, dev AS deviance
      FROM free JOIN limits USING (model) JOIN spread USING (model) JOIN tails USING (model)
    )"""


#: Result columns and the significant places they are compared to.
DIGITS = {
    "coef": 4, "se": 5, "df": 1, "t": 4, "p_value": 6, "ci_lo": 4, "ci_hi": 4, "sigma2": 3, "tau2": 3,
    "marginal_r2": 5, "conditional_r2": 5, "deviance": 3,
}


def rounded() -> str:
    return ", ".join(f"{sql6(c, d)} AS {c}" for c, d in DIGITS.items())
