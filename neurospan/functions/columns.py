"""Scalar column expressions: identifiers, dates, scores, labels, formatting.

Everything here is a built-in Spark expression, so it stays in generated code.
Bad input gives NULL (``try_*`` functions), never an exception.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the study's definitions) -----------------------
COHORT_CUTOFF = 6000  # numeric ids above it belong to cohort "A"
TWO_DIGIT_YEAR_PIVOT = 25  # yy <= 25 is 20yy, later is 19yy
DAYS_PER_YEAR = 365.25
SENSORY_NETWORKS = ("Vis", "SomMot")
BOILERPLATE_COMMENTS = ("", " --", "A", "V")
BOILERPLATE_COMMENTS_B = ("", "NA", "ok", "yes")
NETWORK_NAMES = {
    "Default": "Default mode",
    "Cont": "Executive control",
    "DorsAttn": "Dorsal attention",
    "SalVentAttn": "Salience",
    "SomMot": "Somatomotor",
    "Limbic": "Limbic",
    "Vis": "Visual",
    "Subcortical": "Subcortical",
}
# -----------------------------------------------------------------------------


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text to double; anything unreadable, and NaN, becomes NULL."""
    value = as_col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def subject_key(c: Column | str) -> Column:
    """Canonical subject id: text without a leading ``sub-``."""
    return F.regexp_replace(F.trim(as_col(c).cast("string")), "^sub-", "")


def subject_number(c: Column | str) -> Column:
    return subject_key(c).try_cast("bigint")


def cohort(c: Column | str, cutoff: int = COHORT_CUTOFF, above: str = "A", below: str = "B") -> Column:
    """Cohort from the numeric id; NULL when the id is not a number."""
    n = subject_number(c)
    return F.when(n > cutoff, above).when(n <= cutoff, below)


def cohort_path(
    subject: Column | str, ses: Column | str, templates: Mapping[str, str], cutoff: int = COHORT_CUTOFF
) -> Column:
    """Cohort-dependent location: ``templates[cohort]`` formatted with (subject, ses)."""
    who = cohort(subject, cutoff)
    out = F.lit(None).cast("string")
    for name, template in templates.items():
        out = F.when(who == name, F.format_string(template, as_col(subject), as_col(ses))).otherwise(out)
    return out


def recode(c: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Map listed values; others become ``default`` (NULL when not given)."""
    source = as_col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(source == old, new) if out is None else out.when(source == old, new)
    return out.otherwise(default) if default is not None else out


# --- dates -------------------------------------------------------------------


def month_day_year(c: Column | str, pivot: int = TWO_DIGIT_YEAR_PIVOT) -> Column:
    """``m/d/y`` text to date, repairing two-digit years around ``pivot``."""
    parts = F.split(F.trim(as_col(c)), "/")
    year = F.get(parts, F.lit(2)).try_cast("int")
    full = F.when((year < 100) & (year <= pivot), year + 2000).when(year < 100, year + 1900).otherwise(year)
    text = F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), full.cast("string"))
    return F.when(full.isNotNull(), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))


def mixed_date(c: Column | str) -> Column:
    """Spreadsheet dates: ``yyyy-dd-MM 00:00:00`` when a midnight is present, else ``d/M/yyyy``."""
    text = F.trim(as_col(c))
    stamped = F.try_to_timestamp(text, F.lit("yyyy-dd-MM HH:mm:ss"))
    plain = F.try_to_timestamp(text, F.lit("d/M/yyyy"))
    return F.when(text.contains("00:00:00"), stamped).otherwise(plain).cast("date")


def lenient_date(
    c: Column | str, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy/MM/dd")
) -> Column:
    """First format that parses; NULL when none does."""
    text = F.trim(as_col(c))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def age_by_days(birth: Column | str, visit: Column | str) -> Column:
    return F.date_diff(as_col(visit), as_col(birth)) / F.lit(DAYS_PER_YEAR)


def age_by_parts(birth: Column | str, visit: Column | str) -> Column:
    """Year difference plus month twelfths plus day difference over 365.25."""
    b, v = as_col(birth), as_col(visit)
    return (
        (F.year(v) - F.year(b)).cast("double")
        + (F.month(v) - F.month(b)) / F.lit(12.0)
        + (F.day(v) - F.day(b)) / F.lit(DAYS_PER_YEAR)
    )


# --- scores and flags ----------------------------------------------------------


def sentinel_to_null(c: Column | str, sentinel: float = -1) -> Column:
    return F.nullif(as_col(c), F.lit(sentinel))


def whole_down(c: Column | str) -> Column:
    return F.floor(as_col(c))


def round_half_even(c: Column | str) -> Column:
    return F.bround(as_col(c), 0)


def clamp(c: Column | str, lo: Column, hi: Column) -> Column:
    """NULL stays NULL (``least``/``greatest`` alone would drop it)."""
    v = as_col(c)
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def range_bounds(text: Column | str) -> Column:
    """Parse a normative score range into ``struct(lo, hi)``; NULL side = unbounded.

    Forms: ``>=k`` written with the sign U+2265, ``<=k`` with U+2264, ``a-b`` with an
    en dash, a single ``k``; a lone dash means "no score" and gives a NULL struct.
    """
    t = F.regexp_replace(F.trim(as_col(text).cast("string")), r"\s+", "")
    low = F.regexp_extract(t, "^≥(-?[0-9.]+)$", 1)
    high = F.regexp_extract(t, "^≤(-?[0-9.]+)$", 1)
    left = F.regexp_extract(t, "^(-?[0-9.]+)–(-?[0-9.]+)$", 1)
    right = F.regexp_extract(t, "^(-?[0-9.]+)–(-?[0-9.]+)$", 2)
    one = F.regexp_extract(t, "^(-?[0-9.]+)$", 1)

    def pair(lo, hi):
        return F.struct(lo.try_cast("double").alias("lo"), hi.try_cast("double").alias("hi"))

    nothing = F.lit(None).cast("string")
    return (
        F.when(low != "", pair(low, nothing))
        .when(high != "", pair(nothing, high))
        .when(left != "", pair(left, right))
        .when(one != "", pair(one, one))
    )


def in_bounds(v: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi))


def at_least_flag(c: Column | str, cut: float) -> Column:
    """1 / 0 / NULL for reached / not reached / unknown."""
    v = as_col(c)
    return F.when(v >= cut, 1).when(v < cut, 0)


def all_known(*cols: Column | str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & as_col(c).isNotNull()
    return out


def visit_flag(memory_flag: Column | str, norms: Sequence[Column | str], floor: float = 7.0) -> Column:
    """1 when the memory flag is set and every norm reaches ``floor``; NULL if anything is missing."""
    ok = as_col(memory_flag) == 1
    for n in norms:
        ok = ok & (as_col(n) >= floor)
    return F.when(all_known(memory_flag, *norms), ok.cast("int"))


def both_visits_flag(first: Column | str, second: Column | str) -> Column:
    a, b = as_col(first), as_col(second)
    return F.when(a.isNotNull() & b.isNotNull(), ((a == 1) & (b == 1)).cast("int"))


def annual_change(v1: Column | str, v2: Column | str, age1: Column | str, age2: Column | str) -> Column:
    """(v2 - v1) / (age2 - age1); NULL when the gap is zero or unknown."""
    return F.try_divide(as_col(v2) - as_col(v1), as_col(age2) - as_col(age1))


def percent(count: Column, denominator: Column) -> Column:
    return F.try_divide(count * F.lit(100.0), denominator)


# --- region and feature labels ---------------------------------------------------


def is_subcortical(roi: Column | str) -> Column:
    return as_col(roi).startswith("Subcortical")


def network(roi: Column | str) -> Column:
    """Third ``_`` token of a cortical label; ``Subcortical`` for the rest; NULL if malformed."""
    r = as_col(roi)
    return F.when(is_subcortical(r), F.lit("Subcortical")).otherwise(F.get(F.split(r, "_"), F.lit(2)))


def hemisphere(roi: Column | str) -> Column:
    r = as_col(roi)
    return (
        F.when(is_subcortical(r) & r.contains("Left"), "LH")
        .when(is_subcortical(r) & r.contains("Right"), "RH")
        .otherwise(F.get(F.split(r, "_"), F.lit(1)))
    )


def structure(roi: Column | str) -> Column:
    """Side-free structure name of ``Subcortical <n>: <Side> <Name>``; NULL for cortex."""
    r = as_col(roi)
    name = F.trim(F.get(F.split(r, ":"), F.lit(1)))
    return F.when(is_subcortical(r), F.trim(F.regexp_replace(name, "^(Left|Right)", "")))


def domain(roi: Column | str) -> Column:
    """``sensory`` for visual and somatomotor cortex, ``hmod`` for everything else."""
    r = as_col(roi)
    sensory = ~is_subcortical(r) & network(r).isin(*SENSORY_NETWORKS)
    return F.when(F.coalesce(sensory, F.lit(False)), "sensory").otherwise("hmod")


def edge_ends(edge_name: Column | str) -> tuple[Column, Column]:
    pattern = "([^-]+)-([^-]+)"
    return (
        F.trim(F.regexp_extract(as_col(edge_name), pattern, 1)),
        F.trim(F.regexp_extract(as_col(edge_name), pattern, 2)),
    )


def feature_kind(feature: Column | str) -> Column:
    return F.when(as_col(feature).endswith("_slope"), "slope").otherwise("baseline")


def feature_region(feature: Column | str) -> Column:
    return F.regexp_replace(as_col(feature), "_(1|slope)$", "")


def feature_network(feature: Column | str) -> Column:
    f = as_col(feature)
    third = F.get(F.split(f, "_"), F.lit(2))
    return (
        F.when(f.startswith("7Networks_"), F.coalesce(third, F.lit("Other")))
        .when(is_subcortical(f), "Subcortical")
        .otherwise("Other")
    )


def encode_label(c: Column | str, offset: int) -> Column:
    """Shift a non-zero label into its own range; background stays 0."""
    v = as_col(c)
    return F.when(v != 0, v + offset).otherwise(F.lit(0))


# --- text for tables ----------------------------------------------------------


def fixed(c: Column | str, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value (0.24375 lies below the tie and gives 0.2437)."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", as_col(c).cast("double"), F.lit(pattern))


def mean_sd(mean: Column, sd: Column) -> Column:
    return F.concat(fixed(mean, 2), F.lit(" ("), fixed(sd, 2), F.lit(")"))


def mean_range(mean: Column, lo: Column, hi: Column) -> Column:
    def bound(v):
        return F.when(v == F.floor(v), fixed(v, 0)).otherwise(fixed(v, 1))

    return F.concat(fixed(mean, 2), F.lit(" ("), bound(lo), F.lit("–"), bound(hi), F.lit(")"))


def p_floor_text(p: Column | str, digits: int = 4) -> Column:
    v = as_col(p)
    smallest = f"{10.0 ** -digits:.{digits}f}"
    return F.when(v.isNull(), "").when(v < float(smallest), f"<{smallest}").otherwise(fixed(v, digits))


def p_stars_text(p: Column | str, digits: int = 4) -> Column:
    v = as_col(p)
    stars = F.when(v < 0.001, "***").when(v < 0.01, "**").when(v < 0.05, "*").otherwise("")
    return F.when(v.isNull(), "").otherwise(F.concat(fixed(v, digits), stars))


def p_inline_text(p: Column | str, digits: int = 4) -> Column:
    """Inline form with its sign: ``=0.0450`` or ``<0.0001``; ``=NA`` when missing."""
    v = as_col(p)
    smallest = f"{10.0 ** -digits:.{digits}f}"
    return (
        F.when(v.isNull(), "=NA")
        .when(v < float(smallest), f"<{smallest}")
        .otherwise(F.concat(F.lit("="), fixed(v, digits)))
    )


def ci_text(lo: Column | str, hi: Column | str, digits: int = 4) -> Column:
    return F.concat(fixed(lo, digits), F.lit(" to "), fixed(hi, digits))


def coef_ci_text(coef: Column | str, lo: Column | str, hi: Column | str, digits: int = 4) -> Column:
    dash = F.when(as_col(hi) < 0, "- ").otherwise("-")
    return F.concat(fixed(coef, digits), F.lit(" ("), fixed(lo, digits), dash, fixed(hi, digits), F.lit(")"))


def significance(p: Column | str, p_fdr: Column | str, alpha: float = 0.05) -> Column:
    return (
        F.when(as_col(p_fdr) < alpha, "fdr")
        .when(as_col(p) < alpha, "nominal")
        .otherwise("none")
    )
