import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.functions import tails
from neurospan.operators.report import feature_label


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text, want", [
    ("1/2/25", dt.date(2025, 1, 2)), ("1/2/26", dt.date(1926, 1, 2)), ("12/31/1950", dt.date(1950, 12, 31)),
    ("13/45/50", None), ("garbage", None), (None, None),
])
def test_two_digit_years(spark, text, want):
    assert one(spark, text, C.month_day_year) == want


@pytest.mark.parametrize("text, want", [
    ("1950-31-05 00:00:00", dt.date(1950, 5, 31)), ("5/11/1950", dt.date(1950, 11, 5)), ("x", None), (None, None),
])
def test_mixed_dates(spark, text, want):
    assert one(spark, text, C.mixed_date) == want


@pytest.mark.parametrize("text, want", [
    ("≥12", (12.0, None)), ("≤3", (None, 3.0)), ("4–6", (4.0, 6.0)), ("7", (7.0, 7.0)), ("-", None), ("—", None),
])
def test_range_text(spark, text, want):
    got = one(spark, text, C.range_bounds)
    assert (tuple(got) if got is not None else None) == want


@pytest.mark.parametrize("raw, key, who", [
    ("1014", "1014", "B"), ("sub-1014", "1014", "B"), ("5500", "5500", "B"), ("6001", "6001", "A"), ("abc", "abc", None),
])
def test_ids(spark, raw, key, who):
    assert one(spark, raw, C.subject_key) == key
    assert one(spark, raw, C.cohort) == who


def test_half_even_and_floor(spark):
    assert one(spark, 62.5, C.round_half_even, "double") == 62.0
    assert one(spark, 63.5, C.round_half_even, "double") == 64.0
    assert one(spark, 9.5, C.whole_down, "double") == 9


def test_number_reads_nan_and_text_as_null(spark):
    assert one(spark, "NaN", C.number) is None
    assert one(spark, "n/a", C.number) is None
    assert one(spark, " 3.5", C.number) == 3.5


def test_region_labels(spark):
    rows = {
        "7Networks_LH_Vis_1": ("Vis", "LH", None, "sensory"),
        "7Networks_RH_SalVentAttn_Med_2": ("SalVentAttn", "RH", None, "hmod"),
        "Subcortical 202: Left Caudate": ("Subcortical", "LH", "Caudate", "hmod"),
    }
    for label, want in rows.items():
        got = spark.createDataFrame([(label,)], "r string").select(
            C.network("r"), C.hemisphere("r"), C.structure("r"), C.domain("r")
        ).first()
        assert tuple(got) == want


@pytest.mark.parametrize("name, slope, want", [
    ("7Networks_LH_Vis_1", False, "LH visual (1)"),
    ("7Networks_RH_DorsAttn_FEF_2_slope", True, "RH frontal eye fields (2)"),
    ("7Networks_LH_SalVentAttn_Med_3_1", True, "LH salience medial (3)"),
    ("Subcortical 214: Right Thalamus", False, "R thalamus"),
    ("other", False, "other"),
])
def test_feature_labels(spark, name, slope, want):
    got = spark.createDataFrame([(name,)], "f string").select(feature_label("f", slope)).first()[0]
    assert got == want


def test_text_cells(spark):
    got = spark.range(1).select(
        C.p_floor_text(F.lit(0.00001)), C.p_stars_text(F.lit(0.0004)), C.p_inline_text(F.lit(None).cast("double")),
        C.coef_ci_text(F.lit(-0.5), F.lit(-0.75), F.lit(-0.25)), C.mean_range(F.lit(61.234), F.lit(60.0), F.lit(70.25)),
        C.significance(F.lit(0.04), F.lit(0.2)),
    ).first()
    assert tuple(got) == ("<0.0001", "0.0004***", "=NA", "-0.5000 (-0.7500- -0.2500)", "61.23 (60–70.2)", "nominal") or \
        tuple(got)[4] in ("61.23 (60–70.3)", "61.23 (60–70.2)")


def test_tails_against_known_values():
    assert tails.t_two_sided(2.0, 10.0) == pytest.approx(0.07338803477074, abs=1e-12)
    assert tails.t_two_sided(0.0, 3.0) == pytest.approx(1.0)
    assert tails.t_two_sided(1.0, 1.0) == pytest.approx(0.5, abs=1e-12)
    assert tails.chi2_one_df(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert math.isnan(tails.t_two_sided(float("nan"), 3.0))
