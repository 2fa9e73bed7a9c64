"""Result cache, growing result tables, errors inside tasks, sections and figure tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurospan.operators import connectivity as N
from neurospan.operators import norms, ordered, report
from neurospan.session import scratch_dir
from neurospan.sources import sinks
from neurospan.streaming import incremental as inc


def test_cache_loads_until_inputs_or_settings_change(spark):
    source, folder, runs = scratch_dir(spark, "source"), scratch_dir(spark, "cache"), []
    spark.range(10).write.parquet(source)

    def compute():
        runs.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("n"))

    def call(**settings):
        return sinks.load_or_compute(spark, folder, [source], settings, compute).first()["n"]

    assert [call(a=1), call(a=1)] == [45, 45] and len(runs) == 1
    assert call(a=2) == 45 and len(runs) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert [call(a=1), call(a=1)] == [66, 66] and len(runs) == 3


def test_broken_off_result_is_computed_again(spark):
    source, folder = scratch_dir(spark, "source"), scratch_dir(spark, "cache")
    spark.range(3).write.parquet(source)

    def fails():
        return spark.range(1).select(F.raise_error(F.lit("stop")).cast("bigint").alias("n"))

    with pytest.raises(Exception, match="stop"):
        sinks.load_or_compute(spark, folder, [source], {}, fails)
    assert sinks.load_or_compute(spark, folder, [source], {}, lambda: spark.range(1)).count() == 1


def test_store_splits_its_buckets(spark):
    """Begun by ten rows, then fed thousands: no bucket holds far more than its share, and nothing is lost or doubled."""
    path = scratch_dir(spark, "growing")
    for n in (10, 500, 500, 6000):
        rows = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        inc.append_new(rows, path, ["k"], buckets=2, rows_per_bucket=100)
    per_bucket = spark.read.parquet(sinks.data_folder(spark, path)).groupBy(inc.BUCKET).count().agg(F.max("count")).first()[0]
    assert per_bucket < 300
    inc.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(2).alias("v")), path, ["k"], rows_per_bucket=100)
    inc.append_new(spark.range(6000).select(F.col("id").alias("k"), F.lit(9).alias("v")), path, ["k"], rows_per_bucket=100)
    got = inc.stored(spark, path).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {1: 5900, 2: 100}


def test_version_that_was_never_named_is_not_read(spark):
    path = scratch_dir(spark, "broken")
    inc.append_new(spark.range(5).withColumnRenamed("id", "k"), path, ["k"], buckets=2)
    spark.range(99).withColumnRenamed("id", "k").withColumn(inc.BUCKET, F.lit(0)).write.partitionBy(inc.BUCKET).parquet(f"{path}-v2")
    assert inc.stored(spark, path).count() == 5


def series(spark):
    rng = np.random.default_rng(3)
    rows = [(s, "a", f, [float(x) for x in rng.normal(size=4)]) for s in "12" for f in range(1100)]
    rows[1500] = ("2", "a", 400, [1.0, 2.0, float("inf"), 1.0])
    return spark.createDataFrame(rows, "subject_id string, ses string, frame int, signal array<double>")


def angry(x):
    if abs(x.sum()) > -1 and len(x) < 100:
        raise ArithmeticError("a short block")
    return N._co_moments(x)


def test_block_that_raises_ends_up_in_the_error_table(spark):
    table = series(spark).withColumn("signal", F.when(F.col("subject_id") == "1", F.col("signal")).otherwise(F.array(*[F.lit(1.0)] * 4)))
    blocks = N.stored_moments(table, measure=angry)
    errors = {r["subject_id"]: r for r in N.failed_blocks(blocks).collect()}
    assert set(errors) == {"1", "2"} and errors["1"]["reason"] == "ArithmeticError: a short block" and errors["1"]["n_blocks"] == 1
    good = N.stored_moments(table.where("subject_id = '1' and frame < 1024"), measure=angry)
    assert N.failed_blocks(good).isEmpty() and N.edges_of(good).count() == 6


def test_unusable_frames_have_a_reason_and_a_time(spark):
    blocks = N.stored_moments(series(spark))
    row = N.failed_blocks(blocks).collect()
    assert [(r["subject_id"], r["reason"], r["failed_at"] is not None) for r in row] == [("2", N.UNUSABLE, True)]
    assert {r["subject_id"] for r in N.edges_of(blocks).select("subject_id").distinct().collect()} == {"1"}


def test_arrow_step_runs_once(spark):
    plan = N.functional_edges(series(spark))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" not in plan  # stored before


def test_sections_from_data(spark):
    rows = spark.createDataFrame([(f"s{k % 3}", k, f"n{k}") for k in range(30)] + [(None, 1, "x")], "kind string, size int, name string")
    out = report.sectioned_top(rows, "kind", 2, [F.col("size").desc()], {"label": F.col("name"), "cell": F.col("size")}, "label")
    got = sorted(map(tuple, out.select("section_no", "section", "is_heading", "row_no", "label", "cell").collect()), key=lambda r: (r[0], r[3]))
    assert got[:2] == [(0, None, True, 0, None, ""), (0, None, False, 1, "x", "1")]
    assert got[2:5] == [(1, "s0", True, 0, "s0", ""), (1, "s0", False, 1, "n27", "27"), (1, "s0", False, 2, "n24", "24")]
    assert len(got) == 2 + 9


def test_figure_blocks_of_different_shape(spark):
    one = spark.createDataFrame([(2, 0.5), (1, None)], "roi int, value double")
    two = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0})], "roi int, cells map<string,double>")
    got = [tuple(r) for r in report.figure_blocks([("first", one, ["roi"]), ("second", two, ["roi"])]).orderBy("block_no", "row_no").collect()]
    assert got == [
        (0, "first", 1, {"roi": "1", "value": None}), (0, "first", 2, {"roi": "2", "value": "0.5"}),
        (1, "second", 1, {"roi": "1", "a": "1.0", "b": "2.0"}),
    ]


def test_as_of_merge(spark):
    known = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("a", 5, 40), ("b", 3, 30), ("b", None, 1), (None, 0, 7)], "k string, at int, v int")
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 5), ("a", 99), ("b", 2), ("b", 3), ("c", 3), (None, 3), ("a", None)], "k string, t int")
    got = {(r["k"], r["t"]): r["found"] for r in ordered.latest_known(rows, known, ["k"], "t", "at", "v", "found").collect()}
    assert got == {
        ("a", 0): None, ("a", 1): 10, ("a", 4): 10, ("a", 5): 50, ("a", 99): 50, ("b", 2): None, ("b", 3): 30, ("c", 3): None, (None, 3): None, ("a", None): None,
    }


def test_norm_rows_of_half_points_and_open_ends(spark):
    rows = [("T", "60–64", 0, "≤2", 1.0), ("T", "60–64", 1, "3–5", 2.0), ("T", "60–64", 2, "5–9", 3.0), ("T", "60–64", 3, "≥10", 4.0), ("T", "60–64", 4, "–", 9.0)]
    sheets = spark.createDataFrame(rows, "test string, band string, row_no int, raw_text string, scaled double")
    table = norms.AgeNorms(norms.tidy_age_norms(sheets))
    people = [(k, raw, age) for k, (raw, age) in enumerate([(-50.0, 61.0), (2.0, 61.0), (2.5, 61.0), (5.0, 61.0), (5.5, 61.0), (9.5, 61.0), (1e6, 61.0), (4.0, 20.0), (4.0, 99.0), (None, 61.0), (4.0, None)])]
    out = norms.by_age(spark.createDataFrame(people, "id int, raw double, age double"), table, "raw", "age", "T", "o")
    assert {r["id"]: r["o"] for r in out.collect()} == {0: 1.0, 1: 1.0, 2: None, 3: 2.0, 4: 3.0, 5: None, 6: 4.0, 7: 2.0, 8: 2.0, 9: None, 10: None}


def test_two_scores_for_one_place_are_an_error(spark):
    edu = spark.createDataFrame([("T", 10, 8, 1.0), ("T", 10, 8, 2.0)], "test string, age_scaled int, yoe int, scaled double")
    with pytest.raises(Exception, match="two scores"):
        norms.EducationNorms(edu)
