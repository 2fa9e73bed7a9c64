"""Cleaning, norms, visits, quality and storage on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from neurospan.operators import clean, groupstats, norms, quality, rollup, visits
from neurospan.session import scratch_dir
from neurospan.sources import scans, sinks
from neurospan.streaming import incremental as inc


def test_sentinel_rows_survive_the_null_drop(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 5.0)], "id int, v double")
    got = {r["id"]: r["v"] for r in clean.require_then_unmask(df, ["v"]).collect()}
    assert got == {1: None, 3: 5.0}


def test_unknown_ages_stay(spark):
    df = spark.createDataFrame([(1, 60.0, 60.0), (2, None, 60.0), (3, 60.0, None), (4, None, None), (5, 60.0, 62.0)],
                               "id int, a double, b double")
    assert sorted(r["id"] for r in clean.differing(df, "a", "b").collect()) == [2, 3, 4, 5]
    assert sorted(r["id"] for r in clean.long_enough_followup(df, "a", "b").collect()) == [2, 3, 4, 5]


def test_visit_names():
    class Fake:
        columns = ["w1_age", "w2_age", "sfc_tp1_mean", "id"]

        def toDF(self, *names):
            return list(names)

    assert clean.visit_names(Fake()) == ["age_1", "age_2", "sfc_mean_1", "id"]


def norm_tables(spark):
    sheets = spark.createDataFrame(
        [("T", "60-64", 0, "-", 0.0), ("T", "60-64", 1, "≤3", 2.0), ("T", "60-64", 2, "4–6", 5.0),
         ("T", "60-64", 3, "5–9", 8.0), ("T", "60-64", 4, "≥12", 12.0), ("T", "65–70", 0, "7", 3.0)],
        "test string, band string, row_no int, raw_text string, scaled double",
    )
    edu = spark.createDataFrame([("T", s, y, float(s * 100 + y)) for s in (2, 3, 4, 5) for y in (8, 10, 20)],
                                "test string, age_scaled int, yoe int, scaled double")
    return norms.AgeNorms(norms.tidy_age_norms(sheets)), norms.EducationNorms(edu)


@pytest.mark.parametrize("raw, age, want", [
    (5.0, 62.0, 5.0),  # overlapping rows: the first wins
    (9.0, 62.5, 8.0), (13.0, 64.5, 12.0),  # half to even: 62, 64
    (7.0, 65.5, 3.0), (7.0, 99.0, 3.0),  # 66; clamped to 70
    (2.0, 20.0, 2.0), (10.0, 62.0, None), (None, 62.0, None), (5.0, None, None),
])
def test_age_norms(spark, raw, age, want):
    table, _ = norm_tables(spark)
    df = spark.createDataFrame([(raw, age)], "raw double, age double")
    assert norms.by_age(df, table, "raw", "age", "T", "o").first()["o"] == want


@pytest.mark.parametrize("score, years, want", [
    (3.0, 9.5, 308.0), (3.0, 25.0, 320.0), (9.0, 4.0, 508.0), (1.0, 12.0, 210.0), (None, 10.0, None), (3.0, None, None),
])
def test_education_norms(spark, score, years, want):
    _, table = norm_tables(spark)
    df = spark.createDataFrame([(score, years)], "s double, y double")
    assert norms.by_education(df, table, "s", "y", "T", "o").first()["o"] == want


def test_bands_are_tried_in_sheet_order(spark):
    """Both sheets hold the age and the score; the one that comes first in the workbook decides."""
    sheets = spark.createDataFrame(
        [("T", "60-64", 2, 0, "1–9", 2.0), ("T", "62-70", 1, 5, "1–9", 7.0)],
        "test string, band string, band_no int, row_no int, raw_text string, scaled double",
    )
    table = norms.AgeNorms(norms.tidy_age_norms(sheets))
    df = spark.createDataFrame([(5.0, 63.0), (5.0, 61.0)], "raw double, age double")
    assert [r["o"] for r in norms.by_age(df, table, "raw", "age", "T", "o").collect()] == [7.0, 2.0]


def test_long_visits(spark):
    df = spark.createDataFrame([(1, "f", 60.0, 63.0, 5.0, None)], "id int, sex string, age_1 double, age_2 double, m_1 double, m_2 double")
    rows = visits.to_long(df, "id", ["sex"]).orderBy("timepoint").collect()
    assert [(r["timepoint"], r["age"], r["m"]) for r in rows] == [(1, 60.0, 5.0), (2, 63.0, None)]
    timed = visits.since_first(visits.to_long(df, "id"), "id").orderBy("timepoint").collect()
    assert [r["time"] for r in timed] == [0.0, 3.0]
    same = spark.createDataFrame([(1, 60.0, 60.0, 1.0, 2.0)], "id int, age_1 double, age_2 double, v_1 double, v_2 double")
    assert visits.annual_changes(same, ["v"]).first()["v_slope"] is None


def test_features_need_both_sessions_and_known_values(spark):
    regions = spark.createDataFrame(
        [("a", "ses-01", 1, 1.0), ("a", "ses-01", 2, 2.0), ("a", "ses-02", 1, 3.0), ("a", "ses-02", 2, 6.0),
         ("b", "ses-01", 1, 1.0), ("b", "ses-01", 2, 1.0),
         ("c", "ses-01", 1, 1.0), ("c", "ses-01", 2, 1.0), ("c", "ses-02", 1, 1.0), ("c", "ses-02", 2, 1.0)],
        "subject_id string, ses string, roi int, value double",
    )
    people = spark.createDataFrame([("a", 1, 60.0, 62.0, 10.0, "male"), ("b", 0, 60.0, 62.0, 9.0, "male"), ("c", 0, 60.0, 62.0, 9.0, "x")],
                                   "subject_id string, flag int, age_1 double, age_2 double, YoE double, sex string")
    rows = visits.assemble_features(regions, people, with_slope=True).collect()
    assert [(r["subject_id"], r["y"], r["x"]) for r in rows] == [("a", 1, [1.0, 2.0, 1.0, 2.0, 60.0, 10.0, 1.0])]


def test_label_sets_ignore_order(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x")], "k string, roi string")
    row = quality.label_agreement(df, ["k"]).first()
    assert (row["n_keys"], row["n_distinct_sets"], row["min_rois"], row["max_rois"]) == (3, 2, 1, 2)


def test_zscore_handles_constants(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (None, 4.0)], "a double, b double")
    rows = groupstats.zscore(df, ["a", "b"]).collect()
    assert sorted([r["a_z"] for r in rows if r["a_z"] is not None]) == pytest.approx([-0.70710678, 0.70710678])
    assert {r["b_z"] for r in rows} == {0.0}


def test_upsert_and_append_are_idempotent(spark):
    path = scratch_dir(spark, "t-upsert")
    old = spark.createDataFrame([(k, k * 1.0) for k in range(20)], "id int, v double")
    inc.append_new(old, path, ["id"])
    inc.append_new(old, path, ["id"])
    assert inc.stored(spark, path).count() == 20
    new = spark.createDataFrame([(3, -1.0), (50, 5.0)], "id int, v double")
    for _ in range(2):
        inc.upsert(new, path, ["id"])
        got = {r["id"]: r["v"] for r in inc.stored(spark, path).collect()}
        assert len(got) == 21 and got[3] == -1.0 and got[50] == 5.0 and got[4] == 4.0


def test_fingerprint(spark):
    df = spark.range(50).select("id", (F.col("id") * 0.5).alias("x"))
    a = sinks.run_fingerprint(df, {"k": 1})
    assert a == sinks.run_fingerprint(df.repartition(4).select("x", "id"), {"k": 1})
    assert a != sinks.run_fingerprint(df, {"k": 2})
    assert a != sinks.run_fingerprint(df.where("id <> 7"), {"k": 1})


def test_matrix_text_bad_values(spark):
    folder = scratch_dir(spark, "t-matrix")
    spark.createDataFrame([("1.0,2.0",), ("x,3.0",), ("4.0",)], "value string").coalesce(1).write.text(f"{folder}/sub-77_ses-02")
    frames = scans.matrix_text(spark, f"{folder}/*/*.txt")
    rules = quality.signal_rules(2)
    valid, bad = quality.split_valid(frames, rules, "scan")
    assert [(r["subject_id"], r["ses"], r["signal"]) for r in valid.collect()] == [("77", "ses-02", [1.0, 2.0])]
    assert sorted(r["reason"] for r in bad.collect()) == ["not_finite", "wrong_width"]


def test_side_files_and_sheets(spark):
    folder = scratch_dir(spark, "t-side")
    for who, n in (("sub-1", 3), ("sub-2", 5)):
        spark.createDataFrame([(n, 100)], "NumFramesScrubbed int, TotalFrames int").coalesce(1).write.json(f"{folder}/{who}_ses-01")
    side = scans.json_side_files(spark, f"{folder}/*/*.json", {"NumFramesScrubbed": "int", "TotalFrames": "int"})
    assert sorted(tuple(r) for r in side.collect()) == [("1", "ses-01", 3, 100), ("2", "ses-01", 5, 100)]

    sheets = scratch_dir(spark, "t-sheets")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    for name, rows in (("60-64", ["1,a"]), ("65–69", ["2,b", "x,c"])):
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sheets}/{name}.csv"))
        out.write(("k,v\n" + "\n".join(rows) + "\n").encode())
        out.close()
    got = scans.sheet_tables(spark, sheets, "k int, v string").collect()
    assert sorted((r["sheet"], r["v"]) for r in got) == [("60-64", "a"), ("65–69", "b"), ("65–69", "c")]
    assert {r["v"]: r["k"] for r in got} == {"a": 1, "b": 2, "c": None}


def test_packed_side_files(spark):
    rows = [("x/ses-01/sub-1/a.json", '{"n": 3,\n "t": -0.5}'), ("x/ses-02/sub-2/a.json", "{broken"), ("x/ses-01/sub-3/a.json", "{}"), ("x/ses-01/sub-4/a.json", None)]
    docs = scans.json_documents(spark.createDataFrame(rows, "path string, text string"), "path", "text", {"t": "double", "n": "int"})
    assert docs.columns == ["subject_id", "ses", "t", "n"]
    assert sorted(tuple(r) for r in docs.collect()) == [
        ("1", "ses-01", -0.5, 3), ("2", "ses-02", None, None), ("3", "ses-01", None, None), ("4", "ses-01", None, None),
    ]


def test_side_file_query_does_not_make_a_file_for_each_subject(spark):
    import __spark_entry__ as entry

    out = entry.queries()["json_side_files"](spark, "/root/testdata/sf0.001")
    assert out.count() == 150 and len(out.inputFiles()) < 10


def test_export_keeps_the_row_order(spark):
    path = scratch_dir(spark, "t-export")
    df = spark.createDataFrame([(k, f"row {k}") for k in (3, 1, 2)], "row_no int, text string")
    sinks.export_csv(df, path, "row_no")
    assert [r["text"] for r in spark.read.csv(path, header=True).collect()] == ["row 1", "row 2", "row 3"]


def test_scratch_uses_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    place = scratch_dir(spark, "x")
    assert place.startswith(f"{named}/{spark.sparkContext.applicationId}/x-") and place != scratch_dir(spark, "x")


def test_append_keeps_one_row_per_key_and_the_bucket_count(spark):
    path = scratch_dir(spark, "append-test")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    inc.append_new(rows, path, ["k"], buckets=3)
    inc.append_new(rows, path, ["k"], buckets=50)
    assert sorted(r["k"] for r in inc.stored(spark, path).collect()) == [1, 2]
    assert sinks.table_buckets(rows, path) == 3


def test_missing_weight_is_an_error(spark):
    rows = [("s", "ses-01", "7Networks_LH_Vis_1", 0.5, None), ("s", "ses-01", "7Networks_LH_Cont_1", None, None)]
    frame = spark.createDataFrame(rows, "subject_id string, ses string, roi string, value double, weight double")
    with pytest.raises(Exception, match="no weight for region"):
        rollup.weighted_rollup(frame).collect()
    assert rollup.weighted_rollup(frame.where("value IS NULL")).first()["sfc_weighted_mean"] is None


def test_features_keep_second_visit_nulls_in_the_baseline_model(spark):
    cells = [("a", "ses-01", 0, 1.0), ("a", "ses-01", 1, 2.0), ("a", "ses-02", 0, 3.0), ("a", "ses-02", 1, None),
             ("b", "ses-01", 0, 4.0), ("b", "ses-01", 1, 5.0), ("b", "ses-02", 0, 6.0), ("b", "ses-02", 1, 7.0),
             ("c", "ses-01", 0, 4.0), ("c", "ses-01", 1, 5.0)]
    regions = spark.createDataFrame(cells, "subject_id string, ses string, roi int, value double")
    people = spark.createDataFrame([(s, 1, 60.0, 62.0, 9.0, "male") for s in "abc"],
                                   "subject_id string, flag int, age_1 double, age_2 double, YoE double, sex string")
    base = {r["subject_id"]: r["x"] for r in visits.assemble_features(regions, people).collect()}
    assert base == {"a": [1.0, 2.0, 60.0, 9.0, 1.0], "b": [4.0, 5.0, 60.0, 9.0, 1.0]}
    assert [r["subject_id"] for r in visits.assemble_features(regions, people, with_slope=True).collect()] == ["b"]
    stray = regions.union(spark.createDataFrame([("b", "ses-01", 9, 1.0)], regions.schema))
    with pytest.raises(Exception, match="differ in their regions"):
        visits.assemble_features(stray, people).collect()


