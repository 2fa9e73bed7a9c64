import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from neurospan.operators import ordered as O


def brute_bh(p):
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    scaled = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(scaled[::-1])[::-1], 1.0)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 0.01, 0.02, 0.02, 0.2, 0.5, 1.0]), min_size=1, max_size=40))
def test_bh_with_ties(spark, p):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id int, p_value double")
    got = {r["id"]: r["p_fdr"] for r in O.bh_fdr(df).collect()}
    want = brute_bh(p)
    for i, v in enumerate(want):
        assert got[i] == pytest.approx(v, abs=1e-12)
        assert got[i] >= p[i] - 1e-12


def test_bh_keeps_null_and_refuses_bad_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5)], "id int, p_value double")
    got = {r["id"]: r["p_fdr"] for r in O.bh_fdr(df).collect()}
    assert got[2] is None and got[1] == pytest.approx(0.02)
    bad = spark.createDataFrame([(1, 1.5)], "id int, p_value double")
    with pytest.raises(Exception, match="outside"):
        O.bh_fdr(bad).collect()


def test_running_with_one_hot_key(spark):
    """One key holds most rows; its order still spreads over many ranges."""
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(1, 9)) for i in range(4000)] + [(f"k{i}", i, 1) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    cut = O.with_ranges(df, ["k"], ["o"])
    sizes = {r[0]: r[1] for r in cut.groupBy(O.RANGE).count().collect()}
    assert len(sizes) >= 6 and max(sizes.values()) < 0.4 * len(rows)
    got = {(r["k"], r["o"]): (r["s"], r["m"]) for r in O.running(cut, ["k"], ["o"], {"s": "v"}, {"m": "v"}).collect()}
    assert len(got) == len(rows)
    per = {}
    for k, o, v in sorted(rows):
        per.setdefault(k, []).append((o, v))
    for k, items in per.items():
        total = 0
        values = [v for _, v in items]
        for n, (o, v) in enumerate(items):
            total += v
            assert got[(k, o)][0] == total
            assert got[(k, o)][1] == min(values[n:])


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, None)], "id int, v double")
    assert {r["id"]: r["rank"] for r in O.competition_rank(df, "v").collect()} == {1: 2, 2: 1, 3: 2, 4: None}
    assert {r["v"]: r["midrank"] for r in O.mid_ranks(df, "v").collect()} == {5.0: 1.5, 7.0: 3.0}


def test_numbering_is_dense(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 500).alias("o"))
    rows = O.numbered(df, ["o"], keys=["k"]).collect()
    for k in range(3):
        mine = sorted((r["o"], r["row_no"]) for r in rows if r["k"] == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    a = {r["id"]: r["fold"] for r in O.stratified_folds(df, "id", "y", 5, 1).collect()}
    b = {r["id"]: r["fold"] for r in O.stratified_folds(df.repartition(11), "id", "y", 5, 1).collect()}
    assert a == b
    for y, n in ((1, 50), (0, 150)):
        sizes = [sum(1 for i, f in a.items() if f == k and (i % 4 == 0) == bool(y)) for k in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_missing_keys_and_values_are_kept(spark):
    rows = [(None, i, 1) for i in range(300)] + [("a", i, 1) for i in range(300)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    out = O.numbered(df.withColumn("o", F.col("o").cast("double")), ["o"], keys=["k"]).collect()
    assert len(out) == len(rows)
    assert sorted(r["row_no"] for r in out if r["k"] is None) == list(range(1, 301))
    assert {r["o"]: r["row_no"] for r in out if r["k"] == "a"}[None] == 1
    odd = spark.createDataFrame([(float(i) if i % 3 else float("nan"), i) for i in range(300)], "o double, i int")
    got = O.numbered(odd, ["o", "i"]).collect()
    assert sorted(r["row_no"] for r in got) == list(range(1, 301))
