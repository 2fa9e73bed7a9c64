"""Queries: signals -> edges -> coupling -> roll-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.operators import connectivity as N
from neurospan.operators import rollup as R
from neurospan.operators import visits as V
from neurospan.plans import connectome_inputs as I
from neurospan.plans.registry import query, r6, sql6
from neurospan.session import scratch_dir, table
from neurospan.sources.sinks import load_or_compute


def _fc(spark: SparkSession, sf: str) -> DataFrame:
    """Connectivity that everything downstream uses: from the shrunk covariance."""
    return N.functional_edges_shrunk(I.series(spark, sf))


def _connections(spark: SparkSession, sf: str) -> DataFrame:
    return N.connections(I.streamlines(spark, sf))


def _sc(spark: SparkSession, sf: str, connections: DataFrame | None = None) -> DataFrame:
    found = _connections(spark, sf) if connections is None else connections
    return N.structural_edges(found, I.node_volumes(found), count="n")


def _sfc(spark: SparkSession, sf: str, connections: DataFrame | None = None) -> DataFrame:
    return N.coupling(_sc(spark, sf, connections), _fc(spark, sf))


@query("fc_edges", f"WITH {I.PLAIN_FC_SQL} SELECT subject_id, ses, i, j, {sql6('r')} AS r, {sql6('z')} AS z FROM fc")
def fc_edges(spark, sf):
    """Plain correlations, for comparison with the shrunk ones."""
    return N.functional_edges(I.series(spark, sf)).select("subject_id", "ses", "i", "j", r6("r").alias("r"), r6("z").alias("z"))


def _strict_moments(x):
    """Co-moments of frames in which every region varies; numpy raises where one does not."""
    found = N._co_moments(x)
    with np.errstate(divide="raise"):
        np.divide(1.0, found[2])
    return found


@query(
    "error_quarantine",
    f"""WITH {I.PLAIN_FC_SQL}, kept AS (SELECT subject_id, ses, count(*) AS n_edges, {sql6('avg(r)')} AS mean_r FROM fc WHERE subject_id <> '3' GROUP BY ALL)
    SELECT subject_id, ses, n_edges, mean_r, NULL AS reason, false AS timed FROM kept
    UNION ALL SELECT DISTINCT subject_id, ses, 0, NULL, 'FloatingPointError: divide by zero encountered in divide', true FROM ts WHERE subject_id = '3'""",
)
def error_quarantine(spark, sf):
    """Subject 3's fifth region does not vary, so numpy raises in its blocks; everyone else has edges."""
    flat = F.transform("signal", lambda v, k: F.when(k == 4, F.lit(1.0)).otherwise(v))
    series = I.series(spark, sf).withColumn("signal", F.when(F.col("subject_id") == "3", flat).otherwise(F.col("signal")))
    blocks = N.stored_moments(series, measure=_strict_moments)
    good = N.edges_of(blocks).groupBy("subject_id", "ses").agg(F.count(F.lit(1)).alias("n_edges"), r6(F.avg("r")).alias("mean_r"))
    bad = N.failed_blocks(blocks).select(
        "subject_id", "ses", F.lit(0).cast("bigint").alias("n_edges"), F.lit(None).cast("double").alias("mean_r"), "reason",
        F.col("failed_at").isNotNull().alias("timed"),
    )
    return good.withColumns({"reason": F.lit(None).cast("string"), "timed": F.lit(False)}).unionByName(bad)


@query(
    "cached_group_means",
    f"WITH {I.FC_SQL} SELECT i, j, {sql6('avg(z)')} AS mean_z, count(z) AS n_subjects FROM fc GROUP BY ALL",
)
def cached_group_means(spark, sf):
    """Group means computed once for their input files and settings; the second call loads what the first one stored."""
    folder, settings, runs = scratch_dir(spark, "group-means"), {"value": "z", "shrunk": True}, []

    def compute():
        runs.append(1)
        return N.group_mean_edges(_fc(spark, sf), value="z")

    for _ in range(2):
        out = load_or_compute(spark, folder, [f"{sf}/embeddings.parquet"], settings, compute)
    if len(runs) != 1:
        raise AssertionError("the stored result was not used")
    return out.select("i", "j", r6("mean_value").alias("mean_z"), "n_subjects")


def _damaged_series(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of which subject 3 lost a frame's last values and subject 5 one value."""
    frame, signal = F.col("frame"), F.col("signal")
    short = (F.col("subject_id") == "3") & (frame % 7 == 0)
    holed = (F.col("subject_id") == "5") & (frame % 11 == 0)
    hole = F.transform(signal, lambda v, k: F.when(k != 4, v))
    return I.series(spark, sf).withColumn("signal", F.when(short, F.slice(signal, 1, 60)).when(holed, hole).otherwise(signal))


_DAMAGED_SQL = """bad AS (SELECT CAST(label AS VARCHAR) AS subject_id, 'ses-0' || CAST(vec_id % 2 + 1 AS VARCHAR) AS ses, count(*) AS n_frames,
  count(*) FILTER (label = 5 AND vec_id % 11 = 0) AS n_bad, count(*) FILTER (label = 3 AND vec_id % 7 = 0) AS n_short FROM embeddings GROUP BY ALL)"""


@query(
    "fc_edges_damaged",
    f"WITH {I.PLAIN_FC_SQL}, {_DAMAGED_SQL} SELECT f.subject_id, f.ses, i, j, {sql6('r')} AS r FROM fc f "
    "JOIN bad b ON b.subject_id = f.subject_id AND b.ses = f.ses WHERE n_bad = 0 AND (n_short = 0 OR n_short = n_frames)",
)
def fc_edges_damaged(spark, sf):
    """Ragged and incomplete signals take their subject and session out, nothing else."""
    return N.functional_edges(_damaged_series(spark, sf)).select("subject_id", "ses", "i", "j", r6("r").alias("r"))


@query(
    "unusable_signals",
    f"""WITH {_DAMAGED_SQL} SELECT subject_id, ses, n_frames, n_bad FROM bad WHERE n_bad > 0 OR (n_short > 0 AND n_short < n_frames)""",
)
def unusable_signals(spark, sf):
    return N.unusable_signals(_damaged_series(spark, sf)).select("subject_id", "ses", "n_frames", "n_bad")


@query(
    "fc_edges_shrunk",
    f"WITH {I.SERIES_SQL}, {I.shrink_sql('ts', 'subject_id, ses')} "
    f"SELECT subject_id, ses, i, j, {sql6('rho')} AS rho, {sql6('r')} AS r, {sql6('atanh(r)')} AS z FROM shrunk",
)
def fc_edges_shrunk(spark, sf):
    return N.functional_edges_shrunk(I.series(spark, sf)).select(
        "subject_id", "ses", "i", "j", r6("rho").alias("rho"), r6("r").alias("r"), r6("z").alias("z")
    )


_REGION_GROUP_SQL = f"""names AS (SELECT DISTINCT roi, {I.region_name_sql('roi')} AS name FROM ts),
grp AS (SELECT roi, CASE WHEN name LIKE 'Subcortical%' THEN 'Subcortical' ELSE split_part(name, '_', 3) END AS network FROM names)"""


@query(
    "fc_within_network",
    f"WITH {I.FC_SQL}, {_REGION_GROUP_SQL} "
    f"SELECT f.subject_id, f.ses, a.network, f.i, f.j, {sql6('f.r')} AS r FROM fc f "
    "JOIN grp a ON a.roi = f.i JOIN grp b ON b.roi = f.j WHERE a.network = b.network",
)
def fc_within_network(spark, sf):
    group = I.regions(spark, sf).withColumn("network", C.network(I.region_name(F.col("roi"))))
    return N.edges_within(_fc(spark, sf), group, "network").select(
        "subject_id", "ses", "network", "i", "j", r6("r").alias("r")
    )


_PAIRS = {name: [56 + k, 60 + k] for k, name in enumerate(I.STRUCTURE_CYCLE)}


@query(
    "fc_bilateral_structure",
    f"""WITH {I.SERIES_SQL}, sub AS (
      SELECT subject_id, ses, [{", ".join(f"'{n}'" for n in I.STRUCTURE_CYCLE)}][roi % 4 + 1] AS subset, frame, (roi - 56) // 4 AS roi, v
      FROM ts WHERE roi >= 56), {I.shrink_sql('sub', 'subject_id, ses, subset')}
    SELECT subject_id, ses, subset AS structure, {sql6('atanh(r)')} AS z FROM shrunk""",
)
def fc_bilateral_structure(spark, sf):
    """Left against right of each structure, the shrinkage estimated from the pair alone."""
    pairs = N.regions_subset(I.series(spark, sf), _PAIRS)
    return N.functional_edges_shrunk(pairs, keys=("subject_id", "ses", "subset")).select(
        "subject_id", "ses", F.col("subset").alias("structure"), r6("z").alias("z")
    )


_SUBSETS = {name: list(range(8 * k, 8 * k + 8)) for k, name in enumerate((*I.NETWORK_CYCLE, "Subcortical"))}


@query(
    "fc_network_shrunk",
    f"""WITH {I.SERIES_SQL}, sub AS (
      SELECT subject_id, ses, [{", ".join(f"'{n}'" for n in _SUBSETS)}][roi // 8 + 1] AS subset, frame, roi % 8 AS roi, v
      FROM ts), {I.shrink_sql('sub', 'subject_id, ses, subset')}
    SELECT subject_id, ses, subset, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {sql6('r')} AS r FROM shrunk""",
)
def fc_network_shrunk(spark, sf):
    """Shrinkage re-estimated inside each network, as the estimate depends on the region set."""
    sub = N.regions_subset(I.series(spark, sf), _SUBSETS)
    return N.functional_edges_shrunk(sub, keys=("subject_id", "ses", "subset")).select(
        "subject_id", "ses", "subset", "i", "j", r6("r").alias("r")
    )


@query(
    "sc_edges",
    f"WITH {I.SC_SQL} SELECT subject_id, ses, i, j, n_streamlines, {sql6('weight')} AS weight FROM sc",
)
def sc_edges(spark, sf):
    return _sc(spark, sf).select("subject_id", "ses", "i", "j", "n_streamlines", r6("weight").alias("weight"))


@query(
    "sc_within_network",
    f"WITH {I.SERIES_SQL}, {I.SC_SQL}, {_REGION_GROUP_SQL} SELECT s.subject_id, s.ses, a.network, s.i, s.j, {sql6('s.weight')} AS weight "
    "FROM sc s JOIN grp a ON a.roi = s.i JOIN grp b ON b.roi = s.j WHERE a.network = b.network",
)
def sc_within_network(spark, sf):
    """Structural sub-networks: edges with both ends in one network, the subcortical block being one of them."""
    group = I.regions(spark, sf).withColumn("network", C.network(I.region_name(F.col("roi"))))
    return N.edges_within(_sc(spark, sf), group, "network").select(
        "subject_id", "ses", "network", "i", "j", r6("weight").alias("weight")
    )


@query(
    "sfc",
    f"WITH {I.SFC_SQL} SELECT subject_id, ses, roi, n_partners, {sql6('rho')} AS rho, "
    f"{sql6('atanh(rho)')} AS rho_z FROM sfc",
)
def sfc(spark, sf):
    return _sfc(spark, sf).select(
        "subject_id", "ses", "roi", "n_partners", r6("rho").alias("rho"), r6("rho_z").alias("rho_z")
    )


@query(
    "node_strength_fc",
    f"""WITH {I.FC_SQL}, m AS (SELECT subject_id, ses, i AS roi, z FROM fc UNION ALL SELECT subject_id, ses, j, z FROM fc)
    SELECT subject_id, ses, roi, {sql6('avg(z)')} AS strength FROM m GROUP BY ALL""",
)
def node_strength_fc(spark, sf):
    return N.node_strength(_fc(spark, sf), I.regions(spark, sf), value="z").select(
        "subject_id", "ses", "roi", r6("strength").alias("strength")
    )


@query(
    "node_strength_sc",
    f"""WITH {I.SERIES_SQL}, {I.SC_SQL}, rois AS (SELECT DISTINCT roi FROM ts),
    spine AS (SELECT DISTINCT subject_id, ses, roi FROM (SELECT subject_id, ses FROM ts UNION SELECT subject_id, ses FROM sc), rois),
    m AS (SELECT subject_id, ses, i AS roi, weight FROM sc UNION ALL SELECT subject_id, ses, j, weight FROM sc),
    tot AS (SELECT subject_id, ses, roi, sum(weight) AS w FROM m GROUP BY ALL)
    SELECT s.subject_id, s.ses, s.roi, {sql6("coalesce(t.w, 0) / ((SELECT count(*) FROM rois) - 1)")} AS strength
    FROM spine s LEFT JOIN tot t USING (subject_id, ses, roi)""",
)
def node_strength_sc(spark, sf):
    return N.node_strength(_sc(spark, sf), I.regions(spark, sf), subjects=I.subjects(spark, sf)).select(
        "subject_id", "ses", "roi", r6("strength").alias("strength")
    )


_ROLLUP_SQL = f"""{I.SFC_SQL},
shared AS (SELECT CAST(l_partkey % 64 AS INT) AS roi, count(*) AS w FROM lineitem GROUP BY ALL),
weighted AS (
  SELECT s.subject_id, s.ses, s.roi, s.rho, {I.region_name_sql('s.roi')} AS name,
         CASE WHEN s.roi >= 56 THEN v.volume ELSE h.w END AS w
  FROM sfc s LEFT JOIN shared h USING (roi)
  LEFT JOIN vol v ON v.subject_id = s.subject_id AND v.ses = s.ses AND v.node = s.roi),
tagged AS (
  SELECT *, CASE WHEN name LIKE 'Subcortical%' THEN NULL ELSE split_part(name, '_', 3) END AS net FROM weighted
  WHERE rho IS NOT NULL),
rolled AS (
  SELECT subject_id, ses, sum(rho * w) / sum(w) AS sfc_weighted_mean,
         sum(rho * w) FILTER (net IN ('Vis', 'SomMot')) / sum(w) FILTER (net IN ('Vis', 'SomMot')) AS sfc_sensory,
         sum(rho * w) FILTER (net IS NULL OR net NOT IN ('Vis', 'SomMot'))
           / sum(w) FILTER (net IS NULL OR net NOT IN ('Vis', 'SomMot')) AS sfc_hmod,
         sum(rho * w) FILTER (net = 'SalVentAttn') / sum(w) FILTER (net = 'SalVentAttn') AS sfc_salience,
         sum(rho * w) FILTER (net = 'Cont') / sum(w) FILTER (net = 'Cont') AS sfc_control,
         sum(rho * w) FILTER (net = 'Default') / sum(w) FILTER (net = 'Default') AS sfc_dmn
  FROM tagged GROUP BY ALL)"""
_MEASURES = ("sfc_weighted_mean", "sfc_sensory", "sfc_hmod", "sfc_salience", "sfc_control", "sfc_dmn")


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = _connections(spark, sf)
    named = _sfc(spark, sf, found).withColumn("roi", I.region_name(F.col("roi"))).withColumnRenamed("rho", "value")
    shared = found.groupBy("node_a").agg(F.sum("n").alias("weight")).select(I.region_name(F.col("node_a")).alias("roi"), "weight")
    own = I.node_volumes(found).select(
        "subject_id", "ses", I.region_name(F.col("node")).alias("roi"), F.col("volume").alias("weight")
    )
    return R.weighted_rollup(R.attach_weights(named, shared, own))


@query(
    "weighted_rollup",
    f"WITH {_ROLLUP_SQL} SELECT subject_id, ses, " + ", ".join(f"{sql6(m)} AS {m}" for m in _MEASURES) + " FROM rolled",
)
def weighted_rollup(spark, sf):
    return rollup(spark, sf).select("subject_id", "ses", *[r6(m).alias(m) for m in _MEASURES])


@query(
    "pivot_rollup",
    f"WITH {_ROLLUP_SQL} SELECT subject_id, "
    + ", ".join(
        f"{sql6(f'max({m}) FILTER (ses = {ses!r})')} AS {m}_{k}" for k, ses in ((1, "ses-01"), (2, "ses-02")) for m in _MEASURES
    )
    + " FROM rolled GROUP BY ALL",
)
def pivot_rollup(spark, sf):
    wide = R.visits_to_columns(rollup(spark, sf), {"ses-01": "1", "ses-02": "2"})
    return wide.select("subject_id", *[r6(c).alias(c) for c in wide.columns if c != "subject_id"])


@query(
    "wide_master",
    f"""WITH {_ROLLUP_SQL}, demo AS (SELECT DISTINCT CAST(label AS VARCHAR) AS subject_id, label % 2 AS flag, 60.0 + label AS age_1, 62.0 + label + label % 3 AS age_2
      FROM embeddings UNION ALL VALUES ('nobody', 1, 70.0, 73.0)),
    wide AS (SELECT subject_id, """
    + ", ".join(f"max({m}) FILTER (ses = 'ses-0{k}') AS {m}_{k}" for k in (1, 2) for m in _MEASURES)
    + """ FROM rolled GROUP BY ALL)
    SELECT subject_id, CAST(flag AS INT) AS flag, """
    + ", ".join(f"{sql6(f'{m}_{k}')} AS {m}_{k}" for k in (1, 2) for m in _MEASURES) + ", "
    + ", ".join(f"{sql6(f'({m}_2 - {m}_1) / (age_2 - age_1)')} AS {m}_slope" for m in _MEASURES)
    + " FROM demo LEFT JOIN wide USING (subject_id)",
)
def wide_master(spark, sf):
    """Demographics with both visits' roll-ups and their annual changes; a subject without scans stays."""
    label = F.col("label")
    demo = table(spark, sf, "embeddings").select(
        label.cast("string").alias("subject_id"), (label % 2).cast("int").alias("flag"), (label + 60.0).alias("age_1"),
        (label + 62.0 + label % 3).alias("age_2"),
    ).distinct().union(spark.createDataFrame([("nobody", 1, 70.0, 73.0)], "subject_id string, flag int, age_1 double, age_2 double"))
    wide = R.visits_to_columns(rollup(spark, sf), {"ses-01": "1", "ses-02": "2"})
    out = V.wide_master(demo, [wide], _MEASURES).drop("age_1", "age_2")
    return out.select("subject_id", "flag", *[r6(c).alias(c) for c in out.columns if c not in ("subject_id", "flag")])


@query(
    "missing_weights",
    f"""WITH {I.SERIES_SQL}, w AS (SELECT DISTINCT p_partkey % 61 AS roi FROM part)
    SELECT DISTINCT roi FROM ts WHERE roi NOT IN (SELECT roi FROM w)""",
)
def missing_weights(spark, sf):
    known = table(spark, sf, "part").select((F.col("p_partkey") % 61).cast("int").alias("roi")).distinct()
    return R.missing_weights(R.attach_weights(I.regions(spark, sf), known.withColumn("weight", F.lit(1.0))))


@query(
    "group_mean_map",
    f"WITH {I.FC_SQL} SELECT i, j, {sql6('avg(z)')} AS mean_z, count(z) AS n_subjects FROM fc GROUP BY ALL",
)
def group_mean_map(spark, sf):
    return N.group_mean_edges(_fc(spark, sf), value="z").select("i", "j", r6("mean_value").alias("mean_z"), "n_subjects")


_DIFF_SQL = f"""{I.SFC_SQL}, d AS (
  SELECT ses, roi, avg(atanh(rho)) FILTER (CAST(subject_id AS INT) % 2 = 1)
                 - avg(atanh(rho)) FILTER (CAST(subject_id AS INT) % 2 = 0) AS difference
  FROM sfc GROUP BY ALL)"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("subject_id"), (F.col("label") % 2).alias("flag")
    ).distinct()
    return R.difference_map(_sfc(spark, sf), flags)


@query("diff_map", f"WITH {_DIFF_SQL} SELECT ses, roi, {sql6('difference')} AS difference FROM d")
def diff_map(spark, sf):
    return _diff(spark, sf).select("ses", "roi", r6("difference").alias("difference"))


@query("diff_map_average", f"WITH {_DIFF_SQL} SELECT roi, {sql6('avg(difference)')} AS difference FROM d GROUP BY ALL")
def diff_map_average(spark, sf):
    return R.average_over_sessions(_diff(spark, sf)).select("roi", r6("difference").alias("difference"))


@query(
    "subject_by_roi_wide",
    f"WITH {I.SFC_SQL} SELECT subject_id, ses, "
    + ", ".join(f"{sql6(f'max(rho) FILTER (roi = {k})')} AS roi_{k}" for k in range(I.N_REGIONS))
    + " FROM sfc GROUP BY ALL",
)
def subject_by_roi_wide(spark, sf):
    wide = R.pivot_regions(_sfc(spark, sf), range(I.N_REGIONS), value="rho")
    return wide.select("subject_id", "ses", *[r6(F.col(str(k))).alias(f"roi_{k}") for k in range(I.N_REGIONS)])


@query(
    "symmetric_matrix",
    f"""WITH {I.SERIES_SQL}, {I.SC_SQL}, rois AS (SELECT DISTINCT roi FROM ts),
    m AS (SELECT subject_id, ses, i AS roi, j AS col, weight FROM sc
          UNION ALL SELECT subject_id, ses, j, i, weight FROM sc),
    spine AS (SELECT s.subject_id, s.ses, s.roi, r.roi AS col
              FROM (SELECT DISTINCT subject_id, ses, roi FROM m) s, rois r)
    SELECT s.subject_id, s.ses, s.roi, s.col, {sql6('coalesce(m.weight, 0)')} AS weight
    FROM spine s LEFT JOIN m USING (subject_id, ses, roi, col)""",
)
def symmetric_matrix(spark, sf):
    rows = N.matrix_rows(_sc(spark, sf), I.regions(spark, sf))
    return rows.select("subject_id", "ses", "roi", F.posexplode("row").alias("col", "w")).select(
        "subject_id", "ses", "roi", "col", r6("w").alias("weight")
    )


_SCAN_SQL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS subject_id,
  CAST(date_part('hour', ts) AS INT) AS frame, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label,
  value FROM events)"""


def _event_voxels(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        F.hour("ts").alias("frame"),
        (F.array_position(kinds, F.col("event_type")) - 1).alias("label"),
        "value",
    )


@query(
    "label_mean_series",
    f"WITH {_SCAN_SQL} SELECT subject_id, frame, CAST(label AS BIGINT) AS label, {sql6('avg(value)')} AS mean_value FROM ev "
    "WHERE label <> 0 GROUP BY ALL",
)
def label_mean_series(spark, sf):
    return N.label_mean_series(_event_voxels(spark, sf), ("subject_id", "frame")).select(
        "subject_id", "frame", "label", r6("mean_value").alias("mean_value")
    )


@query(
    "voxel_counts",
    f"WITH {_SCAN_SQL} SELECT subject_id, CAST(label AS BIGINT) AS label, count(*) AS n_voxels FROM ev WHERE label > 0 GROUP BY ALL",
)
def voxel_counts(spark, sf):
    return N.voxel_counts(_event_voxels(spark, sf), ("subject_id",))


_SLOTS = ("lh_cortical", "rh_cortical", "lh_subcortical", "rh_subcortical")


def _voxels(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem rows as voxels with four candidate labels (0 = background)."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("string").alias("subject_id"),
        F.lit("ses-01").alias("ses"),
        F.col("l_orderkey"), F.col("l_linenumber"),
        C.encode_label((F.col("l_partkey") % 6), 0).alias("lh_cortical"),
        C.encode_label((F.col("l_orderkey") % 5), 5).alias("rh_cortical"),
        C.encode_label((F.col("l_linenumber") % 3).cast("bigint"), 10).alias("lh_subcortical"),
        C.encode_label((F.col("l_quantity").cast("bigint") % 4), 17).alias("rh_subcortical"),
    )


_OVERLAP_SQL = """vox AS (
  SELECT CAST(l_suppkey % 5 AS VARCHAR) AS subject_id, 'ses-01' AS ses, l_orderkey, l_linenumber,
         CASE WHEN l_partkey % 6 <> 0 THEN l_partkey % 6 ELSE 0 END AS lh_cortical,
         CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey % 5 + 5 ELSE 0 END AS rh_cortical,
         CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber % 3 + 10 AS BIGINT) ELSE 0 END AS lh_subcortical,
         CASE WHEN CAST(l_quantity AS BIGINT) % 4 <> 0 THEN CAST(l_quantity AS BIGINT) % 4 + 17 ELSE 0 END AS rh_subcortical
  FROM lineitem),
combos AS (SELECT subject_id, ses, lh_cortical, rh_cortical, lh_subcortical, rh_subcortical, count(*) AS n_overlap
           FROM vox GROUP BY ALL),
claims AS (
  SELECT *, 0 AS slot, lh_cortical AS label FROM combos WHERE lh_cortical <> 0
  UNION ALL SELECT *, 1, rh_cortical FROM combos WHERE rh_cortical <> 0
  UNION ALL SELECT *, 2, lh_subcortical FROM combos WHERE lh_subcortical <> 0
  UNION ALL SELECT *, 3, rh_subcortical FROM combos WHERE rh_subcortical <> 0),
pct AS (SELECT *, n_overlap * 100.0::DOUBLE / sum(n_overlap) OVER (PARTITION BY subject_id, ses, slot, label) AS pct FROM claims),
best AS (
  SELECT *, count(*) OVER (PARTITION BY subject_id, ses, lh_cortical, rh_cortical, lh_subcortical, rh_subcortical) AS n_claims,
         row_number() OVER (PARTITION BY subject_id, ses, lh_cortical, rh_cortical, lh_subcortical, rh_subcortical
                            ORDER BY pct DESC, slot) AS rn FROM pct),
winners AS (SELECT * FROM best WHERE rn = 1)"""


@query(
    "label_overlap",
    f"WITH {_OVERLAP_SQL} SELECT subject_id, ses, lh_cortical, rh_cortical, lh_subcortical, rh_subcortical, n_overlap, "
    f"n_claims, {sql6('pct')} AS best_pct, label FROM winners",
)
def label_overlap(spark, sf):
    out = R.overlap_table(_voxels(spark, sf), _SLOTS)
    return out.withColumn("best_pct", r6("best_pct"))


@query(
    "label_overlap_voxels",
    f"""WITH {_OVERLAP_SQL} SELECT v.subject_id, coalesce(w.label, 0) AS label, count(*) AS n_voxels
    FROM vox v LEFT JOIN winners w USING (subject_id, ses, lh_cortical, rh_cortical, lh_subcortical, rh_subcortical)
    GROUP BY ALL""",
)
def label_overlap_voxels(spark, sf):
    vox = _voxels(spark, sf)
    done = R.resolve_voxels(vox, R.overlap_table(vox, _SLOTS), _SLOTS)
    return done.groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("n_voxels"))


@query(
    "atlas_completeness",
    f"""WITH {_OVERLAP_SQL} SELECT subject_id, ses, count(DISTINCT label) AS n_labels, count(DISTINCT label) = 14 AS complete
    FROM winners GROUP BY ALL""",
)
def atlas_completeness(spark, sf):
    return R.atlas_completeness(R.overlap_table(_voxels(spark, sf), _SLOTS), 14)


@query(
    "diff_map_by_visit",
    f"""WITH {I.SFC_SQL}, p AS (SELECT DISTINCT CAST(label AS VARCHAR) AS subject_id, label % 2 AS f1, label % 3 % 2 AS f2 FROM embeddings),
    t AS (SELECT s.ses, s.roi, atanh(s.rho) AS z, CASE s.ses WHEN 'ses-01' THEN f1 ELSE f2 END AS f FROM sfc s JOIN p USING (subject_id))
    SELECT ses, roi, {sql6('avg(z) FILTER (f = 1) - avg(z) FILTER (f = 0)')} AS difference FROM t GROUP BY ALL""",
)
def diff_map_by_visit(spark, sf):
    """Each session compared by that session's own classification."""
    people = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("subject_id"), (F.col("label") % 2).alias("flag_1"), (F.col("label") % 3 % 2).alias("flag_2")
    ).distinct()
    flags = R.session_flags(people, "visit", {"ses-01": "1", "ses-02": "2"})
    return R.difference_map(_sfc(spark, sf), flags).withColumn("difference", r6("difference"))


_ALL_EDGES = [(a, b) for a in range(I.N_REGIONS) for b in range(a + 1, I.N_REGIONS)]


def _wide(spark: SparkSession, sf: str, mark: str) -> DataFrame:
    """All edges, one column each, the two region positions joined by ``mark``."""
    named = _fc(spark, sf).select(
        "subject_id", "ses", F.concat_ws(mark, F.col("i").cast("string"), F.col("j").cast("string")).alias("edge"), r6("z").alias("z")
    )
    return N.wide_edges(named, [f"{a}{mark}{b}" for a, b in _ALL_EDGES], value="z")


@query(
    "edge_wide_row",
    f"WITH {I.FC_SQL}, named AS (SELECT subject_id, ses, i || '_' || j AS edge, {sql6('z')} AS z FROM fc) "
    "SELECT * FROM (PIVOT named ON edge IN (" + ", ".join(f"'{a}_{b}'" for a, b in _ALL_EDGES) + ") USING max(z) GROUP BY subject_id, ses)",
)
def edge_wide_row(spark, sf):
    return _wide(spark, sf, "_")


@query(
    "edge_wide_to_long",
    f"WITH {I.FC_SQL} SELECT subject_id, ses, CAST(i AS VARCHAR) AS i, CAST(j AS VARCHAR) AS j, {sql6('z')} AS weight FROM fc",
)
def edge_wide_to_long(spark, sf):
    return N.edges_from_wide(_wide(spark, sf, "-"))


@query(
    "incomplete_series",
    f"WITH {_SCAN_SQL} SELECT subject_id, frame, count(DISTINCT label) AS n_labels FROM ev WHERE label <> 0 "
    "GROUP BY subject_id, frame HAVING count(DISTINCT label) < 4",
)
def incomplete_series(spark, sf):
    means = N.label_mean_series(_event_voxels(spark, sf), ("subject_id", "frame"))
    return N.incomplete_series(means, 4, ("subject_id", "frame"))
