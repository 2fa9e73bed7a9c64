"""Queries: labels and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.operators import connectivity as N
from neurospan.operators import ordered as O
from neurospan.operators import report as R
from neurospan.operators import rollup as RU
from neurospan.plans import connectome as X
from neurospan.plans import connectome_inputs as I
from neurospan.plans import models as M
from neurospan.plans.models import model_summary
from neurospan.plans.registry import ORACLES, query, r6, sql6
from neurospan.session import table

# --- labels --------------------------------------------------------------------

_STEMS = ("Med", "Post", "PFCl", "FEF", "S2", "Nowhere", "")


def _feature_names(spark: SparkSession, sf: str) -> DataFrame:
    """Region feature names spelled from the part keys."""
    k = F.col("p_partkey")
    nets = F.array(*[F.lit(n) for n in I.NETWORK_CYCLE])
    stems = F.array(*[F.lit(s) for s in _STEMS])
    stem = F.get(stems, ((k % 7)).cast("int"))
    middle = F.when(stem == "", "").otherwise(F.concat(stem, F.lit("_")))
    cortical = F.concat(
        F.lit("7Networks_"), F.when(k % 2 == 0, "LH").otherwise("RH"), F.lit("_"),
        F.get(nets, (F.floor(k / 7) % 7).cast("int")), F.lit("_"), middle, (k % 40 + 2).cast("string"),
    )
    sub = F.concat(F.lit("Subcortical "), (k % 14 + 201).cast("string"), F.when(k % 2 == 0, ": Left ").otherwise(": Right "), F.lit("Thalamus"))
    base = F.when(k % 11 == 0, sub).when(k % 13 == 0, "cov_age").otherwise(cortical)
    return table(spark, sf, "part").select(
        k.alias("id"), F.concat(base, F.when(k % 3 == 0, "_slope").when(k % 3 == 1, "_1").otherwise("")).alias("feature")
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FEATURE_SQL = f"""f AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'S' WHEN p_partkey % 13 = 0 THEN 'V' ELSE 'C' END AS kind,
         CASE WHEN p_partkey % 2 = 0 THEN 'LH' ELSE 'RH' END AS side, {_sql_list(I.NETWORK_CYCLE)}[(p_partkey // 7) % 7 + 1] AS net,
         {_sql_list(_STEMS)}[p_partkey % 7 + 1] AS stem, p_partkey % 40 + 2 AS num, p_partkey % 14 + 201 AS subno,
         CASE p_partkey % 3 WHEN 0 THEN '_slope' WHEN 1 THEN '_1' ELSE '' END AS suffix FROM part),
g AS (SELECT *, CASE kind WHEN 'S' THEN 'Subcortical ' || subno || CASE WHEN side = 'LH' THEN ': Left ' ELSE ': Right ' END || 'Thalamus'
         WHEN 'V' THEN 'cov_age' ELSE '7Networks_' || side || '_' || net || '_' || CASE WHEN stem = '' THEN '' ELSE stem || '_' END || num END || suffix AS feature,
       CASE net WHEN 'Vis' THEN 'Visual' WHEN 'SomMot' THEN 'Somatomotor' WHEN 'DorsAttn' THEN 'Dorsal attention' WHEN 'SalVentAttn' THEN 'Salience'
         WHEN 'Limbic' THEN 'Limbic' WHEN 'Cont' THEN 'Executive control' ELSE 'Default mode' END AS netname FROM f)"""
_LABEL_SQL = """CASE kind WHEN 'S' THEN CASE WHEN side = 'LH' THEN 'L' ELSE 'R' END || ' thalamus'
  ELSE side || ' ' || CASE stem WHEN 'Med' THEN lower(netname) || ' medial' WHEN 'Post' THEN lower(netname) || ' posterior'
    WHEN 'PFCl' THEN 'lateral PFC' WHEN 'FEF' THEN 'frontal eye fields' WHEN 'S2' THEN 's2' WHEN 'Nowhere' THEN 'nowhere'
    ELSE lower(substr(netname, 1, 1)) || substr(netname, 2) END || ' (' || num || ')' END"""


@query(
    "feature_label",
    f"""WITH {_FEATURE_SQL} SELECT id, feature, CASE kind WHEN 'S' THEN 'Subcortical' ELSE net END AS network,
    CASE WHEN suffix = '_slope' THEN 'slope' ELSE 'baseline' END AS feature_type, {_LABEL_SQL} AS label FROM g WHERE kind <> 'V'""",
)
def feature_label(spark, sf):
    return R.describe_features(_feature_names(spark, sf), slope_model=True)


@query(
    "region_parse",
    f"""WITH r AS (SELECT DISTINCT CAST(l_partkey % 64 AS INT) AS k FROM lineitem), n AS (SELECT {I.region_name_sql('k')} AS roi, k FROM r)
    SELECT roi, CASE WHEN k < 56 THEN split_part(roi, '_', 3) ELSE 'Subcortical' END AS network,
      CASE WHEN k < 56 THEN split_part(roi, '_', 2) WHEN k < 60 THEN 'LH' ELSE 'RH' END AS hemi,
      CASE WHEN k >= 56 THEN list_extract({_sql_list(I.STRUCTURE_CYCLE)}, k % 4 + 1) END AS structure,
      CASE WHEN k < 16 THEN 'sensory' ELSE 'hmod' END AS domain, row_number() OVER (ORDER BY roi) AS roi_idx FROM n""",
)
def region_parse(spark, sf):
    names = table(spark, sf, "lineitem").select((F.col("l_partkey") % I.N_REGIONS).cast("int").alias("k")).distinct()
    regions = names.select(I.region_name(F.col("k")).alias("roi"))
    return O.numbered(regions, ["roi"], "roi_idx").select(
        "roi", C.network("roi").alias("network"), C.hemisphere("roi").alias("hemi"), C.structure("roi").alias("structure"),
        C.domain("roi").alias("domain"), "roi_idx",
    )


# --- result tables: brands are networks, types are models -----------------------------

_RESULT_SQL = """res AS (
  SELECT p_type AS model, p_brand AS network, (sum(p_partkey)::DOUBLE - 3 * sum(p_size)) / 10000 AS coef,
         (sum(p_partkey)::DOUBLE - 3 * sum(p_size)) / 10000 - 0.125 AS ci_lo,
         (sum(p_partkey)::DOUBLE - 3 * sum(p_size)) / 10000 + 0.125 AS ci_hi,
         (sum(p_partkey) % 997)::DOUBLE / 1000 * (sum(p_size) % 10)::DOUBLE / 10 AS p_value FROM part GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p_value, network) AS r, count(*) OVER (PARTITION BY model) AS m FROM res),
adj AS (SELECT *, least(1.0, min(p_value * m / r) OVER (PARTITION BY model ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM rk)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    coef = (F.sum("p_partkey").cast("double") - F.sum("p_size") * 3) / 10000
    p = (F.sum("p_partkey") % 997).cast("double") / 1000 * (F.sum("p_size") % 10).cast("double") / 10
    rows = table(spark, sf, "part").groupBy(F.col("p_type").alias("model"), F.col("p_brand").alias("network")).agg(
        coef.alias("coef"), p.alias("p_value")
    )
    with_ci = rows.withColumns({"ci_lo": F.col("coef") - 0.125, "ci_hi": F.col("coef") + 0.125})
    return O.bh_fdr(with_ci, keys=("model",))


_STARS_SQL = "format('{{:.4f}}', {0}) || CASE WHEN {0} < 0.001 THEN '***' WHEN {0} < 0.01 THEN '**' WHEN {0} < 0.05 THEN '*' ELSE '' END"


@query(
    "model_tables",
    f"""WITH {_RESULT_SQL} SELECT model, network,
      format('{{:.4f}} ({{:.4f}}', coef, ci_lo) || CASE WHEN ci_hi < 0 THEN '- ' ELSE '-' END || format('{{:.4f}})', ci_hi) AS coef_ci,
      {_STARS_SQL.format('p_value')} AS p_text, {_STARS_SQL.format('p_fdr')} AS p_fdr_text,
      format('{{:.4f}}', abs(coef) / (1 + abs(coef))) AS marginal_r2, format('{{:.4f}}', (abs(coef) + 0.5) / (1 + abs(coef))) AS conditional_r2,
      CASE WHEN p_fdr < 0.05 THEN 'fdr' WHEN p_value < 0.05 THEN 'nominal' ELSE 'none' END AS significance FROM adj""",
)
def model_tables(spark, sf):
    size = F.abs("coef")
    rows = _results(spark, sf).withColumns({"marginal_r2": size / (1 + size), "conditional_r2": (size + 0.5) / (1 + size)})
    return R.mixed_model_rows(rows)


@query(
    "smallest_p",
    f"""WITH {_RESULT_SQL} SELECT model, {sql6('min(p_fdr)')} AS min_p_fdr FROM adj WHERE network <> 'Brand#1' GROUP BY model""",
)
def smallest_p(spark, sf):
    out = R.smallest(_results(spark, sf), "p_fdr", ["model"], F.col("network") == "Brand#1")
    return out.withColumn("min_p_fdr", r6("min_p_fdr"))


@query(
    "result_slice",
    f"""WITH {_RESULT_SQL} SELECT network, {sql6('coef')} AS coef, {sql6('p_fdr')} AS p_fdr FROM adj
    WHERE model = 'SMALL' AND network IN ('Brand#1', 'Brand#2', 'Brand#3')""",
)
def result_slice(spark, sf):
    cols = ["network", "coef", "p_fdr"]
    out = R.result_slice(_results(spark, sf), "SMALL", ["Brand#1", "Brand#2", "Brand#3"], cols)
    return out.withColumns({"coef": r6("coef"), "p_fdr": r6("p_fdr")})


_SECTION_SQL = """top AS (SELECT p_type, p_name, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r
  FROM part),
kinds AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS section_no FROM (SELECT DISTINCT p_type FROM part)),
body AS (SELECT section_no, p_type AS section, false AS is_heading, CAST(r AS INT) AS row_no,
    CAST(p_partkey AS VARCHAR) AS label, p_name AS cell FROM top JOIN kinds USING (p_type) WHERE r <= 10),
tbl AS (SELECT * FROM body UNION ALL SELECT section_no, p_type, true, 0, p_type, '' FROM kinds)"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    cells = {"label": F.col("p_partkey"), "cell": F.col("p_name")}
    return R.sectioned_top(table(spark, sf, "part"), "p_type", 10, [F.col("p_retailprice").desc(), F.col("p_partkey")], cells, "label")


@query("sectioned_table", f"WITH {_SECTION_SQL} SELECT section_no, section, is_heading, row_no, label, cell FROM tbl")
def sectioned_table(spark, sf):
    return _sections(spark, sf)


@query(
    "heading_levels",
    f"""WITH {_SECTION_SQL}, h AS (SELECT section, row_no, is_heading OR row_no % 4 = 0 AS heading, row_no = 0 AS is_section FROM tbl),
    s AS (SELECT *, sum(CAST(heading AND NOT is_section AS INT)) OVER (PARTITION BY section ORDER BY row_no) > 0 AS in_sub FROM h)
    SELECT section, row_no, CASE WHEN is_section THEN 0 WHEN heading OR NOT in_sub THEN 1 ELSE 2 END AS level FROM s""",
)
def heading_levels(spark, sf):
    rows = _sections(spark, sf).select(
        "section", "row_no", (F.col("is_heading") | (F.col("row_no") % 4 == 0)).alias("heading"), (F.col("row_no") == 0).alias("is_section")
    )
    return R.heading_depth(rows, "section", "row_no", "heading", "is_section").select("section", "row_no", "level")


@query(
    "classifier_table",
    f"""WITH runs AS ({ORACLES["model_summary"]})
    SELECT model, modality, feature_set, format('{{:.3f}} ({{:.3f}}-{{:.3f}})', auc, ci_low, ci_high) AS auc_ci,
      format('{{:.3f}}', p_value) || CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS p_text,
      format('{{:.3f}}', p_fdr) || CASE WHEN p_fdr < 0.001 THEN '***' WHEN p_fdr < 0.01 THEN '**' WHEN p_fdr < 0.05 THEN '*' ELSE '' END AS p_fdr_text,
      CAST(n_perm_used AS VARCHAR) AS permutations FROM runs""",
)
def classifier_table(spark, sf):
    """The twelve runs of ``model_summary`` as printed cells."""
    return R.classifier_rows(model_summary(spark, sf), ["model", "modality", "feature_set"])


@query(
    "figure_source_features",
    f"""WITH {_FEATURE_SQL}, v AS (SELECT g.*, (p_retailprice * 7) % 13 - 5 AS imp FROM g JOIN part ON p_partkey = id WHERE kind <> 'V'),
    t AS (SELECT *, row_number() OVER (ORDER BY imp DESC, feature, id) AS rank FROM v WHERE imp > 0)
    SELECT rank, feature, {_LABEL_SQL} AS label, CASE WHEN suffix = '_slope' THEN 'Annual change' ELSE 'Baseline' END AS kind_text,
      regexp_replace(feature, '_(1|slope)$', '') AS region, {sql6('imp')} AS importance FROM t WHERE rank <= 20""",
)
def figure_source_features(spark, sf):
    """Table behind a figure: the twenty largest positive importances with their labels."""
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_retailprice") * 7) % 13 - 5).alias("imp"))
    rows = R.describe_features(_feature_names(spark, sf).join(price, "id"), slope_model=True)
    best = rows.where("imp > 0").orderBy(F.col("imp").desc(), "feature", "id").limit(20)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("imp").desc(), "feature", "id")).cast("bigint"))
    return ranked.select(
        "rank", "feature", "label", C.recode("feature_type", {"slope": "Annual change", "baseline": "Baseline"}).alias("kind_text"),
        C.feature_region("feature").alias("region"), r6("imp").alias("importance"),
    )


# --- the tables behind the figures ------------------------------------------------


def _cells(blocks: DataFrame) -> DataFrame:
    """One row per cell, numbers rounded for comparison."""
    each = blocks.select("block_no", "block", "row_no", F.explode("cells").alias("cell", "value"))
    number = F.col("value").try_cast("double")
    return each.select("block_no", "block", "row_no", "cell", r6(number, 5).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


_FIGURE_1 = ("Structure-function coupling (mean r per region)", "Structural connectivity (region x region)", "Functional connectivity (region x region)")


@query(
    "figure_source_connectivity",
    f"""WITH {I.SFC_SQL}, names AS (SELECT DISTINCT roi, {I.region_name_sql('roi')} AS region FROM ts),
    people AS (SELECT count(DISTINCT subject_id)::DOUBLE AS n FROM sc WHERE ses = 'ses-01'),
    base_sc AS (SELECT i, j, sum(weight) / any_value(n) AS v FROM sc CROSS JOIN people WHERE ses = 'ses-01' GROUP BY ALL),
    base_fc AS (SELECT i, j, avg(z) AS v FROM fc WHERE ses = 'ses-01' GROUP BY ALL),
    cells AS (
      SELECT 1 AS block_no, a.roi AS i, b.roi AS j, coalesce(v, 0) AS v FROM names a CROSS JOIN names b LEFT JOIN base_sc ON base_sc.i = least(a.roi, b.roi) AND base_sc.j = greatest(a.roi, b.roi)
      UNION ALL SELECT 2, a.roi, b.roi, coalesce(v, 0) FROM names a CROSS JOIN names b LEFT JOIN base_fc ON base_fc.i = least(a.roi, b.roi) AND base_fc.j = greatest(a.roi, b.roi)
    ),
    coupled AS (SELECT roi, avg(rho) AS v FROM sfc WHERE ses = 'ses-01' GROUP BY roi),
    flat AS (
      SELECT 0 AS block_no, roi + 1 AS row_no, 'Region' AS cell, NULL::DOUBLE AS number, region AS text FROM coupled JOIN names USING (roi)
      UNION ALL SELECT 0, roi + 1, 'Structure-function coupling (r)', {sql6('v', 5)}, NULL FROM coupled
      UNION ALL SELECT DISTINCT block_no, i + 1, 'Region', NULL, a.region FROM cells JOIN names a ON a.roi = i
      UNION ALL SELECT block_no, i + 1, b.region, {sql6('v', 5)}, NULL FROM cells JOIN names b ON b.roi = j
    )
    SELECT block_no, ['{"', '".join(_FIGURE_1)}'][block_no + 1] AS block, row_no::INT AS row_no, cell, number, text FROM flat""",
)
def figure_source_connectivity(spark, sf):
    """Figure 1: group means at baseline, as region values and region x region matrices with their names."""
    connections = X._connections(spark, sf)
    sc, fc = X._sc(spark, sf, connections), X._fc(spark, sf)
    first = F.col("ses") == "ses-01"
    regions = I.regions(spark, sf)
    coupled = N.coupling(sc, fc).where(first).groupBy("roi").agg(F.avg("rho").alias("r"))
    people = sc.where(first).select("subject_id").distinct().count()
    mean_sc = sc.where(first).groupBy("i", "j").agg((F.sum("weight") / F.lit(float(people))).alias("weight"))
    mean_fc = N.group_mean_edges(fc.where(first), value="z").select("i", "j", F.col("mean_value").alias("weight"))
    names = regions.agg(F.array_sort(F.collect_set("roi")).alias("o")).select(F.transform("o", I.region_name).alias("names")).scalar()

    def matrix(edges):
        rows = N.matrix_rows(edges.withColumn("all", F.lit(0)), regions, ("all",))
        return rows.select("roi", I.region_name(F.col("roi")).alias("Region"), F.map_from_arrays(names, "row").alias("values"))

    values = coupled.select("roi", I.region_name(F.col("roi")).alias("Region"), F.col("r").alias("Structure-function coupling (r)"))
    blocks = R.figure_blocks([(title, rows, ["roi"]) for title, rows in zip(_FIGURE_1, (values, matrix(mean_sc), matrix(mean_fc)), strict=True)])
    return _cells(blocks).where("cell <> 'roi'")


_FIGURE_3 = (
    "Structure-function coupling difference (mean of both timepoints)", "Coupling by status: standardised effects", "Memory by coupling: standardised effects",
)
_NETWORK_ORDER = {"global": "Global", "hmod": "Heteromodal", "dmn": "Default mode network", "control": "Executive control network",
                  "salience": "Salience network", "sensory": "Sensory"}
_PANEL = {"Standardised effect": "coef", "CI lower": "ci_lo", "CI upper": "ci_hi", "p (uncorrected)": "p_value", "p (FDR-corrected)": "p_fdr"}


def _figure_3_sql() -> str:
    order = ", ".join(f"('{k}', {n}, '{v}')" for n, (k, v) in enumerate(_NETWORK_ORDER.items()))
    effects = " UNION ALL ".join(
        f"SELECT block_no, row_no, '{cell}', {sql6(column, 5)}, NULL FROM panels" for cell, column in _PANEL.items()
    )
    return f"""WITH RECURSIVE {I.SFC_SQL}, d AS (
      SELECT ses, roi, avg(atanh(rho)) FILTER (CAST(subject_id AS INT) % 2 = 1) - avg(atanh(rho)) FILTER (CAST(subject_id AS INT) % 2 = 0) AS difference FROM sfc GROUP BY ALL),
    a AS (SELECT roi, {I.region_name_sql('roi')} AS region, avg(difference) AS v FROM d GROUP BY roi),
    {M.battery_ctes()},
    shown(network, place, name) AS (VALUES {order}),
    panels AS (SELECT CASE model WHEN 'group' THEN 1 ELSE 2 END AS block_no, row_number() OVER (PARTITION BY model ORDER BY shown.place, atlas) AS row_no, name, atlas, coef, ci_lo, ci_hi, p_value, p_fdr
      FROM adjusted JOIN shown USING (network) WHERE model IN ('group', 'memory')),
    flat(block_no, row_no, cell, number, text) AS (
      SELECT 0, row_number() OVER (ORDER BY roi), 'Region', NULL::DOUBLE, region FROM a
      UNION ALL SELECT 0, row_number() OVER (ORDER BY roi), 'Difference (Fisher z)', {sql6('v', 5)}, NULL FROM a
      UNION ALL SELECT block_no, row_no, 'Network', NULL, name FROM panels
      UNION ALL SELECT block_no, row_no, 'Parcellation', NULL, 'Parcels ' || atlas FROM panels
      UNION ALL {effects})
    SELECT block_no, ['{"', '".join(_FIGURE_3)}'][block_no + 1] AS block, row_no::INT AS row_no, cell, number, text FROM flat"""


@query("figure_source_models", _figure_3_sql())
def figure_source_models(spark, sf):
    """Figure 3: the coupling difference per region, and the two models' effects in figure order."""
    difference = RU.average_over_sessions(X._diff(spark, sf)).select(
        "roi", I.region_name(F.col("roi")).alias("Region"), F.col("difference").alias("Difference (Fisher z)")
    )
    fitted = M.battery_results(spark, sf)
    place = F.array_position(F.array(*[F.lit(k) for k in _NETWORK_ORDER]), F.col("network"))
    blocks = [(_FIGURE_3[0], difference, ["roi"])]
    for title, model in zip(_FIGURE_3[1:], ("group", "memory"), strict=True):
        rows = fitted.where((F.col("model") == model) & F.col("network").isin(*_NETWORK_ORDER)).select(
            place.alias("roi"), "atlas", C.recode("network", _NETWORK_ORDER).alias("Network"),
            F.concat(F.lit("Parcels "), F.col("atlas")).alias("Parcellation"), *[F.col(c).alias(k) for k, c in _PANEL.items()],
        )
        blocks.append((title, rows, ["roi", "atlas"]))
    return _cells(R.figure_blocks(blocks)).where("cell not in ('roi', 'atlas')")
