"""Result tables: rankings, sections, formatted cells, agreement summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.functions import columns as C
from neurospan.operators.discrimination import top_k_overlap
from neurospan.operators.groupstats import spearman
from neurospan.operators.ordered import competition_rank, numbered
from neurospan.session import scratch_dir
from neurospan.sources.sinks import materialise

# Sub-region abbreviations of the public cortical atlas.
REGION_ABBREVIATIONS = {
    "AntTemp": "Anterior temporal",
    "Aud": "Auditory",
    "Cent": "Central",
    "Cinga": "Cingulate anterior",
    "Cingm": "Mid-cingulate",
    "Cingp": "Cingulate posterior",
    "Cing": "Cingulate",
    "ExStrInf": "Extrastriate inferior",
    "ExStrSup": "Extrastriate superior",
    "ExStr": "Extrastriate",
    "FEF": "Frontal eye fields",
    "FPole": "Frontal pole",
    "FrMed": "Frontal medial",
    "FrOperIns": "Frontal operculum insula",
    "FrOper": "Frontal operculum",
    "IFG": "Inferior frontal gyrus",
    "Ins": "Insula",
    "IPL": "Inferior parietal lobule",
    "IPS": "Intraparietal sulcus",
    "Med": "Medial",
    "OFC": "Orbital frontal cortex",
    "ParMed": "Parietal medial",
    "ParOcc": "Parietal occipital",
    "ParOper": "Parietal operculum",
    "Par": "Parietal",
    "pCunPCC": "Precuneus/PCC",
    "pCun": "Precuneus",
    "PFCdPFCm": "Dorsal medial PFC",
    "PFCd": "Dorsal PFC",
    "PFCld": "Lateral dorsal PFC",
    "PFClv": "Lateral ventral PFC",
    "PFCl": "Lateral PFC",
    "PFCmp": "Medial posterior PFC",
    "PFCm": "Medial PFC",
    "PFCv": "Ventral PFC",
    "PFC": "Prefrontal cortex",
    "PHC": "Parahippocampal cortex",
    "Post": "Posterior",
    "PostC": "Post-central",
    "PrCd": "Precentral dorsal",
    "PrCv": "Precentral ventral",
    "PrC": "Precentral",
    "RSC": "Retrosplenial cortex",
    "Rsp": "Retrosplenial",
    "S2": "S2",
    "SPL": "Superior parietal lobule",
    "ST": "Superior temporal",
    "Striate": "Striate",
    "StriCal": "Striate calcarine",
    "TempOccPar": "Temporal occipital parietal",
    "TempOcc": "Temporal occipital",
    "TempPar": "Temporal parietal",
    "TempPole": "Temporal pole",
    "Temp": "Temporal",
}
VAGUE_REGIONS = ("Med", "Post")  # fixed values: these need their network in the label


def _lookup(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def feature_label(feature: Column | str, slope_model: bool = False) -> Column:
    """Readable label of a region feature: side, region name and parcel number."""
    f = C.feature_region(feature) if slope_model else C.as_col(feature)
    tokens = F.split(f, "_", 4)
    side, net = F.get(tokens, F.lit(1)), F.get(tokens, F.lit(2))
    rest = F.coalesce(F.get(tokens, F.lit(3)), net)
    number = F.regexp_extract(rest, "(?:^|_)([0-9]+)$", 1)
    stem = F.regexp_replace(rest, "(?:^|_)[0-9]+$", "")
    net_name = F.coalesce(F.try_element_at(_lookup(C.NETWORK_NAMES), net), net)
    name = F.when(stem == "", net_name).otherwise(
        F.coalesce(F.try_element_at(_lookup(REGION_ABBREVIATIONS), stem), stem)
    )
    lowered = F.concat(F.lower(F.substring(name, 1, 1)), _tail(name))
    network_part = F.when(stem.isin(*VAGUE_REGIONS), F.concat(F.lower(net_name), F.lit(" "))).otherwise("")
    suffix = F.when(number != "", F.concat(F.lit(" ("), number, F.lit(")"))).otherwise("")
    cortical = F.concat(side, F.lit(" "), network_part, lowered, suffix)
    tail = F.when(F.instr(f, ":") > 0, F.regexp_replace(f, "^[^:]*: ?", "")).otherwise(f)
    short = F.replace(F.replace(tail, F.lit("Right "), F.lit("R ")), F.lit("Left "), F.lit("L "))
    sub = F.concat(F.substring(short, 1, 1), F.lower(_tail(short)))
    return F.when(f.startswith("7Networks_"), cortical).when(C.is_subcortical(f), sub).otherwise(f)


def _tail(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c))


def describe_features(df: DataFrame, feature: str = "feature", slope_model: bool = False) -> DataFrame:
    """Add network, feature type and label; covariates are not features."""
    kind = C.feature_kind(feature) if slope_model else F.lit("baseline")
    return df.where(~F.col(feature).startswith("cov_")).withColumns({
        "network": C.feature_network(feature), "feature_type": kind, "label": feature_label(feature, slope_model),
    })


def top_features(df: DataFrame, n: int, by: str = "perm_importance_mean", uid: str = "feature",
                 positive_only: bool = False) -> DataFrame:
    rows = df.where(F.col(by) > 0) if positive_only else df
    return rows.orderBy(F.col(by).desc(), F.col(uid)).limit(n)


def with_model_ranks(a: DataFrame, b: DataFrame, uid: str = "feature", by: str = "perm_importance_mean") -> DataFrame:
    """Importance rank in both models (1 = most important, ties share the best rank)."""
    other = competition_rank(b.select(uid, by), by, "svm_rank").select(uid, "svm_rank")
    return competition_rank(a, by, "en_rank").join(other, uid, "left")


def model_agreement(a: DataFrame, b: DataFrame, k: int, uid: str = "feature", by: str = "perm_importance_mean") -> DataFrame:
    """Spearman correlation of the two importances and how many of the top k both share."""
    both = a.select(uid, F.col(by).alias("en")).join(b.select(uid, F.col(by).alias("svm")), uid)
    shared = top_k_overlap(both, uid, "en", "svm", k)
    return spearman(both, "en", "svm").select(
        F.col("rho").alias("spearman_rho"), F.col("n").alias("n_features"), F.lit(k).alias("top_n"),
    ).withColumn("top_n_shared", shared.scalar())


def sectioned(parts: Sequence[tuple[str, DataFrame, str]], label: str) -> DataFrame:
    """Heading row then data rows per section, with an explicit ``row_no``.

    ``parts`` is (heading, rows, order column).  These are report tables (top-k
    lists, model grids), so numbering a section is a small window.
    """
    out = None
    for k, (heading, rows, order) in enumerate(parts):
        cells = [c for c in rows.columns if c != order]
        body = rows.select(
            F.lit(k).alias("section_no"), F.lit(heading).alias("section"), F.lit(False).alias("is_heading"),
            F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(order)).alias("row_no"),
            *[F.col(c).cast("string").alias(c) for c in cells],
        )
        spark = rows.sparkSession
        head = spark.range(1).select(
            F.lit(k).alias("section_no"), F.lit(heading).alias("section"), F.lit(True).alias("is_heading"),
            F.lit(0).alias("row_no"),
            *[(F.lit(heading) if c == label else F.lit("")).alias(c) for c in cells],
        )
        part = head.unionByName(body)
        out = part if out is None else out.unionByName(part)
    return out


def sectioned_top(rows: DataFrame, section: str, n: int, order: Sequence[Column], cells: Mapping[str, Column], label: str) -> DataFrame:
    """Heading row and the first ``n`` rows of every section, sections numbered in their order.

    The sections come from the data: each task passes on at most ``n`` rows per section, what is left is stored, and the
    plan is the same for any number of sections.
    """
    own = Window.partitionBy(section).orderBy(*order)
    best = rows.withColumn("row_no", F.row_number().over(own)).where(F.col("row_no") <= n)
    spark = rows.sparkSession
    best = materialise(best.select(section, "row_no", *[c.cast("string").alias(k) for k, c in cells.items()]), scratch_dir(spark, "sections"))
    named = numbered(best.select(section).distinct(), [section], "section_no").withColumnRenamed(section, "section")
    named = materialise(named.select("section", (F.col("section_no") - 1).cast("int").alias("section_no")), scratch_dir(spark, "headings"))
    body = best.join(named, F.col(section).eqNullSafe(F.col("section"))).select(
        "section_no", "section", F.lit(False).alias("is_heading"), "row_no", *cells
    )
    head = named.select(
        "section_no", "section", F.lit(True).alias("is_heading"), F.lit(0).alias("row_no"),
        *[(F.col("section") if c == label else F.lit("")).alias(c) for c in cells],
    )
    return head.unionByName(body)


def figure_blocks(blocks: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Tables of different shapes in one: (block_no, block, row_no, cells), cells being a map from column to text.

    ``blocks`` are (title, table, order); a table is as long as a figure's panel, so numbering its rows is a small window.
    A column that is a map itself (a matrix row) gives its entries.
    """
    out = None
    for k, (title, rows, order) in enumerate(blocks):
        plain = [f for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
        cells = F.map_from_entries(F.array(*[F.struct(F.lit(f.name), F.col(f.name).cast("string")) for f in plain]))
        for f in rows.schema.fields:
            if isinstance(f.dataType, T.MapType):
                cells = F.map_concat(cells, F.transform_values(f.name, lambda _, v: v.cast("string")))
        number = F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(*order))
        part = rows.select(F.lit(k).alias("block_no"), F.lit(title).alias("block"), number.alias("row_no"), cells.alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


def heading_depth(df: DataFrame, section: str, order: str, heading: str, is_section: str, out: str = "level") -> DataFrame:
    """Indent level of table rows: running count of sub-headings inside each section."""
    within = Window.partitionBy(section).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sub = F.col(heading) & ~F.col(is_section)
    in_sub = F.sum(sub.cast("int")).over(within) > 0
    level = F.when((F.col(section) == "") | F.col(is_section), 0).when(F.col(heading) | ~in_sub, 1).otherwise(2)
    return df.withColumn(out, level)


def mixed_model_rows(results: DataFrame) -> DataFrame:
    """Formatted mixed-model cells."""
    return results.select(
        *[c for c in ("atlas", "model", "network") if c in results.columns],
        C.coef_ci_text("coef", "ci_lo", "ci_hi").alias("coef_ci"),
        C.p_stars_text("p_value").alias("p_text"), C.p_stars_text("p_fdr").alias("p_fdr_text"),
        C.fixed("marginal_r2", 4).alias("marginal_r2"), C.fixed("conditional_r2", 4).alias("conditional_r2"),
        C.significance("p_value", "p_fdr").alias("significance"),
    )


def classifier_rows(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Formatted classifier cells: AUC (interval), p, adjusted p, permutations."""
    ci = F.concat(C.fixed("auc", 3), F.lit(" ("), C.fixed("ci_low", 3), F.lit("-"), C.fixed("ci_high", 3), F.lit(")"))
    return results.select(
        *keys, ci.alias("auc_ci"), C.p_stars_text("p_value", 3).alias("p_text"),
        C.p_stars_text("p_fdr", 3).alias("p_fdr_text"), F.col("n_perm_used").cast("string").alias("permutations"),
    )


def smallest(results: DataFrame, stat: str, by: Sequence[str], exclude: Column | None = None) -> DataFrame:
    """Smallest statistic per group, leaving out rows reported separately."""
    rows = results if exclude is None else results.where(~exclude)
    return rows.groupBy(*by).agg(F.min(stat).alias(f"min_{stat}"))


def result_slice(results: DataFrame, model: str, networks: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return results.where((F.col("model") == model) & F.col("network").isin(*networks)).select(*columns)
