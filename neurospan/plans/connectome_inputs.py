"""The study's inputs derived from the bundled tables.

Subjects, sessions, frames, regions and streamlines are all functions of the
rows of ``embeddings`` and ``lineitem``, so the work grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.session import table

N_REGIONS = 64
NETWORK_CYCLE = ("Vis", "SomMot", "DorsAttn", "SalVentAttn", "Limbic", "Cont", "Default")
STRUCTURE_CYCLE = ("Hippocampus", "Amygdala", "Caudate", "Thalamus")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings -> (subject_id, ses, frame, signal)."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("subject_id"),
        F.concat(F.lit("ses-0"), (F.col("vec_id") % 2 + 1).cast("string")).alias("ses"),
        F.col("vec_id").alias("frame"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )


def streamlines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem -> (subject_id, ses, node_a, node_b, weight)."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 10).cast("string").alias("subject_id"),
        F.concat(F.lit("ses-0"), (F.col("l_linenumber") % 2 + 1).cast("string")).alias("ses"),
        (F.col("l_partkey") % N_REGIONS).cast("int").alias("node_a"),
        ((F.floor(F.col("l_orderkey") / 10) + F.col("l_linenumber") * 13) % N_REGIONS).cast("int").alias("node_b"),
        F.col("l_quantity").alias("weight"),
    )


def node_volumes(connections: DataFrame) -> DataFrame:
    """Endpoints per node stand in for node volume."""
    ends = F.explode(F.array("node_a", "node_b")).alias("node")
    return connections.select("subject_id", "ses", "n", ends).groupBy("subject_id", "ses", "node").agg(F.sum("n").alias("volume"))


def region_name(k: Column) -> Column:
    """Region label from its position: 56 cortical, then 8 subcortical."""
    nets = F.array(*[F.lit(n) for n in NETWORK_CYCLE])
    parts = F.array(*[F.lit(n) for n in STRUCTURE_CYCLE])
    cortical = F.concat(
        F.lit("7Networks_"), F.when(k % 2 == 0, "LH").otherwise("RH"), F.lit("_"),
        F.get(nets, F.floor(k / 8).cast("int")), F.lit("_"), k.cast("string"),
    )
    sub = F.concat(
        F.lit("Subcortical "), (k + 145).cast("string"), F.lit(": "),
        F.when(k < 60, "Left ").otherwise("Right "), F.get(parts, (k % 4).cast("int")),
    )
    return F.when(k < 56, cortical).otherwise(sub)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Region positions of the signals: one number is read per frame, and the list is as long as the atlas."""
    width = series(spark, sf).agg(F.max(F.size("signal")).alias("p"))
    return width.select(F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("roi"))


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Every subject and session that has signals."""
    return series(spark, sf).select("subject_id", "ses").distinct()


# SQL twins -------------------------------------------------------------------

SERIES_SQL = """ts AS (
  SELECT CAST(label AS VARCHAR) AS subject_id, 'ses-0' || CAST(vec_id % 2 + 1 AS VARCHAR) AS ses, vec_id AS frame,
         CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS roi, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""

FC_SQL = SERIES_SQL + """, fc AS (
  SELECT a.subject_id, a.ses, a.roi AS i, b.roi AS j, corr(a.v, b.v) AS r, atanh(corr(a.v, b.v)) AS z
  FROM ts a JOIN ts b ON a.frame = b.frame AND a.subject_id = b.subject_id AND a.roi < b.roi
  GROUP BY ALL)"""


def shrink_sql(source: str, keys: str) -> str:
    """Ledoit-Wolf in SQL over ``source`` (keys, frame, roi, v)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
  centred AS (SELECT {keys}, frame, roi, v - avg(v) OVER (PARTITION BY {keys}, roi) AS x FROM {source}),
  cov AS (SELECT {", ".join("a." + k for k in keys.split(", "))}, a.roi AS i, b.roi AS j, avg(a.x * b.x) AS s
          FROM centred a JOIN centred b ON a.frame = b.frame AND {on} GROUP BY ALL),
  quart AS (SELECT {keys}, avg(q * q) AS q, count(*) AS n
            FROM (SELECT {keys}, frame, sum(x * x) AS q FROM centred GROUP BY ALL) GROUP BY ALL),
  size AS (SELECT {keys}, sum(s * s) AS fro2, sum(CASE WHEN i = j THEN s END) / count(DISTINCT i) AS mu,
                  CAST(count(DISTINCT i) AS DOUBLE) AS p FROM cov GROUP BY ALL),
  lw AS (SELECT {keys}, mu, (fro2 - p * mu * mu) / p AS delta2,
                least((q - fro2) / (p * n), (fro2 - p * mu * mu) / p) AS beta2 FROM size JOIN quart USING ({keys})),
  rho AS (SELECT {keys}, mu, CASE WHEN delta2 <> 0 THEN beta2 / delta2 ELSE 0 END AS rho FROM lw),
  dia AS (SELECT {keys}, i AS roi, (1 - rho) * s + rho * mu AS d FROM cov JOIN rho USING ({keys}) WHERE i = j),
  shrunk AS (SELECT {", ".join("c." + k for k in keys.split(", "))}, c.i, c.j, r.rho, (1 - r.rho) * c.s / sqrt(a.d * b.d) AS r
             FROM cov c JOIN rho r USING ({keys}) JOIN dia a ON a.roi = c.i AND {on.replace('b.', 'c.')}
             JOIN dia b ON b.roi = c.j AND {on.replace('a.', 'c.')} WHERE c.i < c.j)"""


PLAIN_FC_SQL, FC_SQL = FC_SQL, SERIES_SQL + ", " + shrink_sql("ts", "subject_id, ses") + """, fc AS (
  SELECT subject_id, ses, i, j, r, atanh(r) AS z FROM shrunk)"""

LINES_SQL = """lines AS (
  SELECT CAST(l_orderkey % 10 AS VARCHAR) AS subject_id, 'ses-0' || CAST(l_linenumber % 2 + 1 AS VARCHAR) AS ses,
         CAST(l_partkey % 64 AS INT) AS node_a,
         CAST((l_orderkey // 10 + l_linenumber * 13) % 64 AS INT) AS node_b, l_quantity AS weight
  FROM lineitem)"""

SC_SQL = LINES_SQL + """, vol AS (
  SELECT subject_id, ses, node, count(*) AS volume FROM (
    SELECT subject_id, ses, node_a AS node FROM lines UNION ALL SELECT subject_id, ses, node_b FROM lines)
  GROUP BY ALL),
sc0 AS (
  SELECT subject_id, ses, least(node_a, node_b) AS i, greatest(node_a, node_b) AS j, count(*) AS n_streamlines,
         sum(weight) AS w
  FROM lines WHERE node_a <> node_b GROUP BY ALL),
sc AS (
  SELECT s.subject_id, s.ses, s.i, s.j, s.n_streamlines, s.w * 2 / (a.volume + b.volume) AS weight
  FROM sc0 s JOIN vol a ON a.subject_id = s.subject_id AND a.ses = s.ses AND a.node = s.i
             JOIN vol b ON b.subject_id = s.subject_id AND b.ses = s.ses AND b.node = s.j)"""

SFC_SQL = FC_SQL + ", " + SC_SQL + """, both_edges AS (
  SELECT sc.subject_id, sc.ses, sc.i, sc.j, sc.weight AS s, fc.z AS f
  FROM sc JOIN fc USING (subject_id, ses, i, j) WHERE sc.weight <> 0 AND fc.z <> 0),
mirrored AS (
  SELECT subject_id, ses, i AS roi, s, f FROM both_edges UNION ALL SELECT subject_id, ses, j, s, f FROM both_edges),
sfc AS (
  SELECT subject_id, ses, roi, count(*) AS n_partners,
         CASE WHEN stddev_pop(s) > 0 AND stddev_pop(f) > 0 THEN
           CASE WHEN abs(corr(s, f)) > 1 - 1e-12 THEN CAST(sign(corr(s, f)) AS DOUBLE) ELSE corr(s, f) END END AS rho
  FROM mirrored GROUP BY ALL)"""


def _sql_array(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def region_name_sql(k: str) -> str:
    return (
        f"CASE WHEN {k} < 56 THEN '7Networks_' || CASE WHEN {k} % 2 = 0 THEN 'LH' ELSE 'RH' END || '_' || "
        f"{_sql_array(NETWORK_CYCLE)}[{k} // 8 + 1] || '_' || CAST({k} AS VARCHAR) "
        f"ELSE 'Subcortical ' || CAST({k} + 145 AS VARCHAR) || ': ' || "
        f"CASE WHEN {k} < 60 THEN 'Left ' ELSE 'Right ' END || {_sql_array(STRUCTURE_CYCLE)}[{k} % 4 + 1] END"
    )
