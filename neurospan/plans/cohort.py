"""Queries: identifiers, dates, visits, norms, classification, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.operators import clean, norms, quality, visits
from neurospan.operators.groupstats import value_counts
from neurospan.plans import connectome_inputs as I
from neurospan.plans.registry import query, r6, sql6
from neurospan.session import table

# --- identifiers and recoding ----------------------------------------------------

_ID_SQL = """raw AS (SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'sub-' ELSE '' END || CASE WHEN c_custkey % 7 = 6 THEN 'x' ELSE '' END
    || CAST(c_custkey + 5200 AS VARCHAR) AS id FROM customer)"""


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    text = F.concat(
        F.when(key % 3 == 0, "sub-").otherwise(""), F.when(key % 7 == 6, "x").otherwise(""),
        (key + 5200).cast("string"),
    )
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", text.alias("id"))


@query(
    "harmonise_ids_cohort",
    f"""WITH {_ID_SQL}, k AS (SELECT *, regexp_replace(id, '^sub-', '') AS subject_id FROM raw),
    n AS (SELECT *, TRY_CAST(subject_id AS BIGINT) AS num, CASE c_nationkey % 3 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS sex FROM k)
    SELECT c_custkey, subject_id, num, CASE WHEN num > 6000 THEN 'A' WHEN num <= 6000 THEN 'B' END AS cohort, sex,
           CASE sex WHEN 'male' THEN 1.0::DOUBLE WHEN 'female' THEN 0.0::DOUBLE END AS sex_code,
           CASE WHEN num > 6000 THEN 'a/sub-' || subject_id || '_ses-01_run-01'
                WHEN num <= 6000 THEN 'b/sub-' || subject_id || '_ses-01' END AS source_path
    FROM n""",
)
def harmonise_ids_cohort(spark, sf):
    sex = C.recode(F.col("c_nationkey") % 3, {1: "male", 2: "female"})
    keyed = _ids(spark, sf).withColumns({"subject_id": C.subject_key("id"), "sex": sex})
    paths = {"A": "a/sub-%s_%s_run-01", "B": "b/sub-%s_%s"}
    return keyed.select(
        "c_custkey", "subject_id", C.subject_number("subject_id").alias("num"),
        C.cohort("subject_id").alias("cohort"), "sex",
        C.recode("sex", {"male": 1.0, "female": 0.0}).alias("sex_code"),
        C.cohort_path("subject_id", F.lit("ses-01"), paths).alias("source_path"),
    )


@query(
    "regex_rename",
    """SELECT c_custkey AS id, c_acctbal AS acctbal_1, c_acctbal * 2 AS acctbal_2, c_mktsegment AS sfc_segment_1,
    c_nationkey AS w2_nation FROM customer""",
)
def regex_rename(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("w1_acctbal"),
        (F.col("c_acctbal") * 2).alias("w2_acctbal"), F.col("c_mktsegment").alias("sfc_tp1_segment"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"),
    )
    renamed = clean.drop_paired_bases(clean.visit_names(raw))
    return clean.prefix_columns(renamed, ["nation"])


@query(
    "blank_invalid",
    """WITH bad AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 1000)
    SELECT c_custkey, CASE WHEN c_custkey NOT IN (3, 5, 8) THEN c_acctbal END AS listed,
           CASE WHEN c_nationkey NOT IN (SELECT s_nationkey FROM bad) THEN c_acctbal END AS by_table FROM customer""",
)
def blank_invalid(spark, sf):
    base = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_acctbal").alias("listed"), F.col("c_acctbal").alias("by_table")
    )
    invalid = table(spark, sf, "supplier").where("s_acctbal < 1000").select(
        F.col("s_nationkey").alias("c_nationkey"), F.lit("by_table").alias("column")
    )
    listed = clean.blank_listed(base, "c_custkey", {"listed": [3, 5, 8]})
    return clean.blank_by_table(listed, "c_nationkey", invalid, ["by_table"]).drop("c_nationkey")


# --- dates ---------------------------------------------------------------------


@query(
    "fix_dates_age_days",
    f"""WITH d AS (
      SELECT o_orderkey, CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 2 = 0 THEN 22000 ELSE 0 END AS b,
             CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9000 AS INT) AS v FROM orders),
    f AS (SELECT o_orderkey, v, CASE WHEN year(b) % 100 <= 25 THEN make_date(2000 + year(b) % 100, month(b), day(b))
                               ELSE make_date(1900 + year(b) % 100, month(b), day(b)) END AS birth FROM d)
    SELECT o_orderkey, CAST(birth AS VARCHAR) AS birth, CAST(v AS VARCHAR) AS visit,
           {sql6("(v - birth) / 365.25")} AS age FROM f""",
)
def fix_dates_age_days(spark, sf):
    day = F.col("o_orderdate").cast("date")
    text = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(F.date_sub(day, F.when(F.col("o_orderkey") % 2 == 0, 22000).otherwise(0)), "M/d/yy").alias("b"),
        F.date_format(F.date_add(day, (F.col("o_orderkey") % 9000).cast("int")), "M/d/yyyy").alias("v"),
    )
    parsed = text.select("o_orderkey", C.month_day_year("b").alias("birth"), C.month_day_year("v").alias("visit"))
    return parsed.select(
        "o_orderkey", F.col("birth").cast("string").alias("birth"), F.col("visit").cast("string").alias("visit"),
        r6(C.age_by_days("birth", "visit")).alias("age"),
    )


@query(
    "dual_date_age_parts",
    f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b,
      CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9000 AS INT) AS v FROM orders WHERE o_orderkey % 3 < 2)
    SELECT o_orderkey, CAST(b AS VARCHAR) AS birth, CAST(v AS VARCHAR) AS visit,
           {sql6("year(v) - year(b) + (month(v) - month(b)) / 12.0 + (day(v) - day(b)) / 365.25")} AS age FROM d""",
)
def dual_date_age_parts(spark, sf):
    """Two spreadsheet formats plus unreadable text, whose rows drop."""
    day = F.col("o_orderdate").cast("date")
    stamped = F.concat(F.date_format(day, "yyyy-dd-MM"), F.lit(" 00:00:00"))
    kind = F.col("o_orderkey") % 3
    text = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(kind == 0, stamped).when(kind == 1, F.date_format(day, "d/M/yyyy")).otherwise("not a date").alias("b"),
        F.date_format(F.date_add(day, (F.col("o_orderkey") % 9000).cast("int")), "d/M/yyyy").alias("v"),
    )
    parsed = text.select("o_orderkey", C.mixed_date("b").alias("birth"), C.mixed_date("v").alias("visit"))
    return parsed.na.drop(subset=["birth", "visit"]).select(
        "o_orderkey", F.col("birth").cast("string").alias("birth"), F.col("visit").cast("string").alias("visit"),
        r6(C.age_by_parts("birth", "visit")).alias("age"),
    )


@query(
    "lenient_dates",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 < 3 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS d
    FROM lineitem""",
)
def lenient_dates(spark, sf):
    day = F.col("l_shipdate").cast("date")
    kind = F.col("l_partkey") % 4
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "M/d/yyyy"))
        .when(kind == 2, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "d MMM"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", C.lenient_date(text).cast("string").alias("d")
    )


# --- visits --------------------------------------------------------------------

_VISIT_SQL = """o AS (
  SELECT o_custkey AS id, o_orderkey, (CAST(o_orderdate AS DATE) - DATE '1937-06-01') / 365.25 AS age,
         CASE WHEN o_orderkey % 11 = 0 THEN -1.0 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS raw,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down
  FROM orders),
v1 AS (SELECT id, age AS w1_age, raw AS w1_raw FROM o WHERE up = 1 AND age >= 60),
v2 AS (SELECT id, age AS w2_age, raw AS w2_raw FROM o WHERE down = 1 AND id % 4 <> 0)"""


def _orders_as_visits(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 11 == 0, -1.0).when(key % 13 != 0, F.col("o_totalprice"))
    age = C.age_by_days(F.lit("1937-06-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate",
                                              age.alias("age"), raw.alias("raw"))


def _visit_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """First order as visit 1 (age 60 and over), last order as visit 2 (three subjects in four)."""
    both = visits.first_and_last(_orders_as_visits(spark, sf), "id", ["o_orderdate", "o_orderkey"], ["age", "raw"])
    v1 = both.select("id", F.col("age_1").alias("w1_age"), F.col("raw_1").alias("w1_raw")).where("w1_age >= 60")
    v2 = both.where("id % 4 <> 0").select("id", F.col("age_2").alias("w2_age"), F.col("raw_2").alias("w2_raw"))
    return v1, v2


@query(
    "visits_inner",
    f"""WITH {_VISIT_SQL} SELECT id, {sql6('w1_age')} AS w1_age, {sql6('w2_age')} AS w2_age,
    nullif(w1_raw, -1) AS w1_raw, nullif(w2_raw, -1) AS w2_raw FROM v1 JOIN v2 USING (id)
    WHERE w1_age IS NOT NULL AND w2_age IS NOT NULL AND w1_raw IS NOT NULL AND w2_raw IS NOT NULL AND w1_age <> w2_age""",
)
def visits_inner(spark, sf):
    v1, v2 = _visit_tables(spark, sf)
    names = ["w1_age", "w2_age", "w1_raw", "w2_raw"]
    kept = clean.differing(clean.require_then_unmask(v1.join(v2, "id"), names), "w1_age", "w2_age")
    return kept.withColumns({"w1_age": r6("w1_age"), "w2_age": r6("w2_age")})


@query(
    "visits_outer",
    f"""WITH {_VISIT_SQL} SELECT id, {sql6('w1_age')} AS w1_age, {sql6('w2_age')} AS w2_age,
    nullif(w1_raw, -1) AS w1_raw, w2_raw FROM v1 FULL JOIN v2 USING (id)
    WHERE w1_age IS NOT NULL AND w1_raw IS NOT NULL AND w1_age <> 0""",
)
def visits_outer(spark, sf):
    v1, v2 = _visit_tables(spark, sf)
    kept = clean.require_then_unmask(v1.join(v2, "id", "full"), ["w1_age", "w1_raw"])
    return clean.not_equal_or_unknown(kept, "w1_age", 0).withColumns({"w1_age": r6("w1_age"), "w2_age": r6("w2_age")})


@query(
    "followup_filter",
    f"""WITH {_VISIT_SQL} SELECT id, {sql6('w2_age - w1_age')} AS gap FROM v1 FULL JOIN v2 USING (id)
    WHERE w1_age IS NULL OR w2_age IS NULL OR w2_age - w1_age > 1.5""",
)
def followup_filter(spark, sf):
    v1, v2 = _visit_tables(spark, sf)
    kept = clean.long_enough_followup(v1.join(v2, "id", "full"), "w1_age", "w2_age")
    return kept.select("id", r6(F.col("w2_age") - F.col("w1_age")).alias("gap"))


_WIDE_SQL = """wide AS (
  SELECT o_custkey AS id, c_mktsegment AS segment, min(o_orderdate) AS d1, max(o_orderdate) AS d2,
         arg_min(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) AS price_1,
         arg_max(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) AS price_2
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
aged AS (SELECT *, (CAST(d1 AS DATE) - DATE '1937-06-01') / 365.25 AS age_1,
                (CAST(d2 AS DATE) - DATE '1937-06-01') / 365.25 AS age_2 FROM wide)"""


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_as_visits(spark, sf).join(
        table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), "o_orderkey"
    )
    both = visits.first_and_last(o, "id", ["o_orderdate", "o_orderkey"], ["age", "price"])
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return both.drop("n_visits").join(seg, "id")


@query(
    "visit_long",
    f"""WITH {_WIDE_SQL} SELECT id, segment, 1 AS timepoint, {sql6('age_1')} AS age, price_1 AS price FROM aged
    UNION ALL SELECT id, segment, 2, {sql6('age_2')}, price_2 FROM aged""",
)
def visit_long(spark, sf):
    return visits.to_long(_wide(spark, sf), "id", ["segment"]).withColumn("age", r6("age"))


@query(
    "annual_change",
    f"""WITH {_WIDE_SQL} SELECT id, {sql6('(price_2 - price_1) / nullif(age_2 - age_1, 0)', 4)} AS price_slope FROM aged""",
)
def annual_change(spark, sf):
    return visits.annual_changes(_wide(spark, sf), ["price"]).select("id", r6("price_slope", 4).alias("price_slope"))


@query(
    "time_since_first",
    f"""SELECT o_custkey AS id, o_orderkey, {sql6("(CAST(o_orderdate AS DATE) - CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE)) / 365.25")} AS time,
    {sql6("(CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) - DATE '1937-06-01') / 365.25")} AS age_1 FROM orders""",
)
def time_since_first(spark, sf):
    long = visits.since_first(_orders_as_visits(spark, sf))
    based = visits.with_baseline(long, "id", "age", "o_orderdate", "age_1")
    return based.select("id", "o_orderkey", r6("time").alias("time"), r6("age_1").alias("age_1"))


# --- comments, unions, samples ----------------------------------------------------

_COMMENTS_SQL = """c1 AS (SELECT conv_id, min(CASE WHEN conv_id % 4 = 0 THEN '' ELSE text END) AS a FROM conversations WHERE turn = 0 GROUP BY ALL),
c2 AS (SELECT conv_id, min(CASE WHEN conv_id % 3 = 0 THEN 'V' ELSE text END) AS b FROM conversations WHERE turn = 1 GROUP BY ALL)"""


@query(
    "comment_filter",
    f"""WITH {_COMMENTS_SQL} SELECT conv_id, a, b FROM c1 LEFT JOIN c2 USING (conv_id)
    WHERE NOT ((coalesce(a, '') IN ('', ' --', 'A', 'V') OR regexp_matches(coalesce(a, ''), '^È'))
               AND coalesce(b, '') IN ('', ' --', 'A', 'V'))""",
)
def comment_filter(spark, sf):
    talk = table(spark, sf, "conversations")

    def side(turn: int, every: int, blank: str, name: str) -> DataFrame:
        text = F.when(F.col("conv_id") % every == 0, blank).otherwise(F.col("text"))
        return talk.where(F.col("turn") == turn).groupBy("conv_id").agg(F.min(text).alias(name))

    merged = side(0, 4, "", "a").join(side(1, 3, "V", "b"), "conv_id", "left")
    return clean.comments_to_read(merged, "a", "b", boring_pattern="^È")


_TURNS_SQL = """t AS (SELECT conv_id, min(text) FILTER (turn % 2 = 0) AS even, min(text) FILTER (turn % 2 = 1) AS odd FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'ok' WHEN conv_id % 4 = 1 THEN NULL ELSE even END AS a, CASE conv_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'yes' ELSE odd END AS b FROM t)"""


@query(
    "comment_filter_second",
    f"""WITH {_TURNS_SQL} SELECT conv_id, a, b FROM c
    WHERE NOT (coalesce(a, '') IN ('', 'NA', 'ok', 'yes') AND coalesce(b, '') IN ('', 'NA', 'ok', 'yes'))""",
)
def comment_filter_second(spark, sf):
    """The second cohort's boilerplate, on the texts of all turns: one comment from the even ones, one from the odd ones."""
    talk, parity = table(spark, sf, "conversations"), F.col("turn") % 2
    both = talk.groupBy("conv_id").agg(F.min(F.when(parity == 0, F.col("text"))).alias("even"), F.min(F.when(parity == 1, F.col("text"))).alias("odd"))
    fourth, third = F.col("conv_id") % 4, F.col("conv_id") % 3
    rows = both.select(
        "conv_id", F.when(fourth == 0, "ok").when(fourth == 1, None).otherwise(F.col("even")).alias("a"),
        F.when(third == 0, "NA").when(third == 1, "yes").otherwise(F.col("odd")).alias("b"),
    )
    return clean.comments_to_read(rows, "a", "b", C.BOILERPLATE_COMMENTS_B, C.BOILERPLATE_COMMENTS_B)


@query(
    "cohort_union",
    """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS score,
       c_mktsegment AS segment, CAST(NULL AS INT) AS nation FROM customer
    UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_acctbal, NULL, s_nationkey FROM supplier""",
)
def cohort_union(spark, sf):
    a = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"),
        F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("score"),
        F.col("c_mktsegment").alias("segment"),
    )
    b = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("score"),
        F.col("s_nationkey").alias("nation"),
    )
    return clean.stack_cohorts(a, b)


@query(
    "first_non_null",
    """WITH src AS (SELECT s_nationkey AS nation, 0 AS src, s_suppkey AS k, CASE WHEN s_acctbal > 2000 THEN s_acctbal END AS v FROM supplier
      UNION ALL SELECT c_nationkey, 1, c_custkey, CASE WHEN c_acctbal > 2000 THEN c_acctbal END FROM customer),
    f AS (SELECT nation, arg_min(v, src * 1000000000000 + k) AS v FROM src WHERE v IS NOT NULL GROUP BY nation)
    SELECT n_nationkey AS nation, v FROM nation LEFT JOIN f ON nation = n_nationkey""",
)
def first_non_null(spark, sf):
    def source(name: str, p: str, key: str) -> DataFrame:
        return table(spark, sf, name).select(
            F.col(f"{p}_nationkey").alias("nation"), F.col(key).alias("k"),
            F.when(F.col(f"{p}_acctbal") > 2000, F.col(f"{p}_acctbal")).alias("v"),
        )

    found = clean.first_known_per_key(
        [source("supplier", "s", "s_suppkey"), source("customer", "c", "c_custkey")], "nation", "v", ["k"]
    )
    spine = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    return clean.on_spine(spine, found, "nation")


@query(
    "analysis_sample",
    """SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    AND c_custkey IN (SELECT user_id FROM events) AND c_acctbal IS NOT NULL
    AND c_custkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity IS NOT NULL)""",
)
def analysis_sample(spark, sf):
    def ids(name: str, key: str) -> DataFrame:
        return table(spark, sf, name).select(F.col(key).alias("id"))

    full = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_quantity")
    tables = [ids("customer", "c_custkey"), ids("orders", "o_custkey"), ids("events", "user_id")]
    return clean.common_subjects(tables, "id", full, ["l_quantity"])


@query(
    "pending_work",
    """SELECT c_custkey AS subject_id, s.ses FROM customer, (VALUES ('ses-01'), ('ses-02')) s(ses)
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND 'ses-0' || CAST(o_orderkey % 2 + 1 AS VARCHAR) = s.ses
                      AND o_orderstatus = 'F')""",
)
def pending_work(spark, sf):
    ses = F.concat(F.lit("ses-0"), (F.col("o_orderkey") % 2 + 1).cast("string"))
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject_id"), ses.alias("ses"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    listing = quality.work_list(people, ["ses-01", "ses-02"], done)
    return clean.pending(listing.select("subject_id", "ses"), done.distinct(), ["subject_id", "ses"])


@query(
    "work_list_counts",
    """WITH s AS (SELECT c_custkey, ses FROM customer, (VALUES ('ses-01'), ('ses-02')) s(ses)),
    h AS (SELECT DISTINCT o_custkey, 'ses-0' || CAST(o_orderkey % 2 + 1 AS VARCHAR) AS ses FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT s.ses, count(*) FILTER (h.o_custkey IS NOT NULL) AS n_present, count(*) FILTER (h.o_custkey IS NULL) AS n_missing
    FROM s LEFT JOIN h ON h.o_custkey = c_custkey AND h.ses = s.ses GROUP BY s.ses""",
)
def work_list_counts(spark, sf):
    ses = F.concat(F.lit("ses-0"), (F.col("o_orderkey") % 2 + 1).cast("string"))
    have = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("subject_id"), ses.alias("ses")
    )
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    listing = quality.work_list(people, ["ses-01", "ses-02"], have)
    return listing.groupBy("ses").agg(
        F.count_if("present").alias("n_present"), F.count_if(~F.col("present")).alias("n_missing")
    )


# --- norms and classification ---------------------------------------------------

TESTS = {"TMTB": "tmt_b_raw", "DS_B": "inverse_digits_raw", "SF": "sem_fluency_raw"}
_BANDS = ("60-64", "65–69", "70–80")


def _sheet_rows() -> list[tuple]:
    """A small normative table by rule: ranges move with the band, two rows overlap."""
    out = []
    for t, test in enumerate(TESTS):
        for b, band in enumerate(_BANDS):
            s = t + b
            texts = ("-", f"≤{4 + s}", f"{5 + s}–{12 + s}", f"{10 + s}–{20 + s}", f"{21 + s}",
                     f"{22 + s}–{35 + s}", "—", f"≥{36 + s}")
            out += [(test, band, k, text, float(2 + 2 * k)) for k, text in enumerate(texts)]
    return out


def _edu_rows() -> list[tuple]:
    return [
        (test, score, years, float(score + (2 if years < 10 else 0) - (years // 8) + t))
        for t, test in enumerate(TESTS) for score in range(3, 16) for years in (0, 6, 8, 10, 12, 16, 18)
    ]


_TESTEE_SQL = """who AS (
  SELECT p_partkey AS id, floor((p_partkey * 7) % 27 + 0.5) AS YoE, 58.0 + p_partkey % 26 + 0.5 * (p_partkey % 2) AS w1_age,
         60.0 + p_partkey % 26 AS w2_age,
         CAST(p_size AS DOUBLE) AS w1_tmt_b_raw, CAST((p_size * 3) % 50 + 1 AS DOUBLE) AS w2_tmt_b_raw,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST((p_size * 7) % 50 + 1 AS DOUBLE) END AS w1_inverse_digits_raw,
         CAST((p_size * 11) % 50 + 1 AS DOUBLE) AS w2_inverse_digits_raw,
         CAST((p_size * 13) % 50 + 1 AS DOUBLE) AS w1_sem_fluency_raw,
         CASE WHEN p_partkey % 19 <> 0 THEN CAST((p_size * 17) % 50 + 1 AS DOUBLE) END AS w2_sem_fluency_raw,
         CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_partkey % 16 AS DOUBLE) END AS w1_delayed_recall_raw,
         CAST(p_partkey % 14 + 2 AS DOUBLE) AS w2_delayed_recall_raw
  FROM part)"""


def _testees(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")

    def score(k: int):
        return ((size * k) % 50 + 1).cast("double")

    return table(spark, sf, "part").select(
        key.alias("id"), C.whole_down((key * 7) % 27 + 0.5).cast("double").alias("YoE"),
        (F.lit(58.0) + key % 26 + 0.5 * (key % 2)).alias("w1_age"), (F.lit(60.0) + key % 26).alias("w2_age"),
        size.cast("double").alias("w1_tmt_b_raw"), score(3).alias("w2_tmt_b_raw"),
        F.when(key % 17 != 0, score(7)).alias("w1_inverse_digits_raw"), score(11).alias("w2_inverse_digits_raw"),
        score(13).alias("w1_sem_fluency_raw"), F.when(key % 19 != 0, score(17)).alias("w2_sem_fluency_raw"),
        F.when(key % 23 != 0, (key % 16).cast("double")).alias("w1_delayed_recall_raw"),
        (key % 14 + 2).cast("double").alias("w2_delayed_recall_raw"),
    )


def _values(rows: list[tuple]) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


_NORM_SQL = f"""sheets(test, band, row_no, raw_text, scaled) AS (VALUES {_values(_sheet_rows())}),
na AS (
  SELECT test, CAST(split_part(replace(band, '–', '-'), '-', 1) AS INT) AS a0, CAST(split_part(replace(band, '–', '-'), '-', 2) AS INT) AS a1,
         row_no, CAST(scaled AS DOUBLE) AS scaled,
         CASE WHEN raw_text LIKE '≥%' THEN CAST(substr(raw_text, 2) AS INT) WHEN raw_text LIKE '≤%' THEN NULL
              WHEN raw_text LIKE '%–%' THEN CAST(split_part(raw_text, '–', 1) AS INT) ELSE CAST(raw_text AS INT) END AS lo,
         CASE WHEN raw_text LIKE '≤%' THEN CAST(substr(raw_text, 2) AS INT) WHEN raw_text LIKE '≥%' THEN NULL
              WHEN raw_text LIKE '%–%' THEN CAST(split_part(raw_text, '–', 2) AS INT) ELSE CAST(raw_text AS INT) END AS hi
  FROM sheets WHERE raw_text NOT IN ('-', '—')),
ne(test, age_scaled, yoe, scaled) AS (VALUES {_values(_edu_rows())})"""


def _scores_sql() -> str:
    """The six two-step lookups as SQL."""
    parts, joins = [], []
    for visit in ("w1", "w2"):
        for test, stem in TESTS.items():
            name = f"{visit}_{test.lower()}_norm"
            parts.append(f"""{name}_a AS (
  SELECT id, YoE, (SELECT arg_min(n.scaled, n.row_no) FROM na n WHERE n.test = '{test}'
      AND least(greatest(round_even({visit}_age, 0), 60), 80) BETWEEN n.a0 AND n.a1
      AND (n.lo IS NULL OR {visit}_{stem} >= n.lo) AND (n.hi IS NULL OR {visit}_{stem} <= n.hi)
      AND {visit}_{stem} IS NOT NULL) AS s FROM who),
{name} AS (
  SELECT id, s AS {name}_age, (SELECT CAST(arg_max(n.scaled, n.yoe) AS DOUBLE) FROM ne n WHERE n.test = '{test}'
      AND n.age_scaled = least(greatest(CAST(s AS INT), 3), 15) AND s IS NOT NULL
      AND n.yoe <= least(greatest(least({name}_a.YoE, 20), 0), 18)) AS {name} FROM {name}_a)""")
            joins.append(name)
    cols = ", ".join(f"{n}_age, {n}" for n in joins)
    return (
        ", ".join(parts) + f", scored AS (SELECT who.*, {cols} FROM who "
        + " ".join(f"JOIN {n} USING (id)" for n in joins) + ")"
    )


_SCORED_SQL = f"{_NORM_SQL}, {_TESTEE_SQL}, {_scores_sql()}"


def _flag_sql(visit: str) -> str:
    n = [f"{visit}_{t.lower()}_norm" for t in TESTS]
    known = " AND ".join(f"{c} IS NOT NULL" for c in [f"{visit}_delayed_recall_raw", *n])
    ok = " AND ".join(f"{c} >= 7" for c in n)
    return f"CASE WHEN {known} THEN CAST({visit}_delayed_recall_raw >= 12 AND {ok} AS INT) END"


_FLAGS_SQL = f"""{_SCORED_SQL}, flags AS (SELECT *, {_flag_sql('w1')} AS flag_1, {_flag_sql('w2')} AS flag_2 FROM scored),
final AS (SELECT *, CASE WHEN flag_1 IS NOT NULL AND flag_2 IS NOT NULL THEN CAST(flag_1 = 1 AND flag_2 = 1 AS INT) END AS flag_long FROM flags)"""


def _norm_tables(spark: SparkSession) -> tuple[norms.AgeNorms, norms.EducationNorms]:
    sheets = spark.createDataFrame(_sheet_rows(), "test string, band string, row_no int, raw_text string, scaled double")
    edu = spark.createDataFrame(_edu_rows(), "test string, age_scaled int, yoe int, scaled double")
    return norms.AgeNorms(norms.tidy_age_norms(sheets)), norms.EducationNorms(edu)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    age_norms, edu = _norm_tables(spark)
    out = _testees(spark, sf)
    for visit in ("w1", "w2"):
        out = norms.score_visit(out, age_norms, edu, TESTS, visit)
    return out


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    out = _scored(spark, sf)
    for k, visit in ((1, "w1"), (2, "w2")):
        memory = C.at_least_flag(f"{visit}_delayed_recall_raw", 12)
        out = out.withColumn(f"flag_{k}", C.visit_flag(memory, [f"{visit}_{t.lower()}_norm" for t in TESTS]))
    return out.withColumn("flag_long", C.both_visits_flag("flag_1", "flag_2"))


_NORM_COLUMNS = [f"{v}_{t.lower()}_norm{s}" for v in ("w1", "w2") for t in TESTS for s in ("_age", "")]


@query("norm_lookup", f"WITH {_SCORED_SQL} SELECT id, {', '.join(_NORM_COLUMNS)} FROM scored")
def norm_lookup(spark, sf):
    return _scored(spark, sf).select("id", *_NORM_COLUMNS)


@query("classify_flags", f"WITH {_FLAGS_SQL} SELECT id, flag_1, flag_2, flag_long FROM final")
def classify_flags(spark, sf):
    return _flagged(spark, sf).select("id", "flag_1", "flag_2", "flag_long")


@query("transition_counts", f"WITH {_FLAGS_SQL} SELECT flag_1, flag_2, flag_long, count(*) AS n FROM final GROUP BY ALL")
def transition_counts(spark, sf):
    return _flagged(spark, sf).groupBy("flag_1", "flag_2", "flag_long").agg(F.count(F.lit(1)).alias("n"))


_PCT_SQL = ", ".join(
    f"count({f}) AS n_{f}, sum({f})::BIGINT AS pos_{f}, {sql6(f'sum({f}) * 100.0 / nullif(count({f}), 0)')} AS pct_{f}"
    for f in ("flag_1", "flag_2", "flag_long")
)


@query("classification_funnel", f"WITH {_FLAGS_SQL} SELECT {_PCT_SQL} FROM final")
def classification_funnel(spark, sf):
    cells = []
    for f in ("flag_1", "flag_2", "flag_long"):
        cells += [
            F.count(f).alias(f"n_{f}"), F.sum(f).alias(f"pos_{f}"),
            r6(C.percent(F.sum(f), F.count(f))).alias(f"pct_{f}"),
        ]
    return _flagged(spark, sf).agg(*cells)


@query("score_frequencies", f"WITH {_SCORED_SQL} SELECT w1_tmtb_norm AS score, count(*) AS n FROM scored WHERE w1_tmtb_norm IS NOT NULL GROUP BY ALL")
def score_frequencies(spark, sf):
    return value_counts(_scored(spark, sf).withColumnRenamed("w1_tmtb_norm", "score"), "score")


# --- motion and eligibility ---------------------------------------------------------

_MOTION_SQL = """frames AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, 'ses-0' || CAST(event_id % 2 + 1 AS VARCHAR) AS ses,
         CASE WHEN event_id % 17 <> 0 THEN value / 120 END AS fd, event_type, event_id FROM events),
motion AS (
  SELECT subject_id, ses, count(*) AS n_frames, avg(fd) AS mean_fd, avg(CASE WHEN fd > 0.5 THEN 1 ELSE 0 END) * 100 AS pct_high,
         max(CASE WHEN fd > 0.5 THEN 1 ELSE 0 END) = 1 AS needs_scrubbing,
         avg(CASE WHEN fd > 0.5 THEN 1 ELSE 0 END) * 100 > 30 AS exclude_motion FROM frames GROUP BY ALL)"""


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        F.concat(F.lit("ses-0"), (F.col("event_id") % 2 + 1).cast("string")).alias("ses"),
        F.when(F.col("event_id") % 17 != 0, F.col("value") / 120).alias("fd"),
        "event_type", "event_id", "props",
    )


@query(
    "motion_filter",
    f"""WITH {_MOTION_SQL} SELECT subject_id, ses, n_frames, {sql6('mean_fd')} AS mean_fd, {sql6('pct_high')} AS pct_high,
    needs_scrubbing, exclude_motion FROM motion""",
)
def motion_filter(spark, sf):
    return quality.motion_summary(_frames(spark, sf), ["subject_id", "ses"]).withColumns(
        {"mean_fd": r6("mean_fd"), "pct_high": r6("pct_high")}
    )


_SOURCE_SQL = """cand AS (
  SELECT DISTINCT subject_id, ses, CASE WHEN event_type = 'click' THEN 'scrubbed' ELSE 'original' END AS kind,
         subject_id || '_' || ses || '_' || event_type AS path FROM frames WHERE event_type IN ('click', 'view') AND event_id % 5 < 2),
cnt AS (SELECT subject_id, ses, count(*) FILTER (kind = 'scrubbed') AS ns, count(*) FILTER (kind = 'original') AS no,
               min(path) FILTER (kind = 'scrubbed') AS ps, min(path) FILTER (kind = 'original') AS po FROM cand GROUP BY ALL),
chosen AS (
  SELECT subject_id, ses, needs_scrubbing,
         CASE WHEN coalesce(ns, 0) = 0 AND coalesce(no, 0) = 0 THEN 'no source'
              WHEN needs_scrubbing AND coalesce(ns, 0) <> 1 THEN 'not exactly one scrubbed source'
              WHEN NOT needs_scrubbing AND coalesce(no, 0) = 0 THEN 'no original source' END AS reject_reason, ps, po
  FROM motion LEFT JOIN cnt USING (subject_id, ses))"""


def _choice(spark: SparkSession, sf: str) -> DataFrame:
    frames = _frames(spark, sf)
    cand = frames.where("event_type IN ('click', 'view') AND event_id % 5 < 2").select(
        "subject_id", "ses", F.when(F.col("event_type") == "click", "scrubbed").otherwise("original").alias("kind"),
        F.concat_ws("_", "subject_id", "ses", "event_type").alias("path"),
    ).distinct()
    need = quality.motion_summary(frames, ["subject_id", "ses"])
    return quality.choose_source(cand, need, ["subject_id", "ses"])


@query(
    "source_choice",
    f"""WITH {_MOTION_SQL}, {_SOURCE_SQL} SELECT subject_id, ses, needs_scrubbing,
    CASE WHEN reject_reason IS NULL THEN CASE WHEN needs_scrubbing THEN ps ELSE po END END AS chosen_path, reject_reason FROM chosen""",
)
def source_choice(spark, sf):
    return _choice(spark, sf)


@query(
    "eligibility_funnel",
    f"""WITH {_MOTION_SQL}, {_SOURCE_SQL}, r AS (
      SELECT CASE WHEN TRY_CAST(subject_id AS BIGINT) IS NULL THEN 'no numeric id' WHEN m.mean_fd IS NULL THEN 'no displacement'
                  WHEN m.exclude_motion THEN 'motion' WHEN c.reject_reason IS NOT NULL THEN 'source: ' || c.reject_reason
                  ELSE 'eligible' END AS reason
      FROM motion m LEFT JOIN chosen c USING (subject_id, ses))
    SELECT reason, count(*) AS n FROM r GROUP BY reason""",
)
def eligibility_funnel(spark, sf):
    motion = quality.motion_summary(_frames(spark, sf), ["subject_id", "ses"])
    choice = _choice(spark, sf).select("subject_id", "ses", "reject_reason")
    joined = motion.join(choice, ["subject_id", "ses"], "left")
    # the source step carries its own detail, so it is appended to the reason
    rules = [
        ("no numeric id", C.subject_number("subject_id").isNull()),
        ("no displacement", F.col("mean_fd").isNull()),
        ("motion", F.col("exclude_motion")),
        ("source", F.col("reject_reason").isNotNull()),
    ]
    return quality.funnel(joined, rules, details={"source": F.col("reject_reason")})


@query(
    "motion_table",
    f"""WITH f AS (SELECT user_id % 2 AS grp, CASE WHEN event_id % 17 <> 0 THEN value / 120 END AS fd,
                   CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT CASE WHEN grouping(grp) = 1 THEN 'Whole cohort' ELSE CAST(grp AS VARCHAR) END AS grp, count(*) AS n,
           {sql6('avg(fd)')} AS mean_fd, {sql6('avg(k / 100 * 100)')} AS pct_scrubbed, {sql6('stddev_samp(fd)')} AS sd_fd
    FROM f GROUP BY GROUPING SETS ((), (grp))""",
)
def motion_table(spark, sf):
    from neurospan.operators.groupstats import grouped_with_total
    from neurospan.sources.scans import json_fields

    rows = json_fields(table(spark, sf, "events"), "props", {"k": "double"}).select(
        (F.col("user_id") % 2).cast("string").alias("grp"),
        F.when(F.col("event_id") % 17 != 0, F.col("value") / 120).alias("fd"),
        C.percent(F.col("k"), F.lit(100)).alias("pct"),
    )
    return grouped_with_total(rows, "grp", [
        F.count(F.lit(1)).alias("n"), r6(F.avg("fd")).alias("mean_fd"), r6(F.avg("pct")).alias("pct_scrubbed"),
        r6(F.stddev_samp("fd")).alias("sd_fd"),
    ])


# --- table checks --------------------------------------------------------------


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings with short, empty and non-finite rows mixed in by row id."""
    kind = F.col("vec_id") % 10
    signal = F.col("embedding").cast("array<double>")
    bad = F.transform(signal, lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("subject_id"), F.lit("ses-01").alias("ses"), F.col("vec_id").alias("frame"),
        F.when(kind == 3, F.slice(signal, 1, 63)).when(kind == 5, bad)
        .when(kind == 7, F.array().cast("array<double>")).otherwise(signal).alias("signal"),
    )


@query(
    "quarantine_split",
    """SELECT CAST(label AS VARCHAR) AS subject_id, 'signal' AS stage,
    CASE vec_id % 10 WHEN 3 THEN 'wrong_width' WHEN 5 THEN 'not_finite' ELSE 'empty' END AS reason, count(*) AS n
    FROM embeddings WHERE vec_id % 10 IN (3, 5, 7) GROUP BY ALL""",
)
def quarantine_split(spark, sf):
    _, rejected = quality.split_valid(_damaged(spark, sf), quality.signal_rules(64), "signal")
    return rejected.groupBy("subject_id", "stage", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quarantine_valid",
    """SELECT CAST(label AS VARCHAR) AS subject_id, count(*) AS n_frames FROM embeddings WHERE vec_id % 10 NOT IN (3, 5, 7) GROUP BY ALL""",
)
def quarantine_valid(spark, sf):
    valid, _ = quality.split_valid(_damaged(spark, sf), quality.signal_rules(64), "signal")
    return valid.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_frames"))


@query(
    "label_agreement",
    """WITH u AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS s, count(DISTINCT event_type) AS n
      FROM events GROUP BY user_id)
    SELECT count(*) AS n_keys, count(DISTINCT s) AS n_distinct_sets, min(n) AS min_rois, max(n) AS max_rois FROM u""",
)
def label_agreement(spark, sf):
    seen = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return quality.label_agreement(seen, ["user_id"], "event_type")


@query(
    "square_check",
    """WITH e AS (SELECT l_suppkey % 7 AS k, l_linenumber AS i, CAST(l_partkey % 6 + 1 AS INT) AS j FROM lineitem),
    s AS (SELECT k, i AS label, 1 AS r, 0 AS c FROM e UNION ALL SELECT k, j, 0, 1 FROM e),
    m AS (SELECT k, label, max(r) AS r, max(c) AS c FROM s GROUP BY ALL)
    SELECT k, sum(r)::BIGINT AS n_rows, sum(c)::BIGINT AS n_cols, count(*) FILTER (r <> c) = 0 AS labels_agree FROM m GROUP BY k""",
)
def square_check(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("k"), F.col("l_linenumber").alias("i"),
        (F.col("l_partkey") % 6 + 1).cast("int").alias("j"),
    )
    return quality.square_check(edges, ["k"])


@query(
    "label_layout",
    f"""WITH k AS (SELECT DISTINCT unnest(range(1, len(embedding) + 1)) AS idx FROM embeddings),
    named AS (SELECT idx, {I.region_name_sql('(idx - 1)')} AS roi FROM k),
    sided AS (SELECT *, CASE WHEN roi LIKE '%~_LH~_%' ESCAPE '~' OR roi LIKE '%: Left %' THEN 'LH' ELSE 'RH' END AS side,
      CASE WHEN idx <= 28 OR idx BETWEEN 57 AND 60 THEN 'LH' ELSE 'RH' END AS expected FROM named)
    SELECT count(*) = 64 AS count_ok, min(idx) = 1 AND max(idx) = count(DISTINCT idx) AS numbering_ok,
      count(*) FILTER ((roi LIKE 'Subcortical%') <> (idx > 56)) = 0 AS blocks_ok, count(*) FILTER (side <> expected) = 0 AS sides_ok FROM sided""",
)
def label_layout(spark, sf):
    """The derived labels alternate sides, so the hemisphere-block check must fail."""
    labels = I.regions(spark, sf).select(
        (F.col("roi") + 1).alias("roi_idx"), I.region_name(F.col("roi")).alias("roi")
    )
    return quality.label_layout(labels, 56, 8)


@query(
    "name_map_audit",
    """SELECT DISTINCT p_type AS name, CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'SMALL' THEN 'Little' WHEN 'LARGE' THEN 'Big' END AS target,
    CASE WHEN p_type NOT IN ('PROMO', 'SMALL', 'LARGE') THEN 'unmatched' WHEN p_type = 'LARGE' THEN 'invalid target' ELSE 'ok' END AS status
    FROM part""",
)
def name_map_audit(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_type").alias("name"))
    mapping = {"promo": "Promotion", "small": "Little", "large": "Big"}
    return quality.name_map_audit(names, mapping, ["Promotion", "Little"])
