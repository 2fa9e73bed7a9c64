"""Raw score -> age-band score -> education score, from normative tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.functions import columns as C
from neurospan.operators.ordered import latest_known
from neurospan.session import scratch_dir
from neurospan.sources.sinks import materialise

MAX_YEARS = 20  # fixed value: education columns stop here


def tidy_age_norms(sheets: DataFrame) -> DataFrame:
    """(test, band, row_no, raw_text, scaled) -> parsed bounds; rows without a score drop.

    ``band`` is the sheet name, ``60-65`` with a hyphen or an en dash.  ``band_no`` is the sheet's place in the workbook;
    a table without that column takes its sheets by age.
    """
    place = F.col("band_no") if "band_no" in sheets.columns else F.get(F.split("band", "[–-]"), F.lit(0)).try_cast("int")
    sheets = sheets.withColumn("_place", place)
    ends = F.split("band", "[–-]")
    return (
        sheets.select(
            "test", F.get(ends, F.lit(0)).try_cast("int").alias("age_lo"),
            F.get(ends, F.lit(1)).try_cast("int").alias("age_hi"),
            F.col("_place").alias("band_no"), "row_no", C.range_bounds("raw_text").alias("b"), "scaled",
        )
        .where("age_lo IS NOT NULL AND age_hi IS NOT NULL AND b IS NOT NULL")
        .select("test", "age_lo", "age_hi", "band_no", "row_no", "b.lo", "b.hi", "scaled")
    )


# Both lookups are equi-joins.  Bands and ranges are cut to integer cells, so a subject's cell meets the few rows that can
# hold it, and the cost of a lookup does not follow the length of the sheet.  Spark copies the cells to the tasks while
# their size allows it, else it shuffles both sides.


class AgeNorms:
    """Cells (test, age, score) of an age-norm table, each with the sheet rows that reach into it, in sheet order."""

    def __init__(self, norms: DataFrame):
        ends = norms.groupBy("test").agg(
            F.floor(F.min(F.least("lo", "hi"))).alias("first"), F.floor(F.max(F.greatest("lo", "hi"))).alias("last"),
            F.min("age_lo").alias("age_lo"), F.max("age_hi").alias("age_hi"),
        ).collect()  # one row per test of a printed table
        self.ends = {r["test"]: (r["first"], r["last"]) for r in ends if r["first"] is not None}
        ages = [(r["age_lo"], r["age_hi"]) for r in ends]
        self.ages = (min(a for a, _ in ages), max(b for _, b in ages)) if ages else (0, 0)
        # one cell below and one above all bounds stand for everything further out
        below = F.lit(None).cast("bigint")
        above = F.lit(None).cast("bigint")
        for test, (first, last) in self.ends.items():
            below = F.when(F.col("test") == test, first - 1).otherwise(below)
            above = F.when(F.col("test") == test, last + 1).otherwise(above)
        reach = F.sequence(F.coalesce(F.floor("lo"), below), F.coalesce(F.floor("hi"), above))
        cells = norms.where((below.isNotNull()) & (F.col("age_lo") <= F.col("age_hi"))).where("lo is null or hi is null or lo <= hi")
        cells = cells.withColumn("cell", F.explode(reach)).withColumn("age", F.explode(F.sequence("age_lo", "age_hi")))
        row = F.struct("band_no", "row_no", "lo", "hi", F.col("scaled").cast("double").alias("scaled"))
        cells = cells.groupBy("test", "age", "cell").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        self.cells = materialise(cells, scratch_dir(norms.sparkSession, "age-norms"))  # every lookup reads it


class EducationNorms:
    """Score x years grid of one education table, filled for every whole year by the last listed column."""

    def __init__(self, norms: DataFrame):
        ends = norms.groupBy("test").agg(
            F.min("age_scaled").alias("lo"), F.max("age_scaled").alias("hi"), F.min("yoe").alias("first"), F.max("yoe").alias("last")
        )
        self.ends = {r["test"]: (r["lo"], r["hi"], r["first"], r["last"]) for r in ends.collect()}  # as above
        years = ends.select("test", F.explode(F.sequence("first", "last")).alias("year"))
        listed = norms.select("test", "yoe").distinct()
        columns = latest_known(years, listed, ["test"], "year", "yoe", "yoe", "column")
        twice = F.raise_error(F.concat_ws(" ", F.lit("two scores for"), "test", "age_scaled", "yoe"))
        grid = norms.groupBy("test", "age_scaled", "yoe").agg(
            F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max(F.col("scaled").cast("double"))).alias("scaled")
        )
        own = columns.select(F.col("test").alias("of"), "year", "column")
        grid = grid.join(own, (F.col("test") == F.col("of")) & (F.col("yoe") == F.col("column"))).select("test", "age_scaled", "year", "scaled")
        self.grid = materialise(grid, scratch_dir(norms.sparkSession, "education-norms"))


def by_age(df: DataFrame, norms: AgeNorms, raw: str, age: str, test: str, out: str) -> DataFrame:
    """Age-adjusted score: first sheet row whose range holds the raw score.

    Ages round half to even and clamp to the supported span; NULL when nothing matches.
    """
    first, last = norms.ends.get(test, (0, 0))
    whole = C.clamp(C.round_half_even(age).cast("int"), *[F.lit(x) for x in norms.ages])
    cell = C.clamp(F.floor(raw), F.lit(first - 1), F.lit(last + 1)).cast("bigint")
    cells = norms.cells.where(F.col("test") == test).select(F.col("age").alias("_in_age"), F.col("cell").alias("_in_cell"), F.col("rows").alias("_rows"))
    met = df.withColumns({"_age": whole, "_cell": cell}).join(cells, (F.col("_age") == F.col("_in_age")) & (F.col("_cell") == F.col("_in_cell")), "left")
    hit = F.filter("_rows", lambda r: C.in_bounds(F.col(raw), r["lo"], r["hi"]))
    return met.withColumn(out, F.get(hit, F.lit(0))["scaled"]).drop("_age", "_cell", "_in_age", "_in_cell", "_rows")


def by_education(df: DataFrame, norms: EducationNorms, scaled: str, years: str, test: str, out: str,
                 max_years: int = MAX_YEARS) -> DataFrame:
    """Education-adjusted score: clamped row, then the greatest listed year not above the subject's."""
    if test not in norms.ends:
        return df.withColumn(out, F.lit(None).cast("double"))
    lo, hi, first, last = norms.ends[test]
    capped = F.when(F.col(years).isNotNull(), F.least(F.floor(years).cast("int"), F.lit(max_years)))
    wanted = C.clamp(capped, F.lit(first), F.lit(last))
    row = C.clamp(F.col(scaled).cast("int"), F.lit(lo), F.lit(hi))
    grid = norms.grid.where(F.col("test") == test).select(
        F.col("age_scaled").alias("_in_row"), F.col("year").alias("_in_year"), F.col("scaled").alias(out)
    )
    met = df.withColumns({"_row": row, "_year": wanted}).join(grid, (F.col("_row") == F.col("_in_row")) & (F.col("_year") == F.col("_in_year")), "left")
    return met.drop("_row", "_year", "_in_row", "_in_year")


def score_visit(df: DataFrame, age_norms: AgeNorms, edu_norms: EducationNorms, tests: Mapping[str, str], visit: str,
                years: str = "YoE") -> DataFrame:
    """Both lookups for every test of one visit: ``tests`` maps test -> raw column stem."""
    out = df
    for test, stem in tests.items():
        name = f"{visit}_{test.lower()}_norm"
        out = by_age(out, age_norms, f"{visit}_{stem}", f"{visit}_age", test, f"{name}_age")
        out = by_education(out, edu_norms, f"{name}_age", years, test, name)
    return out
