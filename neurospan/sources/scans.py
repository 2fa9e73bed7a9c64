"""Scans: typed CSV, sheet folders, headerless matrices, path keys, JSON side files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.functions import columns as C

PATH = "_path"


def with_path(df: DataFrame) -> DataFrame:
    """Expose the hidden file path (and split start) before any projection drops it."""
    return df.withColumns({PATH: F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})


def path_keys(path: Column | str = PATH, subject_pattern: str = r"(sub-[A-Za-z0-9]+)",
              ses_pattern: str = r"(ses-[0-9]+)") -> tuple[Column, Column]:
    """(subject_id, ses) from a file path."""
    p = C.as_col(path)
    return C.subject_key(F.regexp_extract(p, subject_pattern, 1)), F.regexp_extract(p, ses_pattern, 1)


def typed_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
              text: Sequence[str] = (), header: bool = True) -> DataFrame:
    """CSV with an explicit schema; columns in ``text`` are forced to string.

    Malformed values become NULL instead of failing the scan.
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fixed = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in want])
    return spark.read.schema(fixed).option("mode", "PERMISSIVE").csv(path, header=header)


def sheet_tables(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """One ``<sheet>.csv`` per sheet (a file, or a folder of part files) -> one table with a ``sheet`` column."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(?:/[^/]+)?$", 1)
    return typed_csv(spark, f"{folder}/*.csv", schema).withColumn("sheet", F.url_decode(name))


def matrix_text(spark: SparkSession, path: str | Sequence[str], separator: str = ",") -> DataFrame:
    """Headerless numeric matrices, one file per subject-session, as (subject_id, ses, frame, signal).

    Files split freely: no file is read whole.  ``frame`` increases with the
    line position inside a file but need not be consecutive.  Unreadable numbers
    become NULL for the quality rules to catch.
    """
    lines = with_path(spark.read.text(path)).where(F.trim("value") != "")
    subject, ses = path_keys()
    numbers = F.transform(F.split("value", separator), lambda v: F.trim(v).try_cast("double"))
    return lines.select(
        subject.alias("subject_id"), ses.alias("ses"),
        F.monotonically_increasing_id().alias("frame"), numbers.alias("signal"),
    )


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated list file -> (item)."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("item")).where("item <> ''")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder with their (subject_id, ses); no file content is read."""
    subject, ses = path_keys("path")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length").select("path", "length", subject.alias("subject_id"), ses.alias("ses"))
    )


def json_fields(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """Typed fields of a JSON text column; unreadable documents give NULLs."""
    schema = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])
    return df.withColumn("_j", F.from_json(column, schema)).select("*", "_j.*").drop("_j")


def json_documents(df: DataFrame, path: str, text: str, fields: Mapping[str, str]) -> DataFrame:
    """JSON side files packed as (path, text) rows of a table, keyed by the path as loose files are.

    A file of its own costs a listing, an opening and a rename on the driver, which is more than reading a few bytes; trees
    of many side files are therefore kept packed.  Unreadable documents give NULLs.
    """
    subject, ses = path_keys(path)
    keyed = df.select(subject.alias("subject_id"), ses.alias("ses"), F.col(text).alias("_text"))
    return json_fields(keyed, "_text", fields).drop("_text")


def json_side_files(spark: SparkSession, path: str, fields: Mapping[str, str]) -> DataFrame:
    """JSON documents, one per file, keyed by the file path."""
    schema = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])
    raw = with_path(spark.read.schema(schema).option("multiLine", "true").json(path))
    subject, ses = path_keys()
    return raw.select(subject.alias("subject_id"), ses.alias("ses"), *fields)
