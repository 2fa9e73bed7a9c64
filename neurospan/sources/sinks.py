"""Sinks: tables, exports, keyed result tables, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Rows that a bucket of a new result table should hold.
ROWS_PER_BUCKET = 1_000_000


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """CSV for people; ``order`` names the row-number column that fixes the line order.

    A report is a few hundred rows, so it may be sorted into one file; the sort
    is a range sort and the writer keeps its order.
    """
    out = df.orderBy(order) if order else df
    out.write.mode("overwrite").csv(path, header=True)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: later uses share the stored result and its short lineage."""
    spark = df.sparkSession
    save(df, path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before the first write."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # the folder exists but holds no data files yet
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def input_key(spark: SparkSession, inputs: Sequence[str], settings: Mapping[str, object]) -> str:
    """Identifies a result by its input files (path, size and time of change) and its settings; no file is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for path in inputs:
        place = jvm.org.apache.hadoop.fs.Path(path)
        listed = place.getFileSystem(conf).listFiles(place, True)
        while listed.hasNext():
            f = listed.next()
            files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    text = "\n".join([*sorted(files), *(f"{k}={settings[k]!r}" for k in sorted(settings))])
    return hashlib.sha256(text.encode()).hexdigest()


def load_or_compute(spark: SparkSession, folder: str, inputs: Sequence[str], settings: Mapping[str, object],
                    compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of these inputs and settings, or ``compute()``, stored for the next call.

    A result counts as stored once its write has succeeded as a whole; one that was broken off is written again.
    Results of changed inputs or settings lie beside the old ones.
    """
    place = f"{folder.rstrip('/')}/{input_key(spark, inputs, settings)}"
    if not exists(spark, f"{place}/_SUCCESS"):
        save(compute(), place)
    return spark.read.parquet(place)


# A result table is a folder; when its bucketing changes, the rows go to a folder beside it, and a small file names the
# version in use.  A version is complete before it is named, so a writer that dies leaves the version before it in use.


def _layout(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(version, buckets) of a result table, or None before its first write."""
    place = f"{path.rstrip('/')}/_layout"  # readers skip names that begin with an underscore
    if not exists(spark, place):
        return None
    rows = [r[0].split() for r in spark.read.schema("value string").text(place).collect()]  # one row per version
    return max((int(v), int(b)) for v, b in rows)


def _name_version(spark: SparkSession, path: str, version: int, buckets: int) -> None:
    spark.createDataFrame([(f"{version} {buckets}",)], "value string").coalesce(1).write.mode("append").text(f"{path.rstrip('/')}/_layout")


def data_folder(spark: SparkSession, path: str) -> str:
    """Where the rows of a result table lie."""
    layout = _layout(spark, path)
    return _folder(path, layout[0] if layout else 1)


def _folder(path: str, version: int) -> str:
    return path if version == 1 else f"{path.rstrip('/')}-v{version}"


def table_buckets(new: DataFrame, path: str, wanted: int | None = None) -> int:
    """Bucket count of a result table, for a new one ``wanted`` (by default from its first rows)."""
    layout = _layout(new.sparkSession, path)
    if layout:
        return layout[1]
    count = wanted or max(8, -(-new.count() // ROWS_PER_BUCKET))
    _name_version(new.sparkSession, path, 1, count)
    return count


def grow_buckets(spark: SparkSession, path: str, keys: Sequence[str], bucket: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Write the table again with enough buckets, once they hold more than twice their rows on average.

    Counting reads file footers.  Every rewriting at least doubles the buckets, so a row is written a bounded number of
    times on average, however the table has grown.
    """
    version, buckets = _layout(spark, path)
    table = spark.read.parquet(data_folder(spark, path))
    wanted = -(-table.count() // rows_per_bucket)
    if wanted <= 2 * buckets:
        return
    wanted = 2 * max(wanted, buckets)
    spread = F.pmod(F.xxhash64(*[c for c in table.columns if c != bucket]), F.lit(4))
    dealt = table.withColumn(bucket, bucket_of(keys, wanted))
    dealt.repartition(F.col(bucket), spread).write.mode("overwrite").partitionBy(bucket).parquet(_folder(path, version + 1))
    _name_version(spark, path, version + 1, wanted)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def run_fingerprint(data: DataFrame, settings: Mapping[str, object]) -> str:
    """Hash of the data's rows (in any order) and the settings: identifies a resumable run."""
    from neurospan.functions.aggregates import set_hash

    row = F.to_json(F.struct(*[F.col(c) for c in sorted(data.columns)]))
    text = ";".join(f"{k}={settings[k]!r}" for k in sorted(settings))
    return data.agg(F.sha2(F.concat_ws("|", set_hash(row), F.lit(text)), 256)).first()[0]
