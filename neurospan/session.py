"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "neurospan", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators are tuned for.

    On a cluster leave ``spark.sql.shuffle.partitions`` high (about 3x the
    cores) and let AQE coalesce; skew joins are split by AQE.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs more than planning for expression-heavy queries
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it, whatever folder the session started in.

    The driver's own file server hands the archive out.  With ``spark-submit --py-files`` (or an installed wheel) on
    every node this is not needed.
    """
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="neurospan-package-")) / "neurospan.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))


def _scratch_root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path every executor can reach: below ``spark.checkpoint.dir``, else beside the session's tables."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch folders; results that still read them must have been used."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str):
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
