"""Table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, unread columns and rows left to the scan's pruning."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python need not have it on its path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skeinwork-"), "skeinwork.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)  # Spark's own file server hands it out
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (tests, one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='skeinwork-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage durably: a lost executor costs only its running tasks, and the written table's
    size is known to the planner, so that a join with it is broadcast only within Spark's threshold.
    """
    return reread(df.sparkSession, write_shared(df, label))


def write_shared(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return path


def reread(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete one table written by ``write_shared``; nothing lazy may still read it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                drop_shared(spark, path)
        except Exception:
            pass
