"""Session helpers: table loading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_notelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="notelake-")) / "notelake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._notelake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and Spark runs on this machine alone (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="notelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Tables that written() has made in this process.
_tables: list[str] = []


def clear(spark: SparkSession) -> None:
    """Remove the tables that written() has made so far; DataFrames built on them can't be read any more."""
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back: cuts the lineage and keeps the columns prunable.

    by: a column of few values to lay the table out by, so that readers of one value read nothing else.
    """
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/notelake-{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
