"""Shared folder for intermediate tables: lineage is cut by writing, never by local checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below spark.checkpoint.dir, removed when the JVM ends.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + (_OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tessera-")))
    path = f"{root.rstrip('/')}/work-{app}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what :func:`fresh_path` gave; only once no plan reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def settled_at(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write ``df`` as a shared table; its path, for :func:`drop_path`, and the table."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a shared table and read it back."""
    return settled_at(df, name)[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)
