"""Where intermediate tables live, and how code reaches the executors.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``, which
every machine of a cluster shares.  Only where a session has no such setting
(tests on one machine) is a temporary folder made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import workspace

#: Rows of an Arrow batch, unless the session says otherwise.
BATCH_ROWS = 2_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses; it goes when the driver's JVM ends."""
    return workspace.fresh_path(spark, name)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what :func:`fresh_path` gave; only once no plan reads it any more."""
    workspace.drop_path(spark, path)


def settled_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[str, DataFrame]:
    """Write ``df`` as a shared Parquet table; its path, for :func:`drop_path`, and the table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back: recovery then starts from the table."""
    return settled_at(df, name, codec)[1]


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers; texts are long, so Arrow batches get fewer rows than by default."""
    workspace.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with as many ``_`` before it as make it no column of ``df`` (Spark tells names apart without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def every(df: DataFrame) -> list:
    """All columns of ``df``, whatever characters their names have."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]
