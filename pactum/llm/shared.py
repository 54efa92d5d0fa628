"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir.

    Where that is unset, a session in one process (tests) gets a temporary folder of its own; on a cluster a folder that
    the executors don't share would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pactum-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: int) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends, and lost executors cost nothing.

    The shuffle files of the query go when it has ended. The table stays until ``release``; what a result still reads when it
    is returned is left to whoever clears spark.checkpoint.dir. ``options``: of the Parquet writer.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` gave and nothing reads any more."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
