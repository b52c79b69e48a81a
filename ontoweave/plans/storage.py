"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    own = "/tmp/checkpoints/ontoweave"
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Unlike a cached or locally checkpointed frame the result survives the loss of any executor, and
    the reread table carries sizes that let the planner check what it broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ontoweave_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame that ``materialize`` returned; others are left alone."""
    path = getattr(df, "_ontoweave_path", None)
    if path is None:
        return
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    df._ontoweave_path = None
