"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries expect; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the checkpoint directory set on the context.

    Only where all tasks run in this process a folder of this machine is taken if neither is set (tests);
    elsewhere that is an error, as each executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    at = "file://" + os.path.join(tempfile.gettempdir(), f"quillspark-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", at)
    spark.sparkContext.setCheckpointDir(at)
    return at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the session may have gone


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors.

    The table is removed by done_with(), else when the driver ends, since the DataFrame returned is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # on the object itself, so that nothing keeps it alive
    return out


def once(df: DataFrame) -> DataFrame:
    """df itself if written() has made it, else df written: for a table that a plan reads more than once."""
    return df if getattr(df, "_written_to", None) else written(df)


def done_with(*tables: DataFrame | None) -> None:
    """Removes tables that written() has made and that no DataFrame still to be run reads."""
    for t in tables:
        if getattr(t, "_written_to", None):
            _drop(t.sparkSession, t._written_to)
            t._written_to = None
