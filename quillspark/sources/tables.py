"""Readers of the test tables and small table-level repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan in as many partitions as the cluster runs tasks at least: a table of few files is spread before its texts are worked on.

    For plain scans only, whose partitions are known without running anything; a table of many files stays as it is.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan
