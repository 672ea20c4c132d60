"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import written


def numbered(df: DataFrame, name: str, *order, start: int = 0) -> DataFrame:
    """df with the column name: start, start + 1, ... in the given order.

    The table is range-partitioned, sorted within partitions and written; only one count a
    partition goes to the driver. Rows that tie in the order are numbered in an undefined
    order, so the order should end in a key. An empty table stays empty.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offset, pairs = start, []
    for p, n in counts:
        pairs += [F.lit(p).cast("long"), F.lit(offset).cast("long")]
        offset += n
    base = F.create_map(*pairs)[part] if pairs else F.lit(0).cast("long")
    return kept.withColumn(name, base + row).drop("_at")
