"""The same transformations on streams: word counts that grow with arriving documents, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ngram, total) of a batch or streaming DataFrame; a stream needs output mode complete or update."""
    return docs.select(F.explode(T.words(F.col(text))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("total"))


def daily_documents(docs: DataFrame, time: str = "added_at", late: str = "7 days") -> DataFrame:
    """(day, source, n, chars): documents by day of arrival; later than the watermark is dropped on a stream."""
    d = docs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.window(time, "1 day").alias("w"), "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.col("w.start").alias("day"), "source", "n", "chars")


def append_scores(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends each batch to a Parquet table once: a batch that runs again replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
