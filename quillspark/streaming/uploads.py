"""Incremental corpus: text files that arrive in a folder replace the books of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def follow(spark: SparkSession, folder: str, corpus: str, checkpoint: str, clean: bool = True) -> StreamingQuery:
    """Stream new .txt files of ``folder`` into the table at ``corpus``, partitioned by book: a batch
    overwrites the partitions of its books only, so a repeated batch changes nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(folder)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    books = files.select(T.file_stem(F.col("path")).alias("book"), (T.clean(text) if clean else text).alias("text"), "modificationTime")

    def put(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("book").agg(F.max_by("text", "modificationTime").alias("text"))
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(corpus)

    return books.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
