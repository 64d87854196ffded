"""Running extension statistics of a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import paths as P
from quire.functions import text as T


def measured(files: DataFrame) -> DataFrame:
    """Stateless part: ``repo_id, path, ext, tokens, lines``; for batch and stream."""
    return files.select(
        "repo_id",
        "path",
        P.ext(F.col("path")).alias("ext"),
        T.word_count(F.col("content")).alias("tokens"),
        T.line_count(F.col("content")).alias("lines"),
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """One row of state per extension."""
    return measured(files).groupBy("ext").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines")
    )


def drain(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stateful stream over what is there now; its result table in ``folder``.

    Each batch replaces the table by the complete result, so a repeated batch
    does no harm and nothing is held on the driver. A stream without rows gives an empty table, one without
    news the table as it was.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)

    def replace(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(folder)

    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
