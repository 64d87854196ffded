"""A manifest kept up to date from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

KEYS = ["repo_id", "path"]
EVENTS = ST.StructType(
    [ST.StructField(n, ST.StringType()) for n in (*KEYS, "sha256", "status")]
    + [ST.StructField("batch", ST.LongType())]
)


class ManifestStream:
    """Diffs each micro-batch against the manifest and appends what changed.

    A file without a hash is deleted: its status is ``D``, and ``A`` if it comes again; deletions of unknown files
    are left out. The manifest is a log: ``events/batch=n`` holds the hashes that batch ``n``
    brought, batch -1 the start. A batch reads the earlier entries of its own
    files only and writes in proportion to itself. Its folder is overwritten, so
    a repeated batch gives the same log.
    """

    def __init__(self, folder: str, start: DataFrame):
        self.folder = f"{folder}/events"
        self._write(start.select(*KEYS, "sha256").withColumn("status", F.lit("U")), -1)

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(EVENTS).parquet(self.folder)

    def current(self, spark: SparkSession) -> DataFrame:
        """The manifest: the latest hash of each file that is not deleted."""
        latest = self.events(spark).groupBy(*KEYS).agg(F.max_by("sha256", "batch").alias("sha256"))
        return latest.filter("sha256 is not null")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        # The same file may come twice in a batch; the greatest mtime is current.
        fresh = batch.groupBy(*KEYS).agg(F.max_by("sha256", F.struct("mtime", "sha256")).alias("sha256"))
        known = (
            self.events(batch.sparkSession)
            .filter(F.col("batch") < batch_id)
            .join(fresh.select(*KEYS), KEYS, "left_semi")
            .groupBy(*KEYS)
            .agg(F.max_by("sha256", "batch").alias("old_hash"))
        )
        old, new = F.col("old_hash"), F.col("sha256")
        state = F.when(new.isNull(), "D").when(old.isNull(), "A").when(old != new, "M").otherwise("U")
        changed = fresh.join(known, KEYS, "left").filter(new.isNotNull() | old.isNotNull())
        self._write(changed.select(*KEYS, "sha256", state.alias("status")), batch_id)

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Consume what is there now; the events of all batches."""
        query = (
            stream.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.events(stream.sparkSession).filter("batch >= 0")
