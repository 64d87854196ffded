"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must see it, so on a cluster it has to be set. Only a local
    master gets a temporary folder of its own, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/quire/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage at a durable copy: a lost executor costs a re-read, and
    what a plan fixed at run time (range boundaries, row positions) stays fixed
    for every later use.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once no plan that is still to run reads it."""
    for df in tables:
        spark = df.sparkSession
        mark = f"{shared_folder(spark).rstrip('/')}/quire/"
        folders = {f[: f.rindex("/")] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            # Only folders of this package, by the name that ``new_folder`` gives.
            if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(mark).toUri().getPath()):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def addressed(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` with ``_file`` and ``_at``, the file of each row and its place there.

    The address stays the same however a later read splits the files. What has no
    such places (anything but a read of parquet files) is written first.
    """
    try:
        own = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(own["file_path"]).alias("_file"), own["row_index"].alias("_at"))
    except AnalysisException:
        copy = written(df, label)
        own = copy.metadataColumn("_metadata")
        return copy.select("*", F.xxhash64(own["file_path"]).alias("_file"), own["row_index"].alias("_at"))
