"""Tables that are replaced as a whole: readers see the old ones or the new ones.

Tables of one version are written to a folder of their own, out of sight. Then one
empty file, whose name has the number of the version and the name of that folder, is
created below ``versions``; this is a single step on every file system, and all that a
reader looks at. A writer that is lost before it leaves nothing that is read. Of two
writers at a time, both versions are whole and the greater name is current.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEEP = 2


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def children(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder, none if it does not exist."""
    system, path = _system(spark, folder)
    if not system.exists(path):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published versions, oldest first."""
    return children(spark, f"{folder}/versions")


def publish(tables: dict[str, DataFrame], folder: str, keep: int = KEEP) -> None:
    """Write ``tables`` (parquet, by name) and make them the current version of ``folder``.

    The last ``keep`` versions stay, so that who reads the one before can finish; older ones,
    and only those, are deleted.
    """
    if keep < 1:
        raise ValueError("the published version has to stay")
    spark = next(iter(tables.values())).sparkSession
    data = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/data/{data}/{name}")
    before = versions(spark, folder)
    number = int(before[-1].split("-")[0]) + 1 if before else 0
    system, pointer = _system(spark, f"{folder}/versions/{number:012d}-{data}")
    system.create(pointer, False).close()
    for old in versions(spark, folder)[:-keep]:
        # The pointer goes first: nobody finds a version whose files are going.
        for gone in (f"{folder}/versions/{old}", f"{folder}/data/{old.split('-')[1]}"):
            system, path = _system(spark, gone)
            system.delete(path, True)


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder that holds the tables of the current version; None if nothing is published."""
    names = versions(spark, folder)
    return f"{folder}/data/{names[-1].split('-')[1]}" if names else None
