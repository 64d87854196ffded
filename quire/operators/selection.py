"""Subtree selection: which files a set of chosen paths covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import paths as P
from quire.operators.skew import lookup_join

KEYS = ["repo_id", "path"]


def select_subtree(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Files that are chosen or lie below a chosen directory.

    ``selection`` is ``repo_id, path, is_dir``. The prefix test is an equi join:
    a file is matched by its own path and by each of its ancestors.
    """
    file_path = F.col("path")
    reach = files.select(
        "repo_id",
        file_path.alias("file"),
        F.explode(
            F.array_append(
                F.transform(P.ancestors(file_path), lambda a: F.struct(a.alias("path"), F.lit(True).alias("is_dir"))),
                F.struct(file_path.alias("path"), F.lit(False).alias("is_dir")),
            )
        ).alias("_at"),
    ).select("repo_id", "file", "_at.path", "_at.is_dir")
    chosen = selection.select(*KEYS, "is_dir").distinct()
    # A full directory is a hot key here: broadcast by measured size, else salted.
    hit = lookup_join(reach, chosen, [*KEYS, "is_dir"], ["file"], "left_semi")
    return hit.select("repo_id", F.col("file").alias("path")).distinct()


def selection_union(*selections: DataFrame) -> DataFrame:
    """Union of file selections without duplicates."""
    out = selections[0].select(*KEYS)
    for s in selections[1:]:
        out = out.unionByName(s.select(*KEYS))
    return out.distinct()


def selection_status(files: DataFrame, selected: DataFrame) -> DataFrame:
    """``repo_id, dir, status``: full, partial or none over the files below.

    Counts combine on the map side, so a large directory is one row per task.
    """
    flagged = files.select(*KEYS).join(
        selected.select(*KEYS, F.lit(True).alias("on")), KEYS, "left"
    )
    return (
        flagged.select("repo_id", F.explode(P.ancestors(F.col("path"))).alias("dir"), "on")
        .groupBy("repo_id", "dir")
        .agg(F.count(F.lit(1)).alias("n"), F.count("on").alias("chosen"))
        .select(
            "repo_id",
            "dir",
            F.when(F.col("chosen") == F.col("n"), "full")
            .when(F.col("chosen") > 0, "partial")
            .otherwise("none")
            .alias("status"),
        )
    )
