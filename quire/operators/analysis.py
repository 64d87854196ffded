"""Totals, extension statistics and rankings of processed files.

Only ``repo_id, path, ext, tokens, lines`` are read; hash aggregation combines
on the map side, so a large repository or extension costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.operators.skew import positions


def overall(processed: DataFrame, *by: str) -> DataFrame:
    return processed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("total_lines"),
    )


def extension_stats(processed: DataFrame, *by: str) -> DataFrame:
    """All extensions, with the first path in path order as the tie-break."""
    return processed.groupBy(*by, "ext").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("tokens").alias("tokens"),
        F.sum("lines").alias("lines"),
        (F.sum("tokens") / F.count(F.lit(1))).alias("avg_tokens"),
        F.min(P.order_key(F.col("path"))).alias("first_path"),
    )


def by_extension(processed: DataFrame, top_n: int | None = C.TOP_N) -> DataFrame:
    """Extensions by tokens, ties by their first file."""
    ranked = extension_stats(processed).orderBy(F.desc("tokens"), "first_path")
    ranked = ranked if top_n is None else ranked.limit(top_n)
    return ranked.select("ext", "file_count", "tokens", "lines")


def top_files(processed: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    """Largest files of the whole corpus; ties keep path order."""
    return (
        processed.select("repo_id", "path", "tokens", "lines")
        .orderBy(F.desc("tokens"), P.order_key(F.col("path")), "repo_id")
        .limit(top_n)
    )


def top_files_per_repo(processed: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    """Largest files of every repository.

    A rank limit on ``row_number`` is applied before the shuffle as well, so each
    map task sends at most ``top_n`` rows per repository.
    """
    w = W.partitionBy("repo_id").orderBy(F.desc("tokens"), P.order_key(F.col("path")))
    return (
        processed.select("repo_id", "path", "tokens", "lines")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top_n)
    )


def over_token_limit(processed: DataFrame, max_tokens: int | None) -> DataFrame:
    """Token total per repository and whether it exceeds a limit; 0 or none is off."""
    totals = overall(processed, "repo_id").select("repo_id", "total_tokens")
    over = F.col("total_tokens") > max_tokens if max_tokens else F.lit(False)
    return totals.withColumn("over_limit", over)


def token_budget(processed: DataFrame, max_tokens: int) -> DataFrame:
    """Running tokens per repository in path order, and what fits the budget."""
    narrow = processed.select("repo_id", "path", "tokens", P.order_key(F.col("path")).alias("_key"))
    placed = positions(narrow, ["repo_id"], ["_key"], {"running_tokens": F.col("tokens")})
    return placed.select(
        "repo_id",
        F.replace("_key", F.lit("\0"), F.lit("/")).alias("path"),
        "position",
        F.col("running_tokens").cast("bigint").alias("running_tokens"),
        (F.col("running_tokens") <= max_tokens).alias("fits"),
    )


def path_order(files: DataFrame) -> DataFrame:
    """Position of each file in the part-by-part path order of its repository."""
    narrow = files.select("repo_id", P.order_key(F.col("path")).alias("_key"))
    return positions(narrow, ["repo_id"], ["_key"]).select(
        "repo_id", F.replace("_key", F.lit("\0"), F.lit("/")).alias("path"), "position"
    )
