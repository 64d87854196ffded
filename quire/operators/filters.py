"""Which files belong to a corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import globs as G
from quire.functions import paths as P
from quire.operators.skew import BROADCAST_BYTES, lookup_join, measured_bytes
from quire.options import PackOptions
from quire.session import written
from quire.sources.rules import keyed_rules

KEYS = ["repo_id", "path"]


def in_skipped_dir(path: Column) -> Column:
    """The scan's test: only the directories of a path count."""
    return P.skipped(P.dir_parts(path))


def is_text(path: Column, size: Column, content: Column, max_bytes: int | None = None) -> Column:
    """Size if it is limited, then extension lists, then NUL bytes at the start of the raw bytes."""
    suffix = F.lower(P.suffix(path))
    too_large = F.lit(False) if max_bytes is None else size > max_bytes
    return (
        F.when(too_large, False)
        .when(suffix.isin(*C.BINARY_EXTENSIONS), False)
        .when(suffix.isin(*C.TEXT_EXTENSIONS), True)
        .otherwise(~F.contains(F.substring(content, 1, C.SNIFF_BYTES), F.lit(b"\0")))
    )


def included_by_globs(path: Column, include: Iterable[str]) -> Column:
    """No pattern means everything."""
    include = list(include)
    return G.matches_any(path, include) if include else F.lit(True)


def ignored_paths(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """``repo_id, path`` that the rules of their own repository ignore; the last matching rule decides.

    A path is taken apart into its folders, names and ends, which meet the rules by equality, so the number of
    rules of a repository does not matter; only rules with wildcards elsewhere test a pattern, on the paths
    that share their literal part.
    """
    keyed = written(keyed_rules(rules), "rules")
    paths = listing.select(*KEYS).withColumn("_key", F.explode(G.path_keys(F.col("path")))).select(*KEYS, "_key.*")
    table = F.broadcast(keyed) if measured_bytes(keyed) <= BROADCAST_BYTES else keyed
    met = paths.join(table, ["repo_id", "kind", "key"])
    tested = F.when(F.col("regex").isNotNull(), F.rlike("path", F.col("regex"))).otherwise(~F.col("below") | F.col("above"))
    last = met.filter(tested).groupBy(*KEYS).agg(F.max_by("negated", "ordinal").alias("negated"))
    return last.filter(~F.col("negated")).select(*KEYS)


def drop_ignored(files: DataFrame, rules: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Files that the rules of their own repository do not ignore.

    ``listing`` holds at least the keys of ``files`` where that is cheaper to read. Ignored keys are broadcast if
    their measured size allows it, so contents are not shuffled.
    """
    ignored = written(ignored_paths(files if listing is None else listing, rules), "ignored")
    return lookup_join(files, ignored, KEYS, KEYS, "left_anti")


def explicit_files(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """An explicit list overrides every filter."""
    return files.join(chosen.select(*KEYS), KEYS, "left_semi")


def included_files(
    files: DataFrame,
    options: PackOptions = PackOptions(),
    rules: DataFrame | None = None,
    chosen: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """The whole inclusion test on ``repo_id, path, size, content BINARY``; for ``listing`` see ``drop_ignored``."""
    if chosen is not None:
        return explicit_files(files, chosen)
    path = F.col("path")
    named = (
        ~in_skipped_dir(path)
        & ~G.matches_any(path, options.exclude_patterns)
        & included_by_globs(path, options.include_patterns)
    )
    kept = files.filter(named & is_text(path, F.col("size"), F.col("content"), options.max_file_bytes))
    if options.respect_gitignore and rules is not None:
        kept = drop_ignored(kept, rules, (files if listing is None else listing).filter(named))
    return kept
