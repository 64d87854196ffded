"""Differences between two manifests as joins on ``(repo_id, path)``.

The joins move paths and hashes only. Contents are joined back for modified
files alone.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import text as T
from quire.operators.skew import BROADCAST_BYTES, in_segments, measured_bytes
from quire.session import written

KEYS = ["repo_id", "path"]
DIFF_TYPE = "repo_id string, path string, diff string"


def status(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """``repo_id, path, status``: A added, D deleted, M modified, U unchanged."""
    old = prev.select(*KEYS, F.col("sha256").alias("old_hash"), F.lit(True).alias("in_old"))
    new = curr.select(*KEYS, F.col("sha256").alias("new_hash"), F.lit(True).alias("in_new"))
    return old.join(new, KEYS, "full").select(
        *KEYS,
        F.when(F.col("in_old").isNull(), "A")
        .when(F.col("in_new").isNull(), "D")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "M")
        .otherwise("U")
        .alias("status"),
    )


def added(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return curr.select(*KEYS).join(prev.select(*KEYS), KEYS, "left_anti")


def deleted(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return prev.select(*KEYS).join(curr.select(*KEYS), KEYS, "left_anti")


def modified(prev: DataFrame, curr: DataFrame) -> DataFrame:
    old = prev.select(*KEYS, F.col("sha256").alias("old_hash"))
    new = curr.select(*KEYS, F.col("sha256").alias("new_hash"))
    return old.join(new, KEYS).filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(*KEYS)


def text_pairs(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """``repo_id, path, old_is_text, new_is_text, old_available, new_available, old_text, new_text`` of modified files.

    A side whose content is not stored is not available; its text is empty here and
    must not be taken for an empty file.

    The modified keys are written down first. If their measured size allows it
    they are broadcast, and unmodified contents never leave their map task.
    """
    changed = written(modified(prev, curr), "modified")
    few = measured_bytes(changed) <= BROADCAST_BYTES
    wanted = F.broadcast(changed) if few else changed
    old = prev.select(*KEYS, F.col("is_text").alias("old_is_text"), F.col("content").alias("_old"))
    new = curr.select(*KEYS, F.col("is_text").alias("new_is_text"), F.col("content").alias("_new"))
    return (
        old.join(wanted, KEYS, "left_semi")
        .join(new.join(wanted, KEYS, "left_semi"), KEYS)
        .select(
            *KEYS,
            "old_is_text",
            "new_is_text",
            F.col("_old").isNotNull().alias("old_available"),
            F.col("_new").isNotNull().alias("new_available"),
            F.coalesce("_old", F.lit("")).alias("old_text"),
            F.coalesce("_new", F.lit("")).alias("new_text"),
        )
    )


def special_cases(pairs: DataFrame) -> DataFrame:
    """``repo_id, path, kind, line``: pairs that have no line diff to show."""
    both = F.col("old_is_text") & F.col("new_is_text")
    same = F.col("old_text") == F.col("new_text")
    kind = (
        F.when(~both, "binary")
        .when(~F.col("old_available") | ~F.col("new_available"), "content_missing")
        .when(same, "no_textual_change")
        .otherwise("textual")
    )
    a, b = F.concat(F.lit("a/"), F.col("path")), F.concat(F.lit("b/"), F.col("path"))
    return pairs.withColumn("kind", kind).select(
        *KEYS,
        "kind",
        F.when(F.col("kind") == "binary", F.concat(F.lit("Binary files differ: "), a, F.lit(" "), b))
        .when(
            F.col("kind") == "no_textual_change",
            F.concat(F.lit("diff --git "), a, F.lit(" "), b, F.lit("\n" + C.NO_TEXT_CHANGE)),
        )
        .when(
            F.col("kind") == "content_missing", F.concat(F.lit("Content not stored: "), a, F.lit(" "), b)
        )
        .alias("line"),
    )


def line_stats(pairs: DataFrame) -> DataFrame:
    """``repo_id, path, lines_added, lines_removed``: difference of the line multisets.

    Equal lines are netted out by a grouped sum that combines on the map side,
    so a line that repeats often is one row per task. A pair of texts of which one is
    not stored has no row, as ``special_cases`` calls it ``content_missing``.
    """
    stored = F.col("old_available") & F.col("new_available")
    pairs = pairs.filter(~(F.col("old_is_text") & F.col("new_is_text")) | stored)
    sides = pairs.select(
        *KEYS,
        F.explode(
            F.concat(
                F.transform(T.lines(F.col("old_text")), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("n"))),
                F.transform(T.lines(F.col("new_text")), lambda x: F.struct(x.alias("line"), F.lit(1).alias("n"))),
            )
        ).alias("side"),
    )
    net = sides.groupBy(*KEYS, "side.line").agg(F.sum("side.n").alias("n"))
    counted = net.groupBy(*KEYS).agg(
        F.sum(F.greatest("n", F.lit(0))).cast("bigint").alias("lines_added"),
        F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("bigint").alias("lines_removed"),
    )
    # A pair of two empty texts has no line row at all.
    blank = pairs.filter((F.col("old_text") == "") & (F.col("new_text") == ""))
    zero = F.lit(0).cast("bigint")
    return counted.unionByName(blank.select(*KEYS, zero.alias("lines_added"), zero.alias("lines_removed")))


def _diff_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [
            "\n".join(
                difflib.unified_diff(
                    old.splitlines(), new.splitlines(), f"a/{path}", f"b/{path}", n=3, lineterm=""
                )
            )
            for path, old, new in zip(batch["path"], batch["old_text"], batch["new_text"])
        ]
        yield batch[KEYS].assign(diff=texts)


def unified(pairs: DataFrame) -> DataFrame:
    """``repo_id, path, diff``: unified diff with three context lines.

    Only modified text files with both contents at hand reach Python, one pair at a
    time; a pair is as large as its two files, as no limit on them is on by default.
    """
    textual = pairs.filter(
        F.col("old_is_text") & F.col("new_is_text") & F.col("old_available") & F.col("new_available") & (F.col("old_text") != F.col("new_text"))
    )
    return textual.select(*KEYS, "old_text", "new_text").mapInPandas(_diff_batches, DIFF_TYPE)


def summary(states: DataFrame) -> DataFrame:
    """Numbers of added, deleted and modified files per repository."""
    return states.groupBy("repo_id").agg(
        *[
            F.count_if(F.col("status") == s).alias(n)
            for s, n in (("A", "added"), ("D", "deleted"), ("M", "modified"))
        ]
    )


def report_lines(states: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """``repo_id, section, key, line``: the diff report as ordered rows.

    Counts, then the added, deleted and modified paths in string order, then the
    diffs (``repo_id, path, diff``). A section without rows has no heading.
    """
    counts = summary(states).select(
        "repo_id",
        F.lit(0).alias("section"),
        F.lit("").alias("key"),
        F.concat(
            F.lit("Diff Summary\nAdded: "), F.col("added"),
            F.lit("\nDeleted: "), F.col("deleted"),
            F.lit("\nModified: "), F.col("modified"),
        ).alias("line"),
    )
    changed = states.filter("status <> 'U'").select(
        "repo_id",
        F.when(F.col("status") == "A", 2).when(F.col("status") == "D", 4).otherwise(6).alias("section"),
        F.col("path").alias("key"),
        F.concat("status", F.lit("\t"), "path").alias("line"),
    )
    rows = counts.unionByName(changed)
    bodies = changed
    if diffs is not None:
        texts = diffs.select(
            "repo_id", F.lit(8).alias("section"), F.col("path").alias("key"), F.col("diff").alias("line")
        )
        rows, bodies = rows.unionByName(texts), bodies.unionByName(texts)
    titles = bodies.select("repo_id", "section").distinct().select(
        "repo_id",
        (F.col("section") - 1).alias("section"),
        F.lit("").alias("key"),
        F.when(F.col("section") == 2, "\n# Added")
        .when(F.col("section") == 4, "\n# Deleted")
        .when(F.col("section") == 6, "\n# Modified")
        .otherwise("\n# Diffs")
        .alias("line"),
    )
    return rows.unionByName(titles)


def diff_texts(pairs: DataFrame) -> DataFrame:
    """Unified diffs together with the lines of the special cases."""
    special = special_cases(pairs).filter("line is not null")
    return unified(pairs).unionByName(special.select(*KEYS, F.col("line").alias("diff")))


def report(lines: DataFrame, segment_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """Reports as strings of bounded size; see ``in_segments``."""
    texts = lines.withColumnRenamed("line", "text")
    return in_segments(texts, ["repo_id"], ["section", "key"], "text", segment_bytes).drop("last_segment")


def report_tokens(lines: DataFrame) -> DataFrame:
    """Words of each report. Rows join by a newline, so words add up over rows."""
    return lines.groupBy("repo_id").agg(F.sum(T.word_count(F.col("line"))).alias("diff_tokens"))


def write_report(lines: DataFrame, folder: str) -> None:
    """Reports as text files, one folder per repository, files in report order."""
    order = ["repo_id", "section", "key"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("repo_id", F.col("line").alias("text"))
        .write.partitionBy("repo_id")
        .text(folder)
    )
