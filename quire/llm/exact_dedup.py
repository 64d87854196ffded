"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is a block of successive bytes. All texts start in one group; each round
splits every open group by its next digit. A group is closed when it has one row
(nothing equals it) or when its texts ended in that digit (all of them are
equal). The other groups go on. Equality is decided on the bytes themselves,
never on a digest.

The first digit is taken from every row by an aggregate that combines on the map
side, and only rows whose first digit occurs twice carry their text any further.
Digits grow by ``GROWTH`` from round to round, so the number of rounds is
logarithmic in the longest text, and a round reads only what is left of the texts
that are still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, packed
from quire.session import written

FIRST_DIGIT = 64
GROWTH = 8


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null text counts
    as empty, empty texts are equal to each other. ``keep_id`` is the largest
    ``doc_id`` of the equal texts, null only if all of them are null. Exactly one
    row of a group is ``kept``, also among repeated rows with the same id. An
    empty table gives an empty table.
    """
    return _marked(docs.select("doc_id", "text"), first_digit, growth).select(
        "doc_id", "keep_id", "group_size", "kept", F.sha2("_text", 256).alias("text_sha256")
    )


def exact_kept(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``exact_groups``."""
    return _marked(docs, first_digit, growth).filter("kept").select("_doc.*")


def _marked(docs: DataFrame, first_digit: int, growth: int) -> DataFrame:
    """``_doc, doc_id, _text, keep_id, group_size, kept``; ``_text`` holds the bytes."""
    rows = packed(docs, "doc_id", "text")
    rows = rows.select("_doc", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    rows = rows.withColumn("_digit", F.substring("_text", 1, first_digit))
    shared = rows.groupBy("_digit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = bounded(written(shared.select("_digit", F.lit(True).alias("_open")), "digits"))
    tagged = rows.join(shared, "_digit", "left")
    alone = tagged.filter("_open is null").select(
        "_doc",
        "doc_id",
        "_text",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    held = written(tagged.filter("_open").select("_doc", "doc_id", "_text", F.monotonically_increasing_id().alias("_row")), "open")
    marks = held.join(bounded(written(_rounds(held, first_digit, growth), "equal")), "_row", "left").select(
        "_doc",
        "doc_id",
        "_text",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep._row"), F.lit(True)).alias("kept"),
    )
    return alone.unionByName(marks)


def _rounds(held: DataFrame, width: int, growth: int) -> DataFrame:
    """``_row, _size, _keep`` of the rows that have an equal."""
    active = held.select("_row", "doc_id", F.lit(0).cast("bigint").alias("_group"), F.col("_text").alias("_rest"))
    keys = ["_group", "_digit", "_ended"]
    closed = []
    while True:
        split = active.select(
            "_row",
            "doc_id",
            "_group",
            F.substring("_rest", 1, width).alias("_digit"),
            (F.octet_length("_rest") <= width).alias("_ended"),
            F.expr(f"substring(_rest, {width + 1})").alias("_rest"),
        )
        groups = (
            split.groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("_size"),
                F.min("_row").alias("_next"),
                F.max(F.struct("doc_id", "_row")).alias("_keep"),
            )
            .filter("_size > 1")
        )
        # Written, so that the join is free of the aggregate's partitions and hot groups can be split.
        groups = bounded(written(groups, "groups"))
        done = written(split.join(groups, keys).select("_row", "doc_id", "_ended", "_size", "_keep", "_next", "_rest"), "round")
        closed.append(done.filter("_ended").select("_row", "_size", "_keep"))
        active = done.filter("not _ended").select("_row", "doc_id", F.col("_next").alias("_group"), "_rest")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        width *= growth
