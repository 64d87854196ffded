"""Joins and orderings that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import written

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def measured_bytes(df: DataFrame) -> int:
    """Size of a table by its own count: the bytes of texts, binaries and nested values plus 16 per field."""
    fixed = 16 * len(df.columns)
    sizes = []
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            sizes.append(F.octet_length(df[f"`{c}`"]))
        elif t.startswith(("array", "struct", "map")):
            sizes.append(F.octet_length(F.to_json(df[f"`{c}`"])))
    row = sum((F.coalesce(s.cast("bigint"), F.lit(0)) for s in sizes), F.lit(fixed).cast("bigint"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    salt_on: list[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` to a table that is unique on ``keys``.

    The table is broadcast only if its measured size is within ``limit``.
    Otherwise the keys are salted: a hot key of ``rows`` spreads over ``SALTS``
    tasks and the table is repeated that many times.
    """
    if measured_bytes(table) <= limit:
        return rows.join(F.broadcast(table), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def positions(
    rows: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, Column] | None = None,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """Position of every row in its group, with running totals, for any group size.

    Gives ``group, order, position`` (from 1) and one running total per entry of
    ``totals`` (name -> column), the row itself included, and the columns of
    ``carried`` as they are. Rows with equal ``group + order`` stand side by side in any
    order. All columns given are written twice and shuffled once.

    A group is not gathered in one task. The rows are range-partitioned and
    sorted, and their place is written down; each (group, range) chunk is
    numbered alone and then shifted by what the earlier chunks of its group
    hold. Only chunks that continue a group carry a shift, at most one per
    range, so that table is bounded by the number of partitions.
    """
    totals, carried = totals or {}, carried or {}
    keys = [*group, *order]
    narrow = rows.select(*keys, *[c.alias(n) for n, c in {**totals, **carried}.items()])
    # Range partitioning reads its input twice; the second read should not
    # compute the keys and totals again.
    narrow = written(narrow, "keys")
    place = F.monotonically_increasing_id()
    placed = written(
        narrow.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", place.alias("_place"))
        .select("*", F.shiftright("_place", 33).alias("_chunk")),
        "positions",
    )
    chunk = W.partitionBy(*group, "_chunk").orderBy("_place")
    running = chunk.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select(
        *keys,
        *carried,
        "_chunk",
        F.row_number().over(chunk).cast("bigint").alias("position"),
        *[F.sum(n).over(running).alias(n) for n in totals],
    )
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*group, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(f"_t_{n}") for n in totals])
        .select(
            *group,
            "_chunk",
            F.sum("_n").over(before).alias("_n"),
            *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in totals],
        )
        .filter("_n is not null")
    )
    # At most one continued group per range partition: a proven bound.
    shifted = local.join(F.broadcast(shifts), [*group, "_chunk"], "left")
    return shifted.select(
        *keys,
        *carried,
        (F.col("position") + F.coalesce("_n", F.lit(0))).alias("position"),
        *[(F.col(n) + F.coalesce(f"_t_{n}", F.lit(0))).alias(n) for n in totals],
    )


def in_segments(
    parts: DataFrame, group: list[str], order: list[str], text: str, segment_bytes: int, sep: str = "\n"
) -> DataFrame:
    """Ordered texts of a group joined into strings of bounded size.

    ``group, segment, last_segment, n_parts, text``: segments of one group,
    joined by ``sep`` in segment order, are the whole text. A segment ends at the
    part that reaches ``segment_bytes``; small groups are one segment.
    """
    size = (F.octet_length(text) + len(sep)).cast("bigint")
    # The texts go with their keys: rendered and shuffled once, and never joined back, so keys may repeat.
    placed = positions(parts, group, order, {"_end": size}, {"_size": size, "_text": F.col(text)}).withColumn(
        "segment", F.floor((F.col("_end") - F.col("_size")) / F.lit(segment_bytes)).cast("bigint")
    )
    # Narrow rows; the texts are not read for it.
    last = placed.groupBy(*group).agg(F.max("segment").alias("last_segment"))
    return (
        placed.groupBy(*group, "segment")
        .agg(
            F.count(F.lit(1)).alias("n_parts"),
            F.expr(f"listagg(_text, '{sep}') within group (order by position)").alias("text"),
        )
        .join(last, group)
    )
