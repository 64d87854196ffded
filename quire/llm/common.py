"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.skew import measured_bytes

BROADCAST_BYTES = 32 * 1024 * 1024
PIECE_BYTES = 4_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *columns: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The given columns, and whole rows (or what to ``keep`` of them) as the struct ``_doc``.

    Columns that an operator adds cannot clash with those of the input; a row is
    unpacked with ``select("_doc.*")``. What is not used of it is not read.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("_doc")
    return docs.select(whole, *[docs[c] for c in columns])


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(df[column], F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def bounded(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its measured size is within ``limit``.

    Beyond the limit it is left alone: the join then shuffles both sides and
    adaptive execution splits the partitions of hot keys.
    """
    return F.broadcast(small) if measured_bytes(small) <= limit else small


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def drawn(labels: DataFrame, sample: int, key: str = "doc_id") -> DataFrame:
    """About ``sample`` rows of a table of labels, all if it has no more, drawn by a hash of their key.

    The result is small enough to be broadcast whatever the size of the table.
    """
    n = labels.count()
    if n <= sample:
        return labels
    return labels.filter(F.pmod(F.xxhash64(labels[key]), F.lit(1 << 30)) < int((1 << 30) * sample / n))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``size`` bytes of ``column``, whole rows each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(lengths, dtype=np.int64) // size
        cuts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist() + [batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def rows_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
