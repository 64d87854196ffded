"""Tables as corpora: any table becomes the ``files`` relation by a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.operators.skew import in_segments
from quire.session import written


def scan_table(
    table: DataFrame, repo_id: str | Column, path: str | Column, content: str | Column, *keep: str
) -> DataFrame:
    """``repo_id, path, content`` from an arbitrary table, with ``keep`` columns carried."""
    as_col = lambda c: F.expr(c) if isinstance(c, str) else c
    return table.select(
        as_col(repo_id).cast("string").alias("repo_id"),
        as_col(path).alias("path"),
        as_col(content).alias("content"),
        *keep,
    )


def listed_repository(listing: DataFrame) -> DataFrame:
    """Files of a pre-listed repository: allowed extension, no excluded directory.

    ``listing`` has ``path`` and ``type`` (file or dir). The classifier, ignore
    rules and globs do not apply here.
    """
    bare = F.lower(F.regexp_replace(P.suffix(F.col("path")), r"\A\.", ""))
    return listing.filter(
        (F.col("type") == "file")
        & bare.isin(*C.FENCE_LANGUAGES)
        & ~P.has_part(P.dir_parts(F.col("path")), C.LISTING_EXCLUDED_DIRS)
    )


def ordered_text(segments: DataFrame, doc_id: str, pos: str, text: str, part_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """Segment texts of a document joined by one space in position order.

    ``doc_id, part, text``. A document of up to ``part_bytes`` is one row. A longer one is cut, wherever
    its positions begin and however they are spaced, into parts that end with the segment that reaches
    ``part_bytes``; they are made without gathering the document. Its parts, joined by a space,
    are its text. A null text counts as empty and keeps its separator; segments with one position stand side by side.
    """
    rows = segments.select(doc_id, F.col(pos).alias("_pos"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = F.sum(F.octet_length("_text") + F.lit(1)).alias("_bytes")
    large = written(rows.groupBy(doc_id).agg(size).filter(F.col("_bytes") > part_bytes).select(doc_id), "large")

    def whole(own: DataFrame) -> DataFrame:
        joined = F.expr("listagg(_text, ' ') within group (order by _pos)").alias("text")
        return own.groupBy(doc_id).agg(joined).select(doc_id, F.lit(0).cast("bigint").alias("part"), "text")

    if large.isEmpty():
        return whole(rows)
    # Null ids are one document, as in a grouping.
    named = large.select(F.col(doc_id).alias("_large"))
    same = F.col(doc_id).eqNullSafe(F.col("_large"))
    cut = in_segments(rows.join(named, same, "left_semi"), [doc_id], ["_pos"], "_text", part_bytes, " ")
    return whole(rows.join(named, same, "left_anti")).unionByName(cut.select(doc_id, F.col("segment").alias("part"), "text"))
