"""Text of one file in a pack, and the ordered parts of whole packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.functions import text as T
from quire.operators.skew import in_segments, positions
from quire.operators.tree import tree_lines, visible
from quire.options import PackOptions
from quire.session import written

SEGMENT_BYTES = 32 * 1024 * 1024
PART_KEYS = ["section", "key"]


def default_block(path: Column, lang: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Relative File Path: "), path, F.lit("\n\n```"), lang, F.lit("\n"), content, F.lit("\n```\n")
    )


def markdown_block(path: Column, lang: Column, content: Column) -> Column:
    fence = T.fence(content)
    return F.concat(F.lit("## "), path, F.lit("\n"), fence, lang, F.lit("\n"), content, F.lit("\n"), fence, F.lit("\n"))


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_block(path: Column, index: Column, content: Column, escape: bool = False) -> Column:
    shown = xml_escaped if escape else lambda c: c
    return F.concat(
        F.lit('<document index="'), index.cast("string"), F.lit('">\n<source>'), shown(path),
        F.lit("</source>\n<document_content>\n"), shown(content), F.lit("\n</document_content>\n</document>\n"),
    )


def single_source(source: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Source: "), source, F.lit("\n\n---\n\n"), F.coalesce(content, F.lit("No content found."))
    )


def document_index(processed: DataFrame) -> DataFrame:
    """1-based index in path order; summaries consume none."""
    narrow = processed.filter(~F.col("is_summary")).select("repo_id", P.order_key(F.col("path")).alias("key"))
    return positions(narrow, ["repo_id"], ["key"]).withColumnRenamed("position", "doc_index")


def rendered(processed: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """``repo_id, key, text``: one block per file, ``key`` in path order."""
    rows = processed.withColumn("key", P.order_key(F.col("path")))
    path, lang, content = F.col("path"), F.col("lang"), F.col("content")
    if options.output_format == "cxml":
        rows = rows.join(document_index(processed), ["repo_id", "key"], "left")
        block = xml_block(path, F.col("doc_index"), content, options.escape_xml)
    elif options.output_format == "markdown":
        block = markdown_block(path, lang, content)
    else:
        block = default_block(path, lang, content)
    # A summary is emitted as it is.
    block = F.when(F.col("is_summary"), F.concat(content, F.lit("\n"))).otherwise(block)
    return rows.select("repo_id", "key", block.alias("text"))


def pack_parts(
    processed: DataFrame, options: PackOptions = PackOptions(), repos: DataFrame | None = None
) -> DataFrame:
    """``repo_id, section, key, text``: packs as ordered rows.

    Joined by newlines in ``(section, key)`` order the rows of a repository are
    its pack. ``repos`` names repositories that may have no file at all.
    """
    known = processed.select("repo_id").distinct()
    if repos is not None:
        known = known.unionByName(repos.select("repo_id")).distinct()

    def fixed(rows: DataFrame, section: int, text: str) -> DataFrame:
        return rows.select("repo_id", F.lit(section).alias("section"), F.lit("").alias("key"), F.lit(text).alias("text"))

    tree = tree_lines(visible(processed.select("repo_id", "path")), options.tree_depth)
    parts = fixed(known, 0, C.TREE_HEADING).unionByName(
        tree.select("repo_id", F.lit(1).alias("section"), F.col("tree_key").alias("key"), F.col("line").alias("text"))
    )
    parts = parts.unionByName(fixed(known, 2, "\n"))
    if options.output_format == "cxml":
        parts = parts.unionByName(fixed(known, 3, "<documents>")).unionByName(fixed(known, 5, "</documents>"))
    blocks = rendered(processed, options)
    parts = parts.unionByName(blocks.select("repo_id", F.lit(4).alias("section"), "key", "text"))
    if repos is not None:
        empty = known.join(processed.select("repo_id").distinct(), "repo_id", "left_anti")
        parts = parts.unionByName(fixed(empty, 4, C.NO_FILES_MESSAGE))
    return parts


def assembled(parts: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Packs as strings of bounded size; a pack below the bound is one row.

    The end of a pack is stripped.
    """
    joined = in_segments(parts, ["repo_id"], PART_KEYS, "text", segment_bytes)
    at_end = F.col("segment") == F.col("last_segment")
    return joined.select(
        "repo_id",
        "segment",
        "n_parts",
        F.when(at_end, F.regexp_replace("text", rf"[{C.SPACES}]+\z", "")).otherwise(F.col("text")).alias("text"),
    )


def write_pack(parts: DataFrame, folder: str) -> None:
    """Packs as text files, one folder per repository, files in pack order.

    Ranges of the pack order are written in parallel; a large pack has many
    files, and their names sort in its order. The parts are written first: finding the
    ranges reads them a second time and must not render them again.
    """
    (
        written(parts, "parts").repartitionByRange("repo_id", *PART_KEYS)
        .sortWithinPartitions("repo_id", *PART_KEYS)
        .select("repo_id", "text")
        .write.partitionBy("repo_id")
        .text(folder)
    )
