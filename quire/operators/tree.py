"""Directory trees derived from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.operators.skew import lookup_join
from quire.session import written

NODE_KEYS = ["repo_id", "path"]


def tree_nodes(files: DataFrame) -> DataFrame:
    """``repo_id, path, parent, name, depth, is_dir``: the files and all directories above.

    A path is a directory if something lies below it. Directories are made
    distinct on the map side first, so a full directory sends few rows.
    """
    dirs = files.select("repo_id", F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    marked = dirs.withColumn("is_dir", F.lit(True)).unionByName(
        files.select(*NODE_KEYS).withColumn("is_dir", F.lit(False))
    )
    path = F.col("path")
    return (
        marked.groupBy(*NODE_KEYS)
        .agg(F.max("is_dir").alias("is_dir"))
        .select(
            *NODE_KEYS,
            P.parent(path).alias("parent"),
            P.name(path).alias("name"),
            P.depth(path).alias("depth"),
            "is_dir",
        )
    )


def visible(files: DataFrame) -> DataFrame:
    """The tree leaves out hidden and build paths, files included."""
    return files.filter(~P.skipped(P.parts(F.col("path"))))


def sibling_key(name: Column, is_dir: Column) -> Column:
    """Directories first, then by lower-cased name."""
    return F.concat(F.when(is_dir, "0").otherwise("1"), F.lower(name), F.lit("\1"), name, F.lit("\0"))


def listing_key(name: Column, is_dir: Column) -> Column:
    """By name only."""
    return F.concat(name, F.lit("\0"))


def order_path(path: Column, is_dir: Column, listing: bool = False) -> Column:
    """Byte order of this key is the order in which a tree is printed."""
    p, key = P.parts(path), listing_key if listing else sibling_key
    last = F.size(p) - 1
    return F.array_join(F.transform(p, lambda x, i: key(x, (i < last) | is_dir)), "")


def last_children(nodes: DataFrame, listing: bool = False) -> DataFrame:
    """Flag ``is_last`` on the node that closes its directory.

    The last name per directory is a maximum, combined on the map side; a window
    over a full directory would gather it in one task. The join back is on the
    unique node, so no key is hot.
    """
    key = (listing_key if listing else sibling_key)(F.col("name"), F.col("is_dir"))
    last = nodes.groupBy("repo_id", "parent").agg(F.max_by("path", key).alias("path"))
    return nodes.join(
        last.select(*NODE_KEYS, F.lit(True).alias("is_last")), NODE_KEYS, "left"
    ).withColumn("is_last", F.coalesce("is_last", F.lit(False)))


def limited_depth(nodes: DataFrame, tree_depth: int = C.TREE_DEPTH) -> DataFrame:
    """Nodes down to ``tree_depth``; a directory there has one placeholder child."""
    shown = nodes.filter(F.col("depth") <= tree_depth).withColumn("placeholder", F.lit(False))
    cut = nodes.filter((F.col("depth") == tree_depth) & F.col("is_dir")).select(
        "repo_id",
        F.concat("path", F.lit("/"), F.lit(C.DEPTH_PLACEHOLDER)).alias("path"),
        F.col("path").alias("parent"),
        F.lit(C.DEPTH_PLACEHOLDER).alias("name"),
        (F.col("depth") + 1).alias("depth"),
        F.lit(False).alias("is_dir"),
        F.lit(True).alias("placeholder"),
    )
    return shown.unionByName(cut)


def tree_lines(files: DataFrame, tree_depth: int = C.TREE_DEPTH, listing: bool = False) -> DataFrame:
    """``repo_id, tree_key, line``: a printed tree, one row per line, root first.

    Lines sort by ``tree_key``. Guides of a directory are put together once and
    looked up by its children.
    """
    # Written once: narrow rows that the guides and the lines both need.
    nodes = written(last_children(limited_depth(tree_nodes(files), tree_depth), listing), "tree")
    flags = nodes.filter("is_dir").select("repo_id", "path", "is_last")
    # Guide of a directory: one piece per directory on the way, itself included.
    steps = flags.select(
        "repo_id",
        F.col("path").alias("dir"),
        F.posexplode(F.array_append(P.ancestors(F.col("path")), F.col("path"))).alias("level", "path"),
    )
    # The way down is at most ``tree_depth`` long, which bounds each group.
    guides = (
        lookup_join(steps, flags, NODE_KEYS, ["dir"], "inner")
        .groupBy("repo_id", "dir")
        .agg(
            F.array_sort(F.collect_list(F.struct("level", "is_last"))).alias("way"),
        )
        .select(
            "repo_id",
            F.col("dir").alias("parent"),
            F.array_join(
                F.transform("way", lambda s: F.when(s["is_last"], F.lit("    ")).otherwise("│   ")), ""
            ).alias("guide"),
        )
    )
    placed = lookup_join(nodes, guides, ["repo_id", "parent"], ["path"])
    icon = (
        F.when(F.col("placeholder"), "")
        .when(F.col("is_dir"), C.DIR_ICON + " ")
        .otherwise(C.FILE_ICON + " ")
    )
    body = placed.select(
        "repo_id",
        order_path(F.col("path"), F.col("is_dir"), listing).alias("tree_key"),
        F.concat(
            F.coalesce("guide", F.lit("")),
            F.when(F.col("is_last"), "└── ").otherwise("├── "),
            icon,
            F.col("name"),
        ).alias("line"),
    )
    roots = files.select("repo_id").distinct().select(
        "repo_id",
        F.lit("").alias("tree_key"),
        F.concat(F.lit(C.DIR_ICON + " "), P.name(F.col("repo_id"))).alias("line"),
    )
    return roots.unionByName(body)
