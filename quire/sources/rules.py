"""Ignore rules of each repository, from its root ignore file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import globs as G


def ignore_rules(files: DataFrame) -> DataFrame:
    """``repo_id, ordinal, pattern, negated, regex`` in line order.

    ``content`` is text. Blank lines and comments hold no rule.
    """
    rows = files.filter(F.col("path") == ".gitignore").select(
        "repo_id", F.posexplode(F.split("content", r"\r?\n", -1)).alias("ordinal", "pattern")
    )
    return rows.withColumn("_rule", G.parsed_rule("pattern")).filter("_rule.regex is not null").select(
        "repo_id", "ordinal", "pattern", F.col("_rule.negated").alias("negated"), F.col("_rule.regex").alias("regex")
    )


def keyed_rules(rules: DataFrame) -> DataFrame:
    """``repo_id, ordinal, negated, kind, key, below, regex``: rules by what a path must have to match.

    ``regex`` is null where the key says it all.
    """
    return rules.withColumn("_key", G.rule_key("pattern")).select(
        "repo_id",
        "ordinal",
        "negated",
        *[F.col(f"_key.{c}").alias(c) for c in ("kind", "key", "below")],
        F.when(~F.col("_key.exact"), F.col("regex")).alias("regex"),
    )
