"""URL verdicts by rules and by a path-template tree, in DataFrame operations only.

Every host has a tree of path templates. It is grown level by level, for all hosts
at once: the next segment of each path is a child of the template so far.
Segments that are variable become ``*``: numbers and identifiers by their form, and
rare children of a template with very many. Of the other children those whose
share of labelled rejects does not differ from that of their siblings (a
two-proportion test) are merged into ``*`` as well. A template's purity is its share
of rejects, smoothed towards that of its parent, down from the share over all labelled URLs;
a URL is blocked if the purity of its last template reaches ``reject``.

The labels are what the rules say of the URLs that they fit, or a column of the
input. Levels work on distinct paths with counts, so a host with a third of all
URLs is a third of small rows, and totals combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, bounded
from quire.session import written

#: Host and start of the path, and what is done with them; the longest that fits wins.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
DEPTH = 8
FANOUT = 64
SMOOTHING = 5.0
REJECT = 0.5
Z = 2.58
#: Numbers and hexadecimal or long mixed identifiers, with or without a file ending.
VARIABLE = r"^(?:[0-9]+|[0-9a-f-]{8,}|(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{12,})(\.[A-Za-z]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both are empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_verdicts(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    bad: str | None = None,
    depth: int = DEPTH,
    fanout: int = FANOUT,
    smoothing: float = SMOOTHING,
    reject: float = REJECT,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``: one row per row of ``pages``.

    Needs ``page_id`` and ``url``; other columns are ignored, but for ``bad``, the name
    of a boolean column that labels URLs (null: not labelled). Without it the verdicts of the
    rules are the labels. A null URL and one without ``://`` have an empty host
    and path and are judged like others of that host. ``template`` and ``purity``
    come from the tree also where a rule decides. Segments beyond ``depth`` count as
    one tail. Without any label nothing is blocked but by rules; repeated rows
    count each; an empty table gives an empty table.
    """
    label = pages[f"`{bad}`"].cast("boolean") if bad else F.lit(None).cast("boolean")
    rows = pages.select("page_id", "url", label.alias("label"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "label")
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "label")
    if bad is None:
        rows = rows.withColumn("label", F.col("ruled") == "block")
    paths = written(
        rows.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("label").alias("l"),
            F.sum(F.coalesce(F.col("label").cast("int"), F.lit(0))).alias("b"),
        ),
        "paths",
    )
    judged = bounded(template_tree(paths, depth, fanout, smoothing))
    method = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )


def template_tree(paths: DataFrame, depth: int = DEPTH, fanout: int = FANOUT, smoothing: float = SMOOTHING) -> DataFrame:
    """``host, path, template, purity`` of distinct paths with ``n`` URLs, ``l`` of them labelled, ``b`` rejects."""
    base = paths.agg(F.sum("l"), F.sum("b")).first()
    share = (base[1] or 0) / base[0] if base[0] else 0.0

    def smooth(b: Column, labelled: Column, prior: Column) -> Column:
        return (b + smoothing * prior) / (labelled + smoothing)

    segments = F.split(F.regexp_replace("path", "^/", ""), "/", depth)
    hosts = paths.groupBy("host").agg(smooth(F.sum("b"), F.sum("l"), F.lit(share)).alias("purity"))
    rows = paths.join(bounded(hosts), "host").select(
        "host", "path", "n", "l", "b", F.lit("").alias("template"), "purity",
        F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments).alias("rest"),
    )
    rows = written(rows, "level")
    levels, done = 0, None
    while True:
        ended = rows.filter("size(rest) = 0").select("host", "path", "template", "purity")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter("size(rest) > 0")
        if levels == depth or rows.isEmpty():
            return done
        rows = written(_next_level(rows, fanout, smooth), "level")
        levels += 1


def _next_level(rows: DataFrame, fanout: int, smooth) -> DataFrame:
    first = F.col("rest")[0]
    ending = F.regexp_extract(first, VARIABLE, 1)
    child = F.when(first.rlike(VARIABLE), F.concat(F.lit("*"), ending)).otherwise(first)
    rows = rows.withColumn("child", child)
    children = written(
        rows.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b")), "children"
    )
    parents = children.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb")
    )
    both = children.join(bounded(parents), ["host", "template"])
    # Against the siblings: rejects of one child and of all others.
    ol, ob = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
    pooled = F.try_divide("pb", "pl")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), ol)))
    differs = (error > 0) & (F.abs(F.try_divide("b", "l") - F.try_divide(ob, ol)) > Z * error)
    rare = (F.col("k") > fanout) & (F.col("n") * fanout < F.col("pn"))
    named = F.when(F.coalesce(differs, F.lit(False)) & ~rare, F.col("child")).otherwise(F.lit("*"))
    named = both.select("host", "template", "child", "l", "b", named.alias("name"))
    totals = named.groupBy("host", "template", "name").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
    decided = named.drop("l", "b").join(bounded(totals), ["host", "template", "name"])
    out = rows.join(bounded(written(decided, "decided")), ["host", "template", "child"])
    return out.select(
        "host", "path", "n", "l", "b", F.concat("template", F.lit("/"), "name").alias("template"),
        smooth(F.col("tb"), F.col("tl"), F.col("purity")).alias("purity"),
        F.expr("slice(rest, 2, size(rest))").alias("rest"),
    )
