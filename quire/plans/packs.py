"""Queries of trees, document indexes and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.operators import render as R
from quire.operators import tree as TR
from quire.operators.modes import processed_files
from quire.options import PackOptions
from quire.plans import inputs as I
from quire.plans import sql as Q
from quire.plans.registry import query

KEYS = ("repo_id", "path")


def nodes_sql(files: str) -> str:
    return f"""(select repo_id, path, max(is_dir) as is_dir, {Q.parent('path')} as parent, {Q.parts('path')}[-1] as name,
      cast(len({Q.parts('path')}) as integer) as depth from (
        select repo_id, path, false as is_dir from {files} f
        union all select repo_id, unnest({Q.ancestors('path')}), true from {files} f) n
      group by repo_id, path)"""


NODES = nodes_sql(I.FILES_SQL)
SIBLINGS = "not is_dir, lower(name), name"


def nodes(spark, sf_dir):
    return TR.tree_nodes(I.files(spark, sf_dir))


@query("tree_nodes", f"select repo_id, path, parent, name, depth, is_dir from {NODES}")
def tree_nodes(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(
    "tree_last_child",
    f"select repo_id, path, lead(name) over (partition by repo_id, parent order by {SIBLINGS}) is null as is_last from {NODES}",
)
def tree_last_child(spark, sf_dir):
    return TR.last_children(nodes(spark, sf_dir)).select(*KEYS, "is_last")


def limited_sql(nodes: str, limit: int) -> str:
    return f"""(select repo_id, path, parent, name, depth, is_dir, false as placeholder from {nodes} n where depth <= {limit}
      union all select repo_id, path || '/{C.DEPTH_PLACEHOLDER}', path, '{C.DEPTH_PLACEHOLDER}', depth + 1, false, true
        from {nodes} n where depth = {limit} and is_dir)"""


@query("tree_depth_limit", f"select repo_id, path, parent, name, depth, is_dir, placeholder from {limited_sql(NODES, 2)}")
def tree_depth_limit(spark, sf_dir):
    return TR.limited_depth(nodes(spark, sf_dir), 2)


def ranked(order: str) -> str:
    return f"select repo_id, path, row_number() over (partition by repo_id, parent order by {order}) as rank from {NODES}"


def rank_in_directory(spark, sf_dir, listing):
    """Place among siblings, from the printed order of the whole tree."""
    from quire.operators.skew import positions

    key = (TR.listing_key if listing else TR.sibling_key)(F.col("name"), F.col("is_dir"))
    rows = nodes(spark, sf_dir).withColumn("key", key)
    placed = positions(rows, ["repo_id", "parent"], ["key", "path"])
    return placed.select(*KEYS, F.col("position").alias("rank"))


@query("tree_order", ranked(SIBLINGS))
def tree_order(spark, sf_dir):
    return rank_in_directory(spark, sf_dir, False)


@query("tree_order_listing", ranked("name"))
def tree_order_listing(spark, sf_dir):
    return rank_in_directory(spark, sf_dir, True)


SHOWN = f"(select * from {I.FILES_SQL} where not ({Q.hidden(Q.parts('path'))} or {Q.built(Q.parts('path'))}))"


def lines_sql(files: str, limit: int) -> str:
    """Tree lines with their printed order, by a walk from the top."""
    return f"""(with recursive n as (
        select *, lead(name) over (partition by repo_id, parent order by {SIBLINGS}) is null as is_last,
          lpad(cast(row_number() over (partition by repo_id, parent order by {SIBLINGS}) as varchar), 9, '0') as place
        from {limited_sql(nodes_sql(files), limit)} l),
      w as (select repo_id, path, is_dir, placeholder, name, is_last, place as ord, '' as guide from n where parent = ''
        union all
        select n.repo_id, n.path, n.is_dir, n.placeholder, n.name, n.is_last, w.ord || '/' || n.place,
          w.guide || case when w.is_last then '    ' else '│   ' end
        from n join w on n.repo_id = w.repo_id and n.parent = w.path)
      select repo_id, ord, guide || case when is_last then '└── ' else '├── ' end
        || case when placeholder then '' when is_dir then '{C.DIR_ICON} ' else '{C.FILE_ICON} ' end || name as line from w
      union all select distinct repo_id, '', '{C.DIR_ICON} ' || repo_id from {files} f)"""


@query(
    "tree_render",
    f"select repo_id, row_number() over (partition by repo_id order by ord) as line_no, line from {lines_sql(SHOWN, 5)} t",
)
def tree_render(spark, sf_dir):
    from quire.operators.skew import positions

    lines = TR.tree_lines(TR.visible(I.files(spark, sf_dir)))
    # The line rides along as the last, already decided, order column.
    placed = positions(lines, ["repo_id"], ["tree_key", "line"])
    return placed.select("repo_id", F.col("position").alias("line_no"), "line")


PROCESSED = f"""(select repo_id, path, {Q.fence_lang('path')} as lang,
  {Q.rstrip_newlines(Q.normalized('content'))} as content from {I.FILES_SQL})"""
INDEX = "row_number() over (partition by repo_id order by string_split(path, '/'))"


def processed(spark, sf_dir, options=PackOptions()):
    return processed_files(I.files(spark, sf_dir), options)


def summaries(spark, sf_dir):
    """Stand-in summaries of the Python files."""
    rows = I.files(spark, sf_dir).filter(F.endswith(F.lower("path"), F.lit(".py")))
    return rows.select(*KEYS, F.concat(F.lit("# File: "), "path").alias("summary"))


IS_SUMMARY = "ends_with(lower(path), '.py')"


@query(
    "doc_index",
    f"""select repo_id, path, case when not {IS_SUMMARY} then
          count(*) filter (where not {IS_SUMMARY}) over (partition by repo_id order by string_split(path, '/')) end as doc_index
        from {I.FILES_SQL}""",
)
def doc_index(spark, sf_dir):
    rows = processed_files(I.files(spark, sf_dir), PackOptions(compress=True), summaries(spark, sf_dir))
    index = R.document_index(rows)
    return (
        rows.select(*KEYS, P.order_key(F.col("path")).alias("key"))
        .join(index, ["repo_id", "key"], "left")
        .select(*KEYS, "doc_index")
    )


XML = """'<document index="' || doc_index || '">' || chr(10) || '<source>' || path || '</source>' || chr(10)
  || '<document_content>' || chr(10) || content || chr(10) || '</document_content>' || chr(10) || '</document>' || chr(10)"""


@query(
    "render_xml",
    f"select repo_id, path, {XML} as text from (select *, {INDEX} as doc_index from {PROCESSED} p) q",
)
def render_xml(spark, sf_dir):
    blocks = R.rendered(processed(spark, sf_dir), PackOptions(output_format="cxml"))
    return blocks.select("repo_id", F.replace("key", F.lit("\0"), F.lit("/")).alias("path"), "text")


@query(
    "render_summary_rows",
    f"select repo_id, path, '# File: ' || path || chr(10) as text from {I.FILES_SQL} where {IS_SUMMARY}",
)
def render_summary_rows(spark, sf_dir):
    options = PackOptions(compress=True, output_format="cxml")
    rows = processed_files(I.files(spark, sf_dir), options, summaries(spark, sf_dir))
    blocks = R.rendered(rows, options).withColumn("path", F.replace("key", F.lit("\0"), F.lit("/")))
    return blocks.join(rows.filter("is_summary").select(*KEYS), list(KEYS), "left_semi").select(*KEYS, "text")


def pack_sql(files: str, block: str, xml: bool, segment_bytes: int, extra: str = "") -> str:
    """Packs cut into segments: a part belongs where its first byte falls."""
    return f"""{parts_sql(files, block, xml, extra)},
      placed as (select *, sum(strlen(text) + 1) over (partition by repo_id order by section, key) - strlen(text) - 1 as start from parts),
      cut as (select *, cast(start // {segment_bytes} as bigint) as segment from placed)
    select repo_id, segment, count(*) as n_parts,
      case when segment = max(segment) over (partition by repo_id)
        then regexp_replace(string_agg(text, chr(10) order by section, key), '[{C.SPACES}]+$', '')
        else string_agg(text, chr(10) order by section, key) end as text
    from cut group by repo_id, segment"""


def parts_sql(files: str, block: str, xml: bool, extra: str = "") -> str:
    """``parts``: the parts of all packs with their order."""
    wrap = """union all select distinct repo_id, 3, [''], '<documents>' from known
              union all select distinct repo_id, 5, [''], '</documents>' from known""" if xml else ""
    return f"""with known as (select distinct repo_id from {I.FILES_SQL} {extra}),
      parts as (
        select repo_id, 0 as section, [''] as key, '{C.TREE_HEADING}' as text from known
        union all select repo_id, 1, [ord], line from {lines_sql(files, 5)} t
        union all select repo_id, 2, [''], chr(10) from known
        {wrap}
        union all select repo_id, 4, string_split(path, '/'), {block} from (select *, {INDEX} as doc_index from {PROCESSED} p) q)"""


DEFAULT = "'Relative File Path: ' || path || chr(10) || chr(10) || '```' || lang || chr(10) || content || chr(10) || '```' || chr(10)"
SEGMENT = 64 * 1024


@query("assemble_pack", pack_sql(SHOWN, DEFAULT, False, SEGMENT))
def assemble_pack(spark, sf_dir):
    """Packs of all repositories; segments are small here so that packs have several."""
    return R.assembled(R.pack_parts(processed(spark, sf_dir)), SEGMENT)


@query("assemble_pack_xml", pack_sql(SHOWN, XML, True, SEGMENT))
def assemble_pack_xml(spark, sf_dir):
    options = PackOptions(output_format="cxml")
    return R.assembled(R.pack_parts(processed(spark, sf_dir), options), SEGMENT)


@query(
    "empty_pack",
    f"""select 'Customer' || c_custkey as repo_id, '{C.NO_FILES_MESSAGE}' as text from customer""",
)
def empty_pack(spark, sf_dir):
    """Repositories without any file: the message stands in for the blocks."""
    none = processed(spark, sf_dir).filter(F.lit(False))
    repos = I.table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer"), "c_custkey").alias("repo_id"))
    parts = R.pack_parts(none, PackOptions(), repos)
    return parts.filter("section = 4").select("repo_id", "text")
