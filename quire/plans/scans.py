"""Queries of sources and sinks."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import html as H
from quire.functions import notebooks as N
from quire.functions import text as T
from quire.operators import diff as D
from quire.operators import render as R
from quire.operators import snapshot as S
from quire.operators.filters import explicit_files as semi
from quire.operators.filters import is_text
from quire.operators.modes import processed_files
from quire.plans import inputs as I
from quire.plans import sql as Q
from quire.plans.packs import DEFAULT, SHOWN, parts_sql
from quire.plans.registry import query
from quire.session import new_folder
from quire.sources import files as FS
from quire.sources import rules as RU
from quire.sources import tables as TB
from quire.sources.tree import register


@query("scan_files")
def scan_files(spark, sf_dir):
    """The data folder itself as a file corpus."""
    roots = spark.createDataFrame([("data", f"file://{os.path.abspath(sf_dir)}")], "repo_id string, root string")
    rows = FS.read_files(FS.list_files(roots), held_bytes=C.SNIFF_BYTES)
    textual = is_text(F.col("path"), F.col("size"), F.col("content"))
    return rows.select("repo_id", "path", "size", textual.alias("is_text"), "sha256")


@query("scan_tree")
def scan_tree(spark, sf_dir):
    """The data folder through the data source, with filters that its listing answers."""
    register(spark)
    files = spark.read.format("file_tree").options(root=f"file://{os.path.abspath(sf_dir)}", repo_id="data", contents="digest").load()
    named = files.filter(F.col("path").endswith(".parquet") & (F.col("size") > 0))
    return named.select("repo_id", "path", "size", "sha256")


@query("scan_table", f"select repo_id, path, content from {I.FILES_SQL}")
def scan_table(spark, sf_dir):
    return I.files(spark, sf_dir).select("repo_id", "path", "content")


@query(
    "explicit_files",
    f"select repo_id, path from {I.FILES_SQL} where doc_id in (select doc_id from labels where quality = 1)",
)
def explicit_files(spark, sf_dir):
    files = I.files(spark, sf_dir)
    good = I.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    chosen = files.select("repo_id", "path", "doc_id").join(good, "doc_id", "left_semi")
    return semi(files, chosen).select("repo_id", "path")


LISTING = """case doc_id % 6 when 0 then 'node_modules/' when 1 then '.vscode/x/' when 2 then 'build/' else '' end
  || source || case when doc_id % 9 = 0 then '' else '/doc_' || cast(doc_id as {S}) ||
    case doc_id % 5 when 0 then '.py' when 1 then '.PY' when 2 then '.txt' when 3 then '.yml' else '' end end"""


@query(
    "repo_listing",
    f"""select path from (select {LISTING.format(S='varchar')} as path,
        case when doc_id % 9 = 0 then 'dir' else 'file' end as type from documents) l
      where type = 'file' and lower(ltrim({Q.suffix('path')}, '.')) in ({Q.quoted(C.FENCE_LANGUAGES)})
        and not list_has_any({Q.dir_parts('path')}, [{Q.quoted(C.LISTING_EXCLUDED_DIRS)}])""",
)
def repo_listing(spark, sf_dir):
    listing = I.table(spark, sf_dir, "documents").select(
        F.expr(LISTING.format(S="string")).alias("path"),
        F.when(F.col("doc_id") % 9 == 0, "dir").otherwise("file").alias("type"),
    )
    return TB.listed_repository(listing).select("path")


@query("pages_text", f"select url as source, {Q.html_text('html')} as content from pages")
def pages_text(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select(F.col("url").alias("source"), "html")
    return H.with_page_text(pages, text="content").drop("html")


ORDERED = """select conv_id, turn // 1024 as part, string_agg({text}, ' ' order by turn) as text
  from conversations group by conv_id, turn // 1024"""


@query("transcript_text", ORDERED.format(text="coalesce(text, '')"))
def transcript_text(spark, sf_dir):
    return TB.ordered_text(I.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("paged_text", ORDERED.format(text="case when turn % 3 = 1 then '' else text end"))
def paged_text(spark, sf_dir):
    """Pages without text are null and keep their separator."""
    paged = I.table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 != 1, F.col("text")))
    return TB.ordered_text(paged, "conv_id", "turn", "text")


@query(
    "notebook_script",
    f"""select conv_id, {Q.strip("string_agg(text, chr(10) || chr(10) order by turn) filter (where role <> 'user')")} as script,
        cast(count(*) filter (where role <> 'user') as bigint) as code_cells
      from conversations group by conv_id""",
)
def notebook_script(spark, sf_dir):
    return I.conversations_as_notebooks(spark, sf_dir).select(
        "conv_id",
        N.notebook_code("content").alias("script"),
        N.code_cell_count("content").alias("code_cells"),
    )


@query(
    "ignore_rules",
    rf"select repo_id, ordinal, pattern, negated, '\A' || regex || '\z' as regex from {I.RULES_SQL}",
)
def ignore_rules(spark, sf_dir):
    return RU.ignore_rules(I.ignore_files(spark, sf_dir))


MANIFEST_SQL = f"""select repo_id, path, cast(strlen(content) as bigint) as size, sha256(content) as sha256,
  {Q.is_text('path', 'strlen(content)')} as is_text,
  case when {Q.is_text('path', 'strlen(content)')}
    then {Q.normalized('content')} end as content"""


def stored_snapshot(spark, sf_dir):
    folder = new_folder(spark, "snapshot")
    rows = S.manifest_rows(I.raw(I.prev_state(spark, sf_dir)))
    S.write_snapshot(rows, folder, "first")
    S.write_snapshot(S.manifest_rows(I.raw(I.curr_state(spark, sf_dir))), folder, "second")
    return folder


@query("read_snapshot", f"{MANIFEST_SQL} from {I.STATE_SQL['prev']}")
def read_snapshot(spark, sf_dir):
    """Two snapshots are stored; one is read back."""
    folder = stored_snapshot(spark, sf_dir)
    return S.read_snapshot(spark, folder, "first").drop("snapshot_id", "mtime")


@query(
    "write_snapshot",
    f"select 'first' as snapshot_id, count(*) as files, cast(sum(strlen(content)) as bigint) as bytes from {I.STATE_SQL['prev']}"
    f" union all select 'second', count(*), cast(sum(strlen(content)) as bigint) from {I.STATE_SQL['curr']}",
)
def write_snapshot(spark, sf_dir):
    folder = stored_snapshot(spark, sf_dir)
    ids = S.snapshot_ids(spark, folder)
    stored = reduce(DataFrame.unionByName, [S.read_snapshot(spark, folder, i) for i in ids])
    headers = reduce(DataFrame.unionByName, [S.read_header(spark, folder, i) for i in ids])
    headers = headers.filter(F.col("schema_version") == C.SNAPSHOT_SCHEMA_VERSION)
    sizes = stored.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return sizes.join(headers.select("snapshot_id"), "snapshot_id")


@query(
    "write_pack",
    parts_sql(SHOWN, DEFAULT, False)
    + " select repo_id, cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines from parts group by repo_id",
)
def write_pack(spark, sf_dir):
    """Packs written as text and read back: lines per repository."""
    folder = new_folder(spark, "pack")
    R.write_pack(R.pack_parts(processed_files(I.files(spark, sf_dir))), folder)
    return spark.read.text(folder).groupBy("repo_id").agg(F.count(F.lit(1)).alias("lines"))


@query("write_diff")
def write_diff(spark, sf_dir):
    """Diff reports written as text and read back: lines per repository."""
    folder = new_folder(spark, "diff")
    prev = S.manifest_rows(I.raw(I.prev_state(spark, sf_dir)))
    curr = S.manifest_rows(I.raw(I.curr_state(spark, sf_dir)))
    texts = D.diff_texts(D.text_pairs(prev, curr))
    D.write_report(D.report_lines(D.status(prev, curr), texts), folder)
    return spark.read.text(folder).groupBy("repo_id").agg(F.count(F.lit(1)).alias("lines"))
