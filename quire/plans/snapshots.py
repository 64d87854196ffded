"""Queries of manifests and of differences between two states."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import constants as C
from quire.operators import diff as D
from quire.operators import snapshot as S
from quire.operators.skew import positions
from quire.options import SnapshotOptions
from quire.plans import inputs as I
from quire.plans import sql as Q
from quire.plans.filters import EXCLUDE, INCLUDE, any_of
from quire.plans.registry import query
from quire.plans.scans import MANIFEST_SQL
from quire.session import new_folder

PREV, CURR = I.STATE_SQL["prev"], I.STATE_SQL["curr"]
STATUS_SQL = f"""(select coalesce(p.repo_id, c.repo_id) as repo_id, coalesce(p.path, c.path) as path,
    case when p.path is null then 'A' when c.path is null then 'D' when p.content <> c.content then 'M' else 'U' end as status,
    p.content as old_text, c.content as new_text
  from {PREV} p full join {CURR} c on p.repo_id = c.repo_id and p.path = c.path)"""


def states(spark, sf_dir):
    return (
        S.manifest_rows(I.raw(I.prev_state(spark, sf_dir))),
        S.manifest_rows(I.raw(I.curr_state(spark, sf_dir))),
    )


FILTERED = SnapshotOptions(include_patterns=tuple(INCLUDE), exclude_patterns=tuple(EXCLUDE), respect_gitignore=False)
FILTERED_WHERE = f"""where not {Q.skipped_dir('path')} and {Q.is_text('path', 'strlen(content)')}
  and not {any_of(EXCLUDE)} and {any_of(INCLUDE)}"""


@query("snapshot_manifest", f"{MANIFEST_SQL} from {PREV} {FILTERED_WHERE}")
def snapshot_manifest(spark, sf_dir):
    return S.manifest(I.raw(I.prev_state(spark, sf_dir)), FILTERED).drop("mtime")


@query(
    "diff_same_filters",
    f"""select coalesce(p.repo_id, c.repo_id) as repo_id, coalesce(p.path, c.path) as path,
          case when p.path is null then 'A' when c.path is null then 'D' when p.content <> c.content then 'M' else 'U' end as status
        from (select * from {PREV} {FILTERED_WHERE}) p full join (select * from {CURR} {FILTERED_WHERE}) c
          on p.repo_id = c.repo_id and p.path = c.path""",
)
def diff_same_filters(spark, sf_dir):
    """The settings come from the stored header."""
    folder = new_folder(spark, "snapshot")
    S.write_snapshot(S.manifest(I.raw(I.prev_state(spark, sf_dir)), FILTERED), folder, "first", FILTERED)
    stored = S.read_options(spark, folder, "first")
    current = S.manifest(I.raw(I.curr_state(spark, sf_dir)), stored)
    return D.status(S.read_snapshot(spark, folder, "first"), current)


@query("diff_status", f"select repo_id, path, status from {STATUS_SQL}")
def diff_status(spark, sf_dir):
    return D.status(*states(spark, sf_dir))


@query(
    "diff_order",
    f"select repo_id, status, path, row_number() over (partition by repo_id, status order by path) as position from {STATUS_SQL} where status <> 'U'",
)
def diff_order(spark, sf_dir):
    rows = D.status(*states(spark, sf_dir)).filter("status <> 'U'")
    return positions(rows, ["repo_id", "status"], ["path"])


@query("diff_added", f"select repo_id, path from {STATUS_SQL} where status = 'A'")
def diff_added(spark, sf_dir):
    return D.added(*states(spark, sf_dir))


@query("diff_deleted", f"select repo_id, path from {STATUS_SQL} where status = 'D'")
def diff_deleted(spark, sf_dir):
    return D.deleted(*states(spark, sf_dir))


@query("diff_modified", f"select repo_id, path from {STATUS_SQL} where status = 'M'")
def diff_modified(spark, sf_dir):
    return D.modified(*states(spark, sf_dir))


@query(
    "paths_except",
    f"""select 'added' as side, repo_id, path from (select repo_id, path from {CURR} except select repo_id, path from {PREV})
        union all select 'deleted', repo_id, path from (select repo_id, path from {PREV} except select repo_id, path from {CURR})""",
)
def paths_except(spark, sf_dir):
    prev, curr = (s.select(*D.KEYS) for s in states(spark, sf_dir))
    added, deleted = curr.subtract(prev), prev.subtract(curr)
    return added.withColumn("side", F.lit("added")).unionByName(deleted.withColumn("side", F.lit("deleted")))


@query("paths_intersect", f"select repo_id, path from {CURR} intersect select repo_id, path from {PREV}")
def paths_intersect(spark, sf_dir):
    prev, curr = (s.select(*D.KEYS) for s in states(spark, sf_dir))
    return prev.intersect(curr)


TEXT = Q.is_text("path", "strlen(old_text)")
TEXT_NEW = Q.is_text("path", "strlen(new_text)")
PAIRS = f"""(select repo_id, path, {TEXT} as old_is_text, {TEXT_NEW} as new_is_text, {TEXT} as old_available, {TEXT_NEW} as new_available,
    case when {TEXT} then {Q.normalized('old_text')} else '' end as old_text,
    case when {TEXT_NEW} then {Q.normalized('new_text')} else '' end as new_text
  from {STATUS_SQL} where status = 'M')"""


def pairs(spark, sf_dir):
    return D.text_pairs(*states(spark, sf_dir))


@query("diff_text_pairs", f"select * from {PAIRS}")
def diff_text_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(
    "diff_line_stats",
    f"""with sides as (
          select repo_id, path, unnest({{old}}) as line, -1 as n from {PAIRS} where old_text <> ''
          union all select repo_id, path, unnest({{new}}), 1 from {PAIRS} where new_text <> ''),
        net as (select repo_id, path, line, sum(n) as n from sides group by repo_id, path, line)
      select p.repo_id, p.path, cast(coalesce(sum(n) filter (where n > 0), 0) as bigint) as lines_added,
        cast(coalesce(-sum(n) filter (where n < 0), 0) as bigint) as lines_removed
      from {PAIRS} p left join net s on p.repo_id = s.repo_id and p.path = s.path group by p.repo_id, p.path""".format(
        **{
            side: f"string_split(regexp_replace(regexp_replace({side}_text, '\\r\\n|[{C.BREAKS}]', chr(10), 'g'), '\\n$', ''), chr(10))"
            for side in ("old", "new")
        }
    ),
)
def diff_line_stats(spark, sf_dir):
    return D.line_stats(pairs(spark, sf_dir))


@query("diff_unified")
def diff_unified(spark, sf_dir):
    return D.unified(pairs(spark, sf_dir))


CRLF = "replace(content, {lf}, {cr} || {lf})"


@query(
    "diff_special_cases",
    f"""select repo_id, path, kind, case kind when 'binary' then 'Binary files differ: a/' || path || ' b/' || path
          when 'no_textual_change' then 'diff --git a/' || path || ' b/' || path || chr(10) || '{C.NO_TEXT_CHANGE}'
          when 'content_missing' then 'Content not stored: a/' || path || ' b/' || path end as line
        from (select repo_id, path, case when not {Q.is_text('path', '0')} then 'binary'
                when strlen(old) > 6000 then 'content_missing'
                when {Q.normalized('old')} = {Q.normalized('new')} then 'no_textual_change' else 'textual' end as kind
              from (select repo_id, path, content as old,
                      case when doc_id % 2 = 0 then {CRLF.format(lf='chr(10)', cr='chr(13)')} else content || 'x' end as new
                    from {I.FILES_SQL}) s where old <> new) k""",
)
def diff_special_cases(spark, sf_dir):
    """One state has CRLF breaks or one more letter; the old one keeps small texts only."""
    rows = I.files(spark, sf_dir)
    changed = rows.withColumn(
        "content",
        F.when(F.col("doc_id") % 2 == 0, F.expr(CRLF.format(lf="'\n'", cr="'\r'"))).otherwise(
            F.concat("content", F.lit("x"))
        ),
    )
    old = S.manifest_rows(I.raw(rows), SnapshotOptions(max_bytes=6000))
    return D.special_cases(D.text_pairs(old, S.manifest_rows(I.raw(changed))))


SUMMARY = f"""select repo_id, count(*) filter (where status = 'A') as added, count(*) filter (where status = 'D') as deleted,
  count(*) filter (where status = 'M') as modified from {STATUS_SQL} group by repo_id"""


@query("diff_summary", SUMMARY)
def diff_summary(spark, sf_dir):
    return D.summary(D.status(*states(spark, sf_dir)))


SPECIAL_SQL = f"""(select repo_id, path, case when not (old_is_text and new_is_text) then 'Binary files differ: a/' || path || ' b/' || path
    when old_available and old_text = new_text then 'diff --git a/' || path || ' b/' || path || chr(10) || '{C.NO_TEXT_CHANGE}' end as line from {PAIRS})"""
REPORT = f"""(with s as (select repo_id, path, status from {STATUS_SQL}),
    rows as (
      select repo_id, 0 as section, '' as key, 'Diff Summary' || chr(10) || 'Added: ' || added || chr(10) || 'Deleted: ' || deleted
        || chr(10) || 'Modified: ' || modified as line from ({SUMMARY}) m
      union all select repo_id, case status when 'A' then 2 when 'D' then 4 else 6 end, path, status || chr(9) || path from s where status <> 'U'
      union all select repo_id, 8, path, line from {SPECIAL_SQL} where line is not null)
  select * from rows
  union all select distinct repo_id, section - 1, '', chr(10) || case section when 2 then '# Added' when 4 then '# Deleted'
    when 6 then '# Modified' else '# Diffs' end from rows where section > 0)"""


def report_lines(spark, sf_dir):
    """The report with the lines of the special cases as its diffs."""
    prev, curr = states(spark, sf_dir)
    special = D.special_cases(D.text_pairs(prev, curr)).filter("line is not null")
    return D.report_lines(D.status(prev, curr), special.select(*D.KEYS, F.col("line").alias("diff")))


SEGMENT = 2048


@query(
    "diff_report",
    f"""select repo_id, cast(start // {SEGMENT} as bigint) as segment, count(*) as n_parts, string_agg(line, chr(10) order by section, key) as text
        from (select *, sum(strlen(line) + 1) over (partition by repo_id order by section, key) - strlen(line) - 1 as start from {REPORT}) t
        group by repo_id, start // {SEGMENT}""",
)
def diff_report(spark, sf_dir):
    return D.report(report_lines(spark, sf_dir), SEGMENT)


@query("diff_tokens", f"select repo_id, cast(sum({Q.words('line')}) as bigint) as diff_tokens from {REPORT} group by repo_id")
def diff_tokens(spark, sf_dir):
    return D.report_tokens(report_lines(spark, sf_dir))


@query("diff_report_full")
def diff_report_full(spark, sf_dir):
    """The report with unified diffs, as word counts per repository."""
    prev, curr = states(spark, sf_dir)
    return D.report_tokens(D.report_lines(D.status(prev, curr), D.diff_texts(D.text_pairs(prev, curr))))
