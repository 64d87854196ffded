"""Queries of the inclusion filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import globs as G
from quire.functions import paths as P
from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import filters as FL
from quire.operators import snapshot as S
from quire.operators.modes import limited_read
from quire.options import PackOptions, SnapshotOptions
from quire.plans import inputs as I
from quire.plans import sql as Q
from quire.plans.registry import query
from quire.sources import rules as RU

KEYS = ("repo_id", "path")
FROM = f"select repo_id, path from {I.FILES_SQL}"


@query("skip_hidden", f"{FROM} where not ({Q.hidden(Q.dir_parts('path'))})")
def skip_hidden(spark, sf_dir):
    return I.files(spark, sf_dir).filter(~P.has_hidden(P.dir_parts(F.col("path")))).select(*KEYS)


@query("skip_build_dirs", f"{FROM} where not ({Q.built(Q.dir_parts('path'))})")
def skip_build_dirs(spark, sf_dir):
    return I.files(spark, sf_dir).filter(~P.has_part(P.dir_parts(F.col("path")), C.SKIPPED_DIRS)).select(*KEYS)


# --- patterns of one repository, with the regular expression of each ----------
PATTERNS = {
    "# comment": None,
    "*.csv": r"(?:.+/)?[^/]*\.csv(?:/.*)?",
    "/build/": r"build/.*",
    "docs/en": r"docs/en(?:/.*)?",
    "!docs/en/doc_1*.md": r"docs/en/doc_1[^/]*\.md(?:/.*)?",
    "**/de/*.js": r"(?:.+/)?de/[^/]*\.js",
    "doc_?[0-4].py": r"(?:.+/)?doc_[^/][0-4]\.py(?:/.*)?",
    "!doc_?[!1-3].py": r"(?:.+/)?doc_[^/][^1-3]\.py(?:/.*)?",
    "docs/**/doc_9*": r"docs/(?:.+/)?doc_9[^/]*(?:/.*)?",
}
LAST_MATCH = "case " + " ".join(
    f"when regexp_full_match(path, '{regex}') then {'false' if line.startswith('!') else 'true'}"
    for line, regex in reversed(PATTERNS.items())
    if regex
) + " else false end"


@query("gitignore_filter", f"{FROM} where not ({LAST_MATCH})")
def gitignore_filter(spark, sf_dir):
    return I.files(spark, sf_dir).filter(~G.matches_any(F.col("path"), PATTERNS)).select(*KEYS)


EXCLUDE = {"docs/de/*": r"docs/de/[^/]*(?:/.*)?", "build": r"(?:.+/)?build(?:/.*)?", "*.json": r"(?:.+/)?[^/]*\.json(?:/.*)?"}
INCLUDE = {"*.md": r"(?:.+/)?[^/]*\.md(?:/.*)?", "docs/fr/": r"docs/fr/.*", "doc_?.*": r"(?:.+/)?doc_[^/]\.[^/]*(?:/.*)?"}


def any_of(patterns: dict[str, str]) -> str:
    return "(" + " or ".join(f"regexp_full_match(path, '{r}')" for r in patterns.values()) + ")"


@query("exclude_globs", f"{FROM} where not {any_of(EXCLUDE)}")
def exclude_globs(spark, sf_dir):
    return I.files(spark, sf_dir).filter(~G.matches_any(F.col("path"), EXCLUDE)).select(*KEYS)


@query("include_globs", f"{FROM} where {any_of(INCLUDE)}")
def include_globs(spark, sf_dir):
    return I.files(spark, sf_dir).filter(FL.included_by_globs(F.col("path"), INCLUDE)).select(*KEYS)


def with_nul(files):
    """Every ninth file starts with a NUL byte."""
    return files.withColumn(
        "content", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("\0"), "content")).otherwise(F.col("content"))
    )


NUL_SIZE = "strlen(content) + case when doc_id % 9 = 0 then 1 else 0 end"


@query("is_text", f"select repo_id, path, {Q.is_text('path', NUL_SIZE, 'doc_id % 9 = 0')} as is_text from {I.FILES_SQL}")
def is_text(spark, sf_dir):
    raw = I.raw(with_nul(I.files(spark, sf_dir)))
    return raw.select(*KEYS, FL.is_text(F.col("path"), F.col("size"), F.col("content")).alias("is_text"))


@query("reject_nul", f"{FROM} where doc_id % 9 <> 0")
def reject_nul(spark, sf_dir):
    """A limited read gives nothing if what it keeps has a NUL."""
    files = with_nul(I.files(spark, sf_dir))
    return files.filter(limited_read(F.col("content"), 20, None).isNotNull()).select(*KEYS)


@query("drop_blank", f"{FROM} where regexp_matches(case when doc_id % 4 = 0 then chr(10) || ' ' || chr(9) else content end, '[^{C.SPACES}]')")
def drop_blank(spark, sf_dir):
    files = I.files(spark, sf_dir).withColumn(
        "content", F.when(F.col("doc_id") % 4 == 0, "\n \t").otherwise(F.col("content"))
    )
    return files.filter(~T.is_blank(F.col("content"))).select(*KEYS)


@query("allowed_ext", f"{FROM} where lower(ltrim({Q.suffix('path')}, '.')) in ({Q.quoted(C.FENCE_LANGUAGES)})")
def allowed_ext(spark, sf_dir):
    bare = F.lower(F.regexp_replace(P.suffix(F.col("path")), r"\A\.", ""))
    return I.files(spark, sf_dir).filter(bare.isin(*C.FENCE_LANGUAGES)).select(*KEYS)


IGNORED_SQL = f"""(select f.repo_id, f.path, arg_max(not r.negated, r.ordinal) as ignored
  from {I.FILES_SQL} f join {I.RULES_SQL} r on f.repo_id = r.repo_id and regexp_full_match(f.path, r.regex)
  group by f.repo_id, f.path)"""


@query(
    "gitignore_multi_repo",
    f"""select f.repo_id, f.path from {I.FILES_SQL} f left join {IGNORED_SQL} g
        on f.repo_id = g.repo_id and f.path = g.path where not coalesce(g.ignored, false)""",
)
def gitignore_multi_repo(spark, sf_dir):
    rules = RU.ignore_rules(I.ignore_files(spark, sf_dir))
    return FL.drop_ignored(I.files(spark, sf_dir).select(*KEYS), rules)


INCLUDED_SQL = f"""select f.repo_id, f.path from {I.FILES_SQL} f left join {IGNORED_SQL} g
    on f.repo_id = g.repo_id and f.path = g.path
  where not coalesce(g.ignored, false) and not {Q.skipped_dir('f.path')}
    and {Q.is_text('f.path', NUL_SIZE.replace('content', 'f.content'), 'doc_id % 9 = 0')}
    and not {any_of(EXCLUDE).replace('(path', '(f.path')} and {any_of(INCLUDE).replace('(path', '(f.path')}"""


@query("included_files", INCLUDED_SQL)
def included_files(spark, sf_dir):
    options = PackOptions(include_patterns=tuple(INCLUDE), exclude_patterns=tuple(EXCLUDE))
    rules = RU.ignore_rules(I.ignore_files(spark, sf_dir))
    raw = I.raw(with_nul(I.files(spark, sf_dir)))
    return FL.included_files(raw, options, rules).select(*KEYS)


@query(
    "is_url",
    """select page_id, case page_id % 4 when 0 then false when 1 then false else true end as is_url from pages""",
)
def is_url(spark, sf_dir):
    """Links with the scheme cut off, with the host cut off, and whole ones."""
    link = (
        F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?://", ""))
        .when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^(https?:)//[^/]*", "$1"))
        .otherwise(F.col("url"))
    )
    return I.table(spark, sf_dir, "pages").select("page_id", U.is_url(link).alias("is_url"))


LIMITS = SnapshotOptions(max_bytes=4000, max_lines=12)


@query(
    "snapshot_inline",
    f"""select repo_id, path, (strlen(content) <= 4000 and len(regexp_extract_all({Q.normalized('content')}, '[^\\n]*\\n|[^\\n]+')) <= 12
        and {Q.is_text('path', 'strlen(content)')}) as inlined from {I.FILES_SQL}""",
)
def snapshot_inline(spark, sf_dir):
    rows = S.manifest_rows(I.raw(I.files(spark, sf_dir)), LIMITS)
    return rows.select(*KEYS, F.col("content").isNotNull().alias("inlined"))
