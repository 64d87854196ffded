"""Queries of joins on lookups, aggregations, rankings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import paths as P
from quire.operators import analysis as A
from quire.operators import selection as SE
from quire.operators.pack import pack
from quire.operators.skew import lookup_join
from quire.options import PackOptions
from quire.plans import inputs as I
from quire.plans import sql as Q
from quire.plans.filters import EXCLUDE, IGNORED_SQL, any_of
from quire.plans.registry import query
from quire.sources.rules import ignore_rules
from quire.streaming.metrics import measured

KEYS = ("repo_id", "path")
# Words and lines of every file, without the content modes.
MEASURED = f"""(select repo_id, path, {Q.ext('path')} as ext, {Q.words('content')} as tokens, {Q.lines('content')} as lines
  from {I.FILES_SQL})"""
FIRST = "min(string_split(path, '/'))"


def files(spark, sf_dir):
    return measured(I.files(spark, sf_dir))


@query("lang_lookup", f"select repo_id, path, {Q.fence_lang('path')} as lang from {I.FILES_SQL}")
def lang_lookup(spark, sf_dir):
    """The fixed table as a relation, joined by extension."""
    table = spark.createDataFrame(list(C.FENCE_LANGUAGES.items()), "bare string, lang string")
    rows = I.files(spark, sf_dir).select(*KEYS, F.regexp_replace(P.suffix(F.col("path")), r"\A\.", "").alias("bare"))
    return lookup_join(rows, table, ["bare"], ["path"]).select(*KEYS, F.coalesce("lang", F.lit("")).alias("lang"))


@query(
    "overall_stats",
    f"""select count(*) as file_count, cast(sum(tokens) as bigint) as total_tokens, cast(sum(lines) as bigint) as total_lines
        from {MEASURED}""",
)
def overall_stats(spark, sf_dir):
    return A.overall(files(spark, sf_dir))


@query(
    "overall_stats_per_repo",
    f"""select repo_id, count(*) as file_count, cast(sum(tokens) as bigint) as total_tokens, cast(sum(lines) as bigint) as total_lines
        from {MEASURED} group by repo_id""",
)
def overall_stats_per_repo(spark, sf_dir):
    return A.overall(files(spark, sf_dir), "repo_id")


BY_EXT = f"""select ext, count(*) as file_count, cast(sum(tokens) as bigint) as tokens, cast(sum(lines) as bigint) as lines
  from {MEASURED} group by ext"""


@query("by_extension", f"{BY_EXT} order by tokens desc, {FIRST} limit 10")
def by_extension(spark, sf_dir):
    return A.by_extension(files(spark, sf_dir))


@query(
    "avg_tokens_by_ext",
    f"select ext, cast(sum(tokens) as double) / count(*) as avg_tokens, round(cast(sum(tokens) as double) / count(*), 0) as shown from {MEASURED} group by ext",
)
def avg_tokens_by_ext(spark, sf_dir):
    stats = A.extension_stats(files(spark, sf_dir))
    return stats.select("ext", "avg_tokens", F.round("avg_tokens", 0).alias("shown"))


@query("top_extensions", f"select ext, tokens from ({BY_EXT} order by tokens desc, {FIRST} limit 5) t")
def top_extensions(spark, sf_dir):
    return A.by_extension(files(spark, sf_dir), 5).select("ext", "tokens")


@query("pack_tokens", f"select repo_id, cast(sum(tokens) as bigint) as tokens from {MEASURED} group by repo_id")
def pack_tokens(spark, sf_dir):
    return A.overall(files(spark, sf_dir), "repo_id").select("repo_id", F.col("total_tokens").alias("tokens"))


@query(
    "over_token_limit",
    f"select repo_id, cast(sum(tokens) as bigint) as total_tokens, sum(tokens) > 20000 as over_limit from {MEASURED} group by repo_id",
)
def over_token_limit(spark, sf_dir):
    return A.over_token_limit(files(spark, sf_dir), 20_000)


# What is left of the files after all filters: the packed ones.
PACKED_SQL = f"""(select m.repo_id, m.path, m.ext, m.tokens, m.lines from {MEASURED} m
  left join {IGNORED_SQL} g on m.repo_id = g.repo_id and m.path = g.path
  where not coalesce(g.ignored, false) and not {Q.skipped_dir('m.path')} and {Q.is_text('m.path', '0')}
    and not {any_of(EXCLUDE).replace('(path', '(m.path')})"""


def packed(spark, sf_dir, **options):
    """The test files through the whole pack operator, with the rules of their repositories."""
    rules = ignore_rules(I.ignore_files(spark, sf_dir))
    return pack(I.raw(I.files(spark, sf_dir)), PackOptions(exclude_patterns=tuple(EXCLUDE), **options), rules)


@query("files_processed", f"select repo_id, count(*) as files from {PACKED_SQL} group by repo_id")
def files_processed(spark, sf_dir):
    return packed(spark, sf_dir).files_processed()


@query(
    "pack_totals",
    f"""select repo_id, count(*) as file_count, cast(sum(tokens) as bigint) as total_tokens, cast(sum(lines) as bigint) as total_lines,
        sum(tokens) > 9000 as over_limit from {PACKED_SQL} group by repo_id""",
)
def pack_totals(spark, sf_dir):
    return packed(spark, sf_dir, max_tokens=9000).totals()


@query(
    "pack_top_files",
    f"select repo_id, path, tokens, lines from {PACKED_SQL} order by tokens desc, string_split(path, '/'), repo_id limit 25",
)
def pack_top_files(spark, sf_dir):
    return packed(spark, sf_dir, top_n=25).top_files()


@query(
    "pack_by_extension",
    f"""select ext, count(*) as file_count, cast(sum(tokens) as bigint) as tokens, cast(sum(lines) as bigint) as lines
        from {PACKED_SQL} group by ext order by tokens desc, {FIRST} limit 10""",
)
def pack_by_extension(spark, sf_dir):
    return packed(spark, sf_dir).by_extension()


@query(
    "top_files",
    f"select repo_id, path, tokens, lines from {MEASURED} order by tokens desc, string_split(path, '/'), repo_id limit 10",
)
def top_files(spark, sf_dir):
    return A.top_files(files(spark, sf_dir))


@query(
    "top_files_per_repo",
    f"""select * from (select repo_id, path, tokens, lines,
          row_number() over (partition by repo_id order by tokens desc, string_split(path, '/')) as rank from {MEASURED}) t
        where rank <= 3""",
)
def top_files_per_repo(spark, sf_dir):
    return A.top_files_per_repo(files(spark, sf_dir), 3)


ORDERED = "over (partition by repo_id order by string_split(path, '/'))"


@query("path_order", f"select repo_id, path, row_number() {ORDERED} as position from {I.FILES_SQL}")
def path_order(spark, sf_dir):
    return A.path_order(I.files(spark, sf_dir))


@query(
    "token_budget",
    f"""select repo_id, path, position, running_tokens, running_tokens <= 5000 as fits from (
          select repo_id, path, row_number() {ORDERED} as position, cast(sum(tokens) {ORDERED} as bigint) as running_tokens
          from {MEASURED}) t""",
)
def token_budget(spark, sf_dir):
    return A.token_budget(files(spark, sf_dir), 5000)


@query("select_subtree", f"select repo_id, path from {I.SELECTED_SQL}")
def select_subtree(spark, sf_dir):
    return SE.select_subtree(I.files(spark, sf_dir), I.selection(spark, sf_dir))


@query(
    "selection_union",
    f"""select repo_id, path from {I.FILES_SQL} where ends_with(path, '.md')
        union select repo_id, path from {I.SELECTED_SQL}""",
)
def selection_union(spark, sf_dir):
    rows = I.files(spark, sf_dir)
    chosen = SE.select_subtree(rows, I.selection(spark, sf_dir))
    return SE.selection_union(rows.filter(F.endswith("path", F.lit(".md"))), chosen)


@query(
    "selection_status",
    f"""select repo_id, dir, case when count(on_path) = count(*) then 'full' when count(on_path) > 0 then 'partial' else 'none' end as status
        from (select f.repo_id, unnest({Q.ancestors('f.path')}) as dir, s.path as on_path
              from {I.FILES_SQL} f left join {I.SELECTED_SQL} s on f.repo_id = s.repo_id and f.path = s.path) t
        group by repo_id, dir""",
)
def selection_status(spark, sf_dir):
    rows = I.files(spark, sf_dir)
    return SE.selection_status(rows, SE.select_subtree(rows, I.selection(spark, sf_dir)))
