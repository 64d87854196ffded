"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import html as H
from quire.functions import paths as P
from quire.functions import text as T
from quire.functions import tokens as K
from quire.functions import urls as U
from quire.operators import modes as M
from quire.operators import render as R
from quire.options import PackOptions
from quire.plans import inputs as I
from quire.plans import sql as Q
from quire.plans.registry import query

KEYS = ("repo_id", "path")
FILES = I.FILES_SQL


def on_files(name, make, sql):
    """A query that adds one column to the files."""

    @query(name, f"select repo_id, path, {sql} as {name} from {FILES}")
    def run(spark, sf_dir):
        return I.files(spark, sf_dir).select(*KEYS, make().alias(name))


on_files("rel_path", lambda: P.relative_to(F.col("path"), "docs/en"), "case when starts_with(path, 'docs/en/') then substr(path, 9) else path end")
on_files("path_ext", lambda: P.ext(F.col("path")), Q.ext("path"))
on_files("fence_lang", lambda: P.fence_language(F.col("path")), Q.fence_lang("path"))
on_files("line_count", lambda: T.line_count(F.col("content")), Q.lines("content"))
on_files("word_count", lambda: T.word_count(F.col("content")), Q.words("content"))
on_files("content_sha256", lambda: T.sha256(F.col("content").cast("binary")), "sha256(content)")
on_files("head_lines", lambda: T.head_lines(F.col("content"), 3), Q.head_lines("content", 3))
on_files("rstrip_newlines", lambda: T.rstrip_newlines(F.concat(F.col("content"), F.lit("\n\n"))), f"{Q.rstrip_newlines('content')}")

SHEBANG = """case doc_id % 5 when 0 then '#!/usr/bin/env python3' when 1 then '#! /usr/bin/node' when 2 then '#!/bin/sh' else '' end"""


@query(
    "code_lang",
    f"""select repo_id, path, coalesce({Q.lookup(f"lower({Q.suffix('path')})", C.CODE_LANGUAGES)},
        case doc_id % 5 when 0 then 'python' when 1 then 'javascript' end) as code_lang from {FILES}""",
)
def code_lang(spark, sf_dir):
    files = I.files(spark, sf_dir).withColumn("content", F.concat(F.expr(SHEBANG), F.lit("\n"), "content"))
    return files.select(*KEYS, P.code_language(F.col("path"), F.col("content")).alias("code_lang"))


@query("decode_text", f"select repo_id, path, content as text from {FILES}")
def decode_text(spark, sf_dir):
    """Texts that fit Latin-1 are stored so; what is not UTF-8 must be decoded by it."""
    latin = F.rlike(F.col("content"), F.lit(r"\A[\x00-\xFF]*\z"))
    stored = F.when(latin, F.encode(F.col("content"), "ISO-8859-1")).otherwise(F.encode(F.col("content"), "UTF-8"))
    return I.files(spark, sf_dir).select(*KEYS, T.decode(stored).alias("text"))


@query("normalize_newlines", f"select repo_id, path, {Q.normalized('content')} as text from {FILES}")
def normalize_newlines(spark, sf_dir):
    """Breaks are turned into CRLF or CR first."""
    mixed = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.replace(F.col("content"), F.lit("\n"), F.lit("\r"))
    )
    # Texts with breaks of their own kind stay as they are.
    own = F.contains(F.col("content"), F.lit("\r"))
    return I.files(spark, sf_dir).select(
        *KEYS, T.normalize_newlines(F.when(own, F.col("content")).otherwise(mixed)).alias("text")
    )


@query(
    "head_bytes",
    f"""select repo_id, path, coalesce(string_agg(line, '' order by n) filter (where total <= 500), '') as head from (
          select repo_id, path, n, line, sum(strlen(line)) over (partition by repo_id, path order by n) as total from (
            select repo_id, path, unnest(l) as line, unnest(range(1, len(l) + 1)) as n from (
              select repo_id, path, case when content = '' then [''] else regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+') end as l
              from {FILES}) a) b) c
        group by repo_id, path""",
)
def head_bytes(spark, sf_dir):
    return I.files(spark, sf_dir).select(*KEYS, T.head_bytes(F.col("content"), 500).alias("head"))


NUMBERED = r"""array_to_string(list_transform(range(1, {n} + 1), lambda i: lpad(cast(i as varchar), cast(greatest(4, len(cast(i as varchar))) as integer), ' ') || ' | ' || l[i]), chr(10))"""
SPLIT = (
    f"case when content = '' then cast([] as varchar[]) else string_split(regexp_replace(regexp_replace(content, '\\r\\n|[{C.BREAKS}]', chr(10), 'g'), '\\n$', ''), chr(10)) end"
)


@query("number_lines", f"select repo_id, path, {NUMBERED.format(n='len(l)')} as numbered from (select repo_id, path, {SPLIT} as l from {FILES}) f")
def number_lines(spark, sf_dir):
    return I.files(spark, sf_dir).select(*KEYS, T.number_lines(F.col("content")).alias("numbered"))


@query(
    "sample_data_files",
    f"""select repo_id, path, {Q.rstrip_newlines(Q.head_lines(Q.normalized('content'), 5))} || chr(10) || chr(10) ||
        '... (Data file content truncated to first 5 lines)' as content,
        len(regexp_extract_all({Q.normalized('content')}, '[^\\n]*\\n|[^\\n]+')) > 5 as was_truncated
      from {FILES} where lower({Q.suffix('path')}) in ('.csv', '.json', '.jsonl')""",
)
def sample_data_files(spark, sf_dir):
    rows = M.processed_files(I.files(spark, sf_dir), PackOptions(data_sample_lines=5)).filter("mode = 'data'")
    return rows.select(*KEYS, "content", "was_truncated")


LIMITED = PackOptions(file_max_lines=4, file_max_bytes=900, data_sample_lines=5)
USER_NOTE = "chr(10) || chr(10) || '... (File content truncated due to limits: 4 lines, 900 bytes)'"


@query(
    "truncation_note",
    f"""select repo_id, path, case when kept <> text then {USER_NOTE} end as note from (
          select repo_id, path, text, coalesce(string_agg(line, '' order by n) filter (where total <= 900 and n <= 4), '') as kept from (
            select *, sum(strlen(line)) over (partition by repo_id, path order by n) as total from (
              select repo_id, path, text, unnest(l) as line, unnest(range(1, len(l) + 1)) as n from (
                select repo_id, path, {Q.normalized('content')} as text,
                  case when content = '' then [''] else regexp_extract_all({Q.normalized('content')}, '[^\\n]*\\n|[^\\n]+') end as l
                from {FILES} where lower({Q.suffix('path')}) not in ('.csv', '.json', '.jsonl')) a) b) c
          group by repo_id, path, text) d""",
)
def truncation_note(spark, sf_dir):
    rows = M.processed_files(I.files(spark, sf_dir), LIMITED).filter("mode <> 'data'")
    note = F.regexp_extract("content", r"(\n\n\.\.\. \(File content truncated due to limits: [^)]*\))\z", 1)
    return rows.select(*KEYS, F.when(F.col("mode") == "limited", note).alias("note"))


@query(
    "content_mode",
    f"""select repo_id, path, case when lower({Q.suffix('path')}) in ('.csv', '.json', '.jsonl') then 'data'
          when len(regexp_extract_all({Q.normalized('content')}, '[^\\n]*\\n|[^\\n]+')) > 4 then 'limited'
          when ends_with(lower(path), '.py') then 'summary' else 'full' end as mode from {FILES}""",
)
def content_mode(spark, sf_dir):
    """Python files have a summary here; it is used unless the file was cut."""
    files = I.files(spark, sf_dir)
    made = files.filter(F.endswith(F.lower(F.col("path")), F.lit(".py"))).select(
        *KEYS, F.concat(F.lit("# "), F.col("path")).alias("summary")
    )
    options = PackOptions(file_max_lines=4, compress=True, data_sample_lines=5)
    return M.processed_files(files, options, made).select(*KEYS, "mode")


# The pattern in a dialect without look-ahead: a mark is put before the last
# blank of a run, which belongs to the word behind it.
BLANK = r"\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INLINE = BLANK.replace(r"\n", "").replace(r"\r", "")
MARKED = rf"regexp_replace(content, '([{BLANK}])([{INLINE}][^{BLANK}])', '\1' || chr(1) || '\2', 'g')"
PIECES = (
    rf"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}\x01]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{BLANK}\p{{L}}\p{{N}}\x01]+[\r\n]*"
    rf"|[{BLANK}]*[\r\n]|[{BLANK}]+"
)


@query(
    "token_count",
    f"""select repo_id, path, cast(len(regexp_extract_all({MARKED}, '{PIECES}')) as bigint) as pretokens, {Q.words('content')} as words
        from {FILES}""",
)
def token_count(spark, sf_dir):
    """Pre-tokens of the public byte-pair pattern, and words."""
    return I.files(spark, sf_dir).select(
        *KEYS, K.token_count(F.col("content"), "pretokens").alias("pretokens"), K.token_count(F.col("content"), "words").alias("words")
    )


@query("html_to_text", f"select page_id, {Q.html_text('html')} as text from pages")
def html_to_text(spark, sf_dir):
    return H.with_page_text(I.table(spark, sf_dir, "pages").select("page_id", "html")).drop("html")


# Links of every kind, made from the keys of the pages.
LINK = """case page_id % 7
  when 0 then 'https://github.com/owner' || page_id || '/repo' || page_id
  when 1 then 'https://github.com/o/r/tree/dev' || page_id || '/src/lib'
  when 2 then 'https://www.youtube.com/watch?v=abc-_' || lpad(cast(page_id as {S}), 6, '0') || '&t=1'
  when 3 then 'https://youtu.be/xyz' || lpad(cast(page_id as {S}), 8, '0')
  when 4 then 'https://arxiv.org/abs/2101.' || lpad(cast(page_id as {S}), 5, '0')
  when 5 then 'http://example.org/files/' || page_id || '.PDF?x=1'
  else url end"""
LINKS = f"(select page_id, {LINK.format(S='varchar')} as url from pages)"


def links(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", F.expr(LINK.format(S="string")).alias("url"))


KIND = "case page_id % 7 when 0 then 'github' when 1 then 'github' when 2 then 'youtube' when 3 then 'youtube' when 4 then 'arxiv' when 5 then 'pdf' else 'web' end"


@query("url_kind", f"select page_id, {KIND} as kind from pages")
def url_kind(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.url_kind(F.col("url")).alias("kind"))


@query(
    "video_id",
    f"select page_id, nullif(regexp_extract(url, '(?:v=|/)([a-zA-Z0-9_-]{{11}})', 1), '') as video_id from {LINKS} where page_id % 7 in (2, 3)",
)
def video_id(spark, sf_dir):
    rows = links(spark, sf_dir).filter(U.url_kind(F.col("url")) == "youtube")
    return rows.select("page_id", U.video_id(F.col("url")).alias("video_id"))


@query(
    "arxiv_pdf_url",
    "select page_id, 'https://arxiv.org/pdf/2101.' || lpad(cast(page_id as varchar), 5, '0') || '.pdf' as pdf_url from pages where page_id % 7 = 4",
)
def arxiv_pdf_url(spark, sf_dir):
    rows = links(spark, sf_dir).filter(U.url_kind(F.col("url")) == "arxiv")
    return rows.select("page_id", U.abstract_pdf_url(F.col("url")).alias("pdf_url"))


@query(
    "repo_url_parts",
    """select page_id, case page_id % 7 when 0 then 'owner' || page_id || '/repo' || page_id else 'o/r' end as repo,
         case page_id % 7 when 0 then '' else 'dev' || page_id end as branch,
         case page_id % 7 when 0 then '' else 'src/lib' end as sub_path,
         case page_id % 7 when 0 then 'https://api.github.com/repos/owner' || page_id || '/repo' || page_id || '/contents/'
           else 'https://api.github.com/repos/o/r/contents/src/lib?ref=dev' || page_id end as listing_url
       from pages where page_id % 7 in (0, 1)""",
)
def repo_url_parts(spark, sf_dir):
    rows = links(spark, sf_dir).filter(U.url_kind(F.col("url")) == "github")
    return rows.select("page_id", F.inline(F.array(U.repo_parts(F.col("url")))))


MIME = """case page_id % 4 when 0 then 'text/HTML; charset=utf-8' when 1 then 'application/pdf' when 2 then 'image/png' else 'text/html' end"""


@query(
    "route_content",
    f"""select page_id, case when page_id % 4 = 1 then 'pdf' when page_id % 4 in (0, 3) then 'html' else 'unsupported' end as route,
        case when page_id % 4 = 2 then 'Error: Unsupported content type ''image/png''' end as error from pages""",
)
def route_content(spark, sf_dir):
    rows = links(spark, sf_dir).withColumn("mime", F.expr(MIME))
    mime, url = F.col("mime"), F.col("url")
    return rows.select("page_id", U.content_route(mime, url).alias("route"), U.route_error(mime, url).alias("error"))


TICKS = "content || repeat('`', cast(doc_id % 6 as int)) || 'x'"


@query("fence_width", f"select repo_id, path, {Q.fence(TICKS)} as fence from {FILES}")
def fence_width(spark, sf_dir):
    return I.files(spark, sf_dir).select(*KEYS, T.fence(F.expr(TICKS)).alias("fence"))


def block_sql(body: str) -> str:
    return f"select repo_id, path, {body} as text from (select repo_id, path, {Q.fence_lang('path')} as lang, {TICKS} as content from {FILES}) f"


def with_ticks(spark, sf_dir):
    return I.files(spark, sf_dir).withColumn("content", F.expr(TICKS)).withColumn("lang", P.fence_language(F.col("path")))


@query(
    "render_default",
    block_sql("'Relative File Path: ' || path || chr(10) || chr(10) || '```' || lang || chr(10) || content || chr(10) || '```' || chr(10)"),
)
def render_default(spark, sf_dir):
    return with_ticks(spark, sf_dir).select(*KEYS, R.default_block(F.col("path"), F.col("lang"), F.col("content")).alias("text"))


@query(
    "render_markdown",
    block_sql(f"'## ' || path || chr(10) || {Q.fence('content')} || lang || chr(10) || content || chr(10) || {Q.fence('content')} || chr(10)"),
)
def render_markdown(spark, sf_dir):
    return with_ticks(spark, sf_dir).select(*KEYS, R.markdown_block(F.col("path"), F.col("lang"), F.col("content")).alias("text"))


@query(
    "render_single",
    "select page_id, 'Source: ' || url || chr(10) || chr(10) || '---' || chr(10) || chr(10) || html as text from pages",
)
def render_single(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", R.single_source(F.col("url"), F.col("html")).alias("text"))


COMMENT = "'/** ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' * @since 1' || chr(10) || ' */'"


@query(
    "clean_comment",
    f"""select doc_id, left(joined, 200) || case when length(joined) > 200 then '...' else '' end as comment from (
          select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
            lambda x: {Q.strip("regexp_replace(" + Q.strip('x') + ", '^\\*', '')")}), lambda x: x <> '' and not starts_with(x, '@')), ' ') as joined
          from documents) d""",
)
def clean_comment(spark, sf_dir):
    """The documents as block comments, with a star before each line.

    One star per line is a marker. Texts with lines that start with a star of
    their own are wrapped without markers.
    """
    body = F.expr(COMMENT.replace("chr(10)", "'\n'"))
    plain = F.rlike("text", F.lit(rf"(?:\A|\n)[{C.SPACES}]*\*"))
    wrapped = F.when(plain, F.concat(F.lit("/* "), "text", F.lit("\n*/"))).otherwise(body)
    return I.table(spark, sf_dir, "documents").select("doc_id", T.clean_comment(wrapped).alias("comment"))


@query(
    "clean_docstring",
    f"""select doc_id, case when length(a) < 20 and n > 1 then left(a || ' ' || b, 100) || '...'
          else left(a, 100) || case when length(a) > 100 then '...' else '' end end as doc from (
        select doc_id, {Q.strip('l[1]')} as a, {Q.strip('l[2]')} as b, len(l) as n from (
          select doc_id, string_split(regexp_replace(regexp_replace(text, '^[''"]+', ''), '[''"]+$', ''), chr(10)) as l from documents) d) e""",
)
def clean_docstring(spark, sf_dir):
    quoted = F.concat(F.lit('"""'), "text", F.lit('"""'))
    return I.table(spark, sf_dir, "documents").select("doc_id", T.clean_docstring(quoted).alias("doc"))
