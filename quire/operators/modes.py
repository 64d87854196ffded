"""What of a file goes into a pack: notebook, sample, limited, summary or full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import notebooks as N
from quire.functions import paths as P
from quire.functions import text as T
from quire.functions import tokens as K
from quire.options import PackOptions


def is_data_file(path: Column) -> Column:
    return F.lower(P.suffix(path)).isin(*C.DATA_EXTENSIONS)


def limited_read(text: Column, max_lines: int | None, max_bytes: int | None) -> Column:
    """Head of a text under the limits; null if what is kept holds a NUL."""
    kept = T.head(text, max_lines, max_bytes)
    return F.when(~T.has_nul(kept), kept)


def processed_files(
    files: DataFrame, options: PackOptions = PackOptions(), summaries: DataFrame | None = None
) -> DataFrame:
    """``repo_id, path, ext, lang, mode, was_truncated, is_summary, content, tokens, lines``.

    ``files`` holds decoded text. ``summaries`` (``repo_id, path, summary``) is
    used when structure summaries are asked for and the file was not cut.
    """
    path = F.col("path")
    base = files.withColumn("_text", T.normalize_newlines(F.col("content")))
    text = F.col("_text")
    limits = bool(options.file_max_lines or options.file_max_bytes)
    sampled = options.data_sample_lines
    is_data = is_data_file(path) if sampled else F.lit(False)
    is_notebook = N.is_notebook_path(path)
    numbered = options.show_line_numbers
    if options.compress and summaries is not None:
        base = base.join(summaries.select("repo_id", "path", "summary"), ["repo_id", "path"], "left")
        summary = F.col("summary")
    else:
        summary = F.lit(None).cast("string")

    sample = limited_read(text, sampled, None) if sampled else text
    own_limits = limited_read(text, options.file_max_lines, options.file_max_bytes) if limits else None
    read = F.when(is_data, sample)
    if limits:
        read = read.otherwise(own_limits)
    if sampled or limits:
        # A limited read that meets a NUL gives no file, as the limit must hold.
        asked = is_data if not limits else F.lit(True)
        whole = is_notebook & ~T.is_blank(text)
        base = base.filter(whole | ~asked | text.isNull() | read.isNotNull())
    # A notebook that is blank falls through to a plain read.
    base = base.withColumn("_read", F.coalesce(read, text)).withColumn(
        "_cut", F.coalesce(read != text, F.lit(False))
    )
    plain = F.col("_read")
    finished = T.number_lines(plain) if numbered else T.rstrip_newlines(plain)
    script = N.notebook_code("_text")
    from_notebook = is_notebook & ~(T.is_blank(text))

    mode = (
        F.when(from_notebook, "notebook")
        .when(F.lit(options.compress) & summary.isNotNull() & ~F.col("_cut"), "summary")
        .when(is_data, "data")
        .when(F.col("_cut"), "limited")
        .otherwise("full")
    )
    base = base.withColumn("mode", mode)
    body = (
        F.when(F.col("mode") == "notebook", T.number_lines(script) if numbered else script)
        .when(F.col("mode") == "summary", summary)
        .otherwise(finished)
    )
    note = F.when(F.col("mode") == "data", F.lit(C.DATA_NOTE.format(sampled)))
    if limits:
        note = note.when(
            F.col("mode") == "limited", F.lit(T.user_limit_note(options.file_max_lines, options.file_max_bytes))
        )
    out = base.select(
        "repo_id",
        "path",
        P.ext(path).alias("ext"),
        P.fence_language(path).alias("lang"),
        "mode",
        (F.col("_cut") & F.col("mode").isin("data", "limited")).alias("was_truncated"),
        (F.col("mode") == "summary").alias("is_summary"),
        F.concat(body, F.coalesce(note, F.lit(""))).alias("content"),
    )
    tokens = K.token_count(F.col("content"), options.counter) if options.count_tokens else F.lit(0).cast("bigint")
    return out.withColumn("tokens", tokens).withColumn("lines", T.line_count(F.col("content")))
