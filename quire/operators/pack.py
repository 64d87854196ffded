"""One call from raw files to a pack and to the statistics of what is in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import analysis as A
from quire.operators.filters import KEYS, included_files
from quire.operators.modes import processed_files
from quire.operators.render import SEGMENT_BYTES, assembled, pack_parts, write_pack
from quire.operators.symbols import summaries
from quire.options import PackOptions
from quire.session import written
from quire.sources.files import read_files, textual_files
from quire.sources.rules import ignore_rules


@dataclass(frozen=True)
class Pack:
    """The packs of many repositories. ``processed`` is a written table: what is read here is computed once."""

    processed: DataFrame
    options: PackOptions
    repos: DataFrame | None = None

    def parts(self) -> DataFrame:
        return pack_parts(self.processed, self.options, self.repos)

    def texts(self, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
        """Packs as strings of bounded size."""
        return assembled(self.parts(), segment_bytes)

    def write(self, folder: str) -> None:
        write_pack(self.parts(), folder)

    def files_processed(self) -> DataFrame:
        """``repo_id, files``: files that are in the pack; repositories without any, if named, have zero."""
        counted = self.processed.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
        if self.repos is None:
            return counted
        named = self.repos.select("repo_id").distinct().join(counted, "repo_id", "full")
        return named.select("repo_id", F.coalesce("files", F.lit(0).cast("bigint")).alias("files"))

    def totals(self) -> DataFrame:
        """Files, tokens and lines of each pack, and whether the tokens are above ``max_tokens``."""
        limit = self.options.max_tokens
        over = F.col("total_tokens") > limit if limit else F.lit(False)
        return A.overall(self.processed, "repo_id").withColumn("over_limit", over)

    def by_extension(self) -> DataFrame:
        return A.by_extension(self.processed, self.options.top_n)

    def top_files(self) -> DataFrame:
        return A.top_files(self.processed, self.options.top_n)


def pack(
    files: DataFrame,
    options: PackOptions = PackOptions(),
    rules: DataFrame | None = None,
    chosen: DataFrame | None = None,
    repos: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> Pack:
    """Filter, decode, choose the content of each file, and count: ``files`` are ``repo_id, path, size, content BINARY``.

    Without ``rules`` the root ignore files among ``files`` hold. ``chosen`` (``repo_id, path``) is an explicit list that overrides every
    filter. ``listing`` has at least the keys of ``files``, where that is cheaper to read. With ``compress`` files in a language with rules are summarised; a file without a summary goes whole.
    """
    if rules is None and options.respect_gitignore and chosen is None:
        own = files.filter(F.col("path") == ".gitignore").select("repo_id", "path", T.decode(F.col("content")).alias("content"))
        rules = written(ignore_rules(own), "rules")
    kept = included_files(files, options, rules, chosen, listing)
    texts = kept.select(*KEYS, T.decode(F.col("content")).alias("content"))
    made = None
    if options.compress:
        # Both the summaries and the whole texts are taken from it.
        texts = written(texts, "included")
        made = summaries(texts)
    return Pack(written(processed_files(texts, options, made), "processed"), options, repos)


def pack_folders(roots: DataFrame, options: PackOptions = PackOptions(), chosen: DataFrame | None = None) -> Pack:
    """``pack`` of the files below ``roots`` (``repo_id, root`` URI); every root has a pack, if only the message that it is empty."""
    listing = textual_files(roots)
    files = read_files(listing, options.max_file_bytes)
    return pack(files, options, None, chosen, roots.select("repo_id"), listing)
