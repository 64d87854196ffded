"""Path columns. A path is relative to its repository and uses ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def dir_parts(path: Column) -> Column:
    """All components but the last."""
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path, ``''`` at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)).otherwise("")


def order_key(path: Column) -> Column:
    """One string whose byte order is the part-by-part order of paths."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def suffix(path: Column) -> Column:
    """Last suffix with its dot, case preserved, ``''`` if there is none."""
    return F.regexp_extract(path, C.EXT_RE, 1)


def ext(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == "", F.lit(C.NO_EXTENSION)).otherwise(s)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A fixed lookup table as a map literal; null if the key is missing."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def fence_language(path: Column) -> Column:
    bare = F.regexp_replace(suffix(path), r"\A\.", "")
    return F.coalesce(lookup(bare, C.FENCE_LANGUAGES), F.lit(""))


def code_language(path: Column, content: Column) -> Column:
    """Language with structure rules, by extension, else by the shebang line."""
    by_ext = lookup(F.lower(suffix(path)), C.CODE_LANGUAGES)
    first = F.regexp_extract(content, r"\A([^\n\r]*)", 1)
    shebang = F.startswith(F.ltrim(first), F.lit("#!"))
    by_line = F.when(shebang & F.contains(first, F.lit("python")), "python").when(
        shebang & F.contains(first, F.lit("node")), "javascript"
    )
    return F.coalesce(by_ext, by_line)


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; a path elsewhere is kept as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))
    ).otherwise(path)


def ancestors(path: Column) -> Column:
    """Every directory above ``path``, top first; empty at the root."""
    p = parts(path)
    return F.when(
        F.size(p) > 1,
        F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def has_hidden(path_parts: Column) -> Column:
    """True if a component starts with a dot and is not an allowed name."""
    return F.exists(
        path_parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(*C.ALLOWED_HIDDEN)
    )


def has_part(path_parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(path_parts, F.array(*[F.lit(n) for n in names]))


def skipped(path_parts: Column) -> Column:
    """Hidden or build/cache component."""
    return has_hidden(path_parts) | has_part(path_parts, C.SKIPPED_DIRS)
