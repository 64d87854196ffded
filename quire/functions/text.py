"""Text columns: decoding, lines, limits, notes, counts."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C

NUL = "\0"


def decode(content: Column) -> Column:
    """Strict UTF-8, else Latin-1, which never fails. A byte-order mark stays."""
    return F.coalesce(
        F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    )


def normalize_newlines(text: Column) -> Column:
    return _unix_breaks(text)


def _contains_any(text: Column, chars: str) -> Column:
    """Substring searches in the JVM; far cheaper than a character class."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in chars])


# --- fixed values: breaks and white space that ordinary text does not have ----
RARE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
RARE_SPACES = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u3000\u205f"
RARE_GENERAL_SPACES = "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f"


def _unix_breaks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(text: Column) -> Column:
    """``str.splitlines()`` as an array; no line is kept with its break."""
    plain = _unix_breaks(text)
    broken = F.when(
        _contains_any(text, RARE_BREAKS), F.regexp_replace(text, rf"\r\n|[{C.BREAKS}]", "\n")
    ).otherwise(plain)
    trimmed = F.when(F.endswith(broken, F.lit("\n")), F.left(broken, F.length(broken) - 1)).otherwise(broken)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "\n", -1))


def line_count(text: Column) -> Column:
    """``len(str.splitlines())``."""

    def by_newline(t: Column) -> Column:
        breaks = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
        return breaks + F.when((t == "") | F.endswith(t, F.lit("\n")), 0).otherwise(1)

    return (
        F.when(_contains_any(text, RARE_BREAKS), F.regexp_count(text, F.lit(C.LINE_RE)))
        .when(F.contains(text, F.lit("\r")), by_newline(_unix_breaks(text)))
        .otherwise(by_newline(text))
        .cast("bigint")
    )


def word_count(text: Column) -> Column:
    """``len(str.split())``."""
    # The general spaces share two UTF-8 bytes; without those none is there.
    general = F.contains(text.cast("binary"), F.lit(b"\xe2\x80")) & _contains_any(text, RARE_GENERAL_SPACES)
    plain = text
    for space in "\n\t\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    pieces = F.array_remove(F.split(plain, " ", -1), "")
    return (
        F.when(_contains_any(text, RARE_SPACES) | general, F.regexp_count(text, F.lit(C.WORD_RE)))
        .otherwise(F.size(pieces))
        .cast("bigint")
    )


def read_lines(text: Column) -> Column:
    """Lines of a text-mode read, each with its break: only ``\\n`` breaks."""
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def head_lines(text: Column, limit: int) -> Column:
    """The first ``limit`` lines; nothing behind the limit is split."""
    front = F.substring_index(text, "\n", limit)
    cut = F.octet_length(front) < F.octet_length(text)
    return F.when(cut, F.concat(front, F.lit("\n"))).otherwise(text)


def head_bytes(text: Column, limit: int) -> Column:
    """Whole lines while the running UTF-8 byte total stays within ``limit``."""
    size = F.octet_length(text)
    # Cut by bytes, then back to the last break inside the cut. Every line that
    # ends within the limit is whole, and the next one would exceed it.
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    breaks = F.length(F.substring_index(F.decode(cut, "ISO-8859-1"), "\n", -1))
    kept = F.greatest(F.octet_length(cut) - breaks, F.lit(0))
    whole = F.decode(F.substr(cut, F.lit(1), kept), "UTF-8")
    return F.when(size <= limit, text).otherwise(whole)


def head(text: Column, max_lines: int | None, max_bytes: int | None) -> Column:
    """Both limits at once; a limit of 0 or none is off."""
    out = text
    if max_lines:
        out = head_lines(out, max_lines)
    if max_bytes:
        out = head_bytes(out, max_bytes)
    return out


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit(NUL))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(C.WORD_RE))


def number_lines(text: Column) -> Column:
    """Each line behind its 1-based number, right-aligned to width 4."""
    return F.array_join(
        F.transform(lines(text), lambda x, i: F.format_string("%4d | %s", i + 1, x)), "\n"
    )


def rstrip_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def user_limit_note(max_lines: int | None, max_bytes: int | None) -> str:
    named = [f"{n} {unit}" for n, unit in ((max_lines, "lines"), (max_bytes, "bytes")) if n]
    return f"\n\n... (File content truncated due to limits: {', '.join(named)})"


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def fence(content: Column) -> Column:
    """A backtick fence longer than any run of backticks in ``content``."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("`{3,}"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs) + 1, F.lit(3))))


def comment_text(comment: Column) -> Column:
    """Comment text without markers, leading stars and ``@`` lines, whole."""
    c = F.regexp_replace(comment, rf"\A[{C.SPACES}]+|[{C.SPACES}]+\z", "")
    body = (
        F.when(
            F.startswith(c, F.lit("/**")) & F.endswith(c, F.lit("*/")),
            F.substr(c, F.lit(4), F.greatest(F.length(c) - 5, F.lit(0))),
        )
        .when(
            F.startswith(c, F.lit("/*")) & F.endswith(c, F.lit("*/")),
            F.substr(c, F.lit(3), F.greatest(F.length(c) - 4, F.lit(0))),
        )
        .when(F.startswith(c, F.lit("//")), F.substr(c, F.lit(3)))
        .when(F.startswith(c, F.lit("#")), F.substr(c, F.lit(2)))
        .otherwise(c)
    )
    stripped = F.transform(
        F.split(body, "\n", -1),
        lambda x: F.regexp_replace(x, rf"\A[{C.SPACES}]*(?:\*[{C.SPACES}]*)?|[{C.SPACES}]+\z", ""),
    )
    kept = F.filter(stripped, lambda x: (x != "") & ~F.startswith(x, F.lit("@")))
    return F.array_join(kept, " ")


def _shortened(text: Column, limit: int) -> Column:
    return F.concat(F.left(text, F.lit(limit)), F.when(F.length(text) > limit, F.lit("...")).otherwise(""))


def clean_comment(comment: Column) -> Column:
    """``comment_text`` cut to 200, for display."""
    return _shortened(comment_text(comment), C.COMMENT_CHARS)


def docstring_text(doc: Column) -> Column:
    """A docstring without its quotes, every line stripped, whole."""
    bare = F.regexp_replace(doc, "\\A['\"]+|['\"]+\\z", "")
    strip = lambda x: F.regexp_replace(x, rf"\A[{C.SPACES}]+|[{C.SPACES}]+\z", "")
    return strip(F.array_join(F.transform(F.split(bare, "\n", -1), strip), "\n"))


def clean_docstring(doc: Column) -> Column:
    """First line, with the second if the first is short, cut to 100, for display."""
    bare = F.regexp_replace(doc, "\\A['\"]+|['\"]+\\z", "")
    rows = F.split(bare, "\n", -1)
    strip = lambda x: F.regexp_replace(x, rf"\A[{C.SPACES}]+|[{C.SPACES}]+\z", "")
    first = strip(F.get(rows, F.lit(0)))
    second = strip(F.get(rows, F.lit(1)))
    short = (F.length(first) < C.DOCSTRING_SHORT) & (F.size(rows) > 1)
    return F.when(
        short, F.concat(F.left(F.concat_ws(" ", first, second), F.lit(C.DOCSTRING_CHARS)), F.lit("..."))
    ).otherwise(_shortened(first, C.DOCSTRING_CHARS))
