"""SQL text shared by the oracles (DuckDB dialect)."""

from __future__ import annotations

from quire import constants as C


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def suffix(path: str) -> str:
    return rf"regexp_extract({path}, '[^/](\.[^./]+)$', 1)"


def ext(path: str) -> str:
    return f"case when {suffix(path)} = '' then '{C.NO_EXTENSION}' else {suffix(path)} end"


def lookup(key: str, table: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def fence_lang(path: str) -> str:
    return f"coalesce({lookup(f'ltrim({suffix(path)}, chr(46))', C.FENCE_LANGUAGES)}, '')"


def lines(text: str) -> str:
    return f"cast(len(regexp_extract_all({text}, '{C.LINE_RE}')) as bigint)"


def words(text: str) -> str:
    return f"cast(len(regexp_extract_all({text}, '{C.WORD_RE}')) as bigint)"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{C.SPACES}]+', ''), '[{C.SPACES}]+$', '')"


def hidden(parts: str) -> str:
    return (
        f"len(list_filter({parts}, lambda x: starts_with(x, '.') and x not in ({quoted(C.ALLOWED_HIDDEN)}))) > 0"
    )


def built(parts: str) -> str:
    return f"list_has_any({parts}, [{quoted(C.SKIPPED_DIRS)}])"


def parts(path: str) -> str:
    return f"string_split({path}, '/')"


def dir_parts(path: str) -> str:
    return f"string_split({path}, '/')[:-2]"


def skipped_dir(path: str) -> str:
    return f"({hidden(dir_parts(path))} or {built(dir_parts(path))})"


def is_text(path: str, size: str, has_nul: str = "false") -> str:
    s = f"lower({suffix(path)})"
    return (
        f"case when {s} in ({quoted(C.BINARY_EXTENSIONS)}) then false "
        f"when {s} in ({quoted(C.TEXT_EXTENSIONS)}) then true else not ({has_nul}) end"
    )


def parent(path: str) -> str:
    return f"case when contains({path}, '/') then regexp_extract({path}, '^(.*)/[^/]*$', 1) else '' end"


def ancestors(path: str) -> str:
    return (
        f"list_transform(range(1, len({parts(path)})), lambda i: array_to_string({parts(path)}[1:i], '/'))"
    )


def html_text(html: str) -> str:
    out = html
    for tag in C.DROPPED_ELEMENTS:
        out = rf"regexp_replace({out}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', '<!>', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '<!>', 'g')"
    node = "x"
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")
    ):
        node = f"replace({node}, '{entity}', '{char}')"
    return (
        f"array_to_string(list_filter(list_transform(regexp_split_to_array({out}, '<[/!?a-zA-Z][^>]*>'), "
        f"lambda x: {strip(node)}), lambda x: x <> ''), chr(10))"
    )


def fence(text: str) -> str:
    return (
        f"repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all({text}, '`{{3,}}'), "
        f"lambda r: len(r))) + 1, 3)))"
    )


def rstrip_newlines(text: str) -> str:
    return f"rtrim({text}, chr(10))"


def normalized(text: str) -> str:
    return f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def head_lines(text: str, n: int) -> str:
    return f"array_to_string(regexp_extract_all({text}, '[^\\n]*\\n|[^\\n]+')[1:{n}], '')"
