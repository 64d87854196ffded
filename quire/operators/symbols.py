"""Definitions in source files as a symbol table, and summaries made from it.

A file is one row until its lines are linked, then each line that can start a
definition is a row and the rules are tested on it. Nothing is shuffled for the
symbol table. Strings and comments, also those over several lines, are masked before a
rule sees a line. An Arrow helper links the lines of many files at once (nesting, statement ends, comments)
by array operations on integers. It is a scan of statements, not a parser.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.functions import pandas_udf

from quire.functions import paths as P
from quire.functions import text as T
from quire.operators.symbol_rules import (
    CONTAINERS,
    DEFAULT_RULES,
    INDENTED,
    MODIFIERS,
    SymbolRule,
    supported_languages,
)

INTS = ST.ArrayType(ST.IntegerType())
LINKS = ST.StructType([ST.StructField(n, INTS) for n in ("depth", "parent", "stop", "next", "comment", "string", "start")])
BLANK = -1  # level of a line that takes no part in nesting
#: Stands at the begin of a line that a string goes on over.
INNER = "\u0001"


#: Lines that are linked at once; whole files each.
LINE_BLOCK = 200_000


def previous_smaller(values: np.ndarray, strict: bool = True) -> np.ndarray:
    """For each place the nearest one before it with a smaller (or equal) value, -1 for none.

    Minima of blocks of 1, 2, 4, ... values; from the largest block down, each place goes back
    over the blocks that hold no such value.
    """
    n = len(values)
    blocks = [values]
    while 1 << len(blocks) <= n:
        last, half = blocks[-1], 1 << (len(blocks) - 1)
        blocks.append(np.minimum(last[: len(last) - half], last[half:]))  # values [i, i + 2 * half)
    at = np.arange(n)
    for k in range(len(blocks) - 1, -1, -1):
        begin = at - (1 << k)
        least = blocks[k][np.maximum(begin, 0)] if len(blocks[k]) else values[:0]
        passed = (begin >= 0) & ((least >= values) if strict else (least > values))
        at = np.where(passed, begin, at)
    return at - 1


def link_files(sizes, levels, deltas, parens, marks, inner, braced):
    """Links of the lines of several files, each 0-based within its file, -1 for none.

    ``sizes`` are lines per file, the other arguments hold all lines in a row (``braced``: one flag per line).
    depth: nesting before the line; parent: line that opened the enclosing block; stop: line on
    which the parentheses opened here are closed; next: next line with code; comment: first
    line of the comment block just above; string: last line of the string that goes on here.
    """
    n = int(sum(sizes))
    if not n:
        return (np.zeros(0, np.int64),) * 6
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    file = np.repeat(np.arange(len(sizes)), sizes)
    start, at = begin[file], np.arange(n)
    far = 4 * (n + int(np.abs(levels).sum()) + int(np.abs(deltas).sum()) + int(np.abs(parens).sum()) + 1)

    def last(test):
        """The last line so far in the file where ``test`` holds."""
        found = np.maximum.accumulate(np.where(test, at, -1))
        return np.where(found >= start, found, -1)

    # Open braces, never below zero: what the least sum so far fell below it is given back.
    total = np.cumsum(deltas)
    total -= (total - deltas)[start]
    least = np.minimum.accumulate(np.minimum(total, 0) - file * far) + file * far
    after = total - least
    code = levels != BLANK
    depth = np.where(code, np.where(braced, np.where(at > start, np.roll(after, 1), 0), levels), 0)
    # A statement is open until the parentheses are back to what they were before it.
    opened = np.cumsum(parens)
    opened -= (opened - parens)[start]
    back = (opened - file * far)[::-1]
    before = (opened - parens - file * far)[::-1]
    closed = n - 1 - _next_back(back, before)[::-1]
    closes = (parens > 0) & (closed < n) & (closed >= 0)
    closes &= file[np.clip(closed, 0, n - 1)] == file
    stop = np.where(closes, closed, at)
    ends = np.where(closes, closed, np.concatenate([begin[1:], [n]])[file] - 1)
    edges = np.zeros(n + 2, np.int64)
    some = np.flatnonzero(parens > 0)
    np.add.at(edges, some + 1, 1)
    np.add.at(edges, ends[some] + 1, -1)
    inside = np.cumsum(edges[:n]) > 0
    own = np.flatnonzero(code & ~inside)
    parent = np.full(n, -1)
    up = previous_smaller(depth[own] - file[own] * far)
    parent[own] = np.where(up >= 0, own[up], -1)
    parent = np.where(parent >= start, parent, -1)
    ahead = np.minimum.accumulate(np.where(code, at, n)[::-1])[::-1]
    ahead = np.concatenate([ahead[1:], [n]])
    nxt = np.where((ahead < n) & (file[np.minimum(ahead, n - 1)] == file), ahead, -1)
    opener, plain = last(marks == 1), last(marks == 0)
    block = np.where((marks > 0) & (opener > plain), opener, -1)
    comment = np.where(at > start, np.roll(block, 1), -1)
    outer = np.minimum.accumulate(np.where(inner, n, at)[::-1])[::-1]
    outer = np.concatenate([outer[1:], [n]])
    string = np.minimum(outer, np.concatenate([begin[1:], [n]])[file]) - 1
    local = lambda x: np.where(x >= 0, x - start, -1)
    return depth, local(parent), stop - start, local(nxt), local(comment), string - start


def _next_back(back: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each place the nearest one at or before it whose value is at most ``limit`` there, -1 for none."""
    n = len(back)
    blocks = [back]
    while 1 << len(blocks) <= n:
        last, half = blocks[-1], 1 << (len(blocks) - 1)
        blocks.append(np.minimum(last[: len(last) - half], last[half:]))
    at = np.arange(1, n + 1)
    for k in range(len(blocks) - 1, -1, -1):
        begin = at - (1 << k)
        passed = (begin >= 0) & (blocks[k][np.maximum(np.minimum(begin, len(blocks[k]) - 1), 0)] > limit)
        at = np.where(passed, begin, at)
    return at - 1


def _signs(text: str) -> np.ndarray:
    """A flag per byte value, set for the characters of ``text``."""
    return np.isin(np.arange(256), np.frombuffer(text.encode(), np.uint8))


SPACE = _signs(" \t\x0b\f\r")
#: What a line that can start a definition begins with.
START = _signs("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_#@~$*")


def line_table(texts: list[str], indented: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level, braces and parentheses opened less those closed, lies in a string, can start a definition: for all lines of masked texts.

    A brace alone on its line belongs to the statement above it. Lines inside a string take no part.
    """
    raw = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    ends = np.flatnonzero(raw == ord("\n"))
    begin = np.concatenate([[0], ends[:-1] + 1])

    def runs(space: np.ndarray) -> np.ndarray:
        """Places of the ends of lines and of what follows a space or stands first in a line."""
        after = np.concatenate([[True], (space | (raw == ord("\n")))[:-1]])
        return np.flatnonzero(~space & after | (raw == ord("\n")))

    solid = runs(raw == ord(" "))
    place = np.searchsorted(solid, begin)
    first = solid[place]
    second = solid[np.minimum(place + 1, len(solid) - 1)]
    behind = raw[np.minimum(first + 1, len(raw) - 1)]
    lone = (raw[first] == ord("{")) & ((behind == ord("\n")) | (behind == ord(" ")) & (raw[second] == ord("\n")))
    inner = raw[begin] == ord(INNER)
    code = runs(SPACE[raw])
    code = code[np.searchsorted(code, begin)]
    levels = np.where(inner | (raw[first] == ord("\n")) | lone & ~indented, BLANK, np.where(indented, code - begin, 0))
    count = lambda sign: np.bincount(np.searchsorted(ends, np.flatnonzero(raw == ord(sign))), minlength=len(ends))
    return levels, np.where(indented, 0, count("{") - count("}")), count("(") - count(")"), inner, START[raw[code]]


@pandas_udf(LINKS)
def _links(masked_text: pd.Series, indented: pd.Series, marks: pd.Series) -> pd.DataFrame:
    sizes = np.array([x.count("\n") + 1 for x in masked_text], np.int64)
    out: list[list] = [[] for _ in LINKS.names]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // LINE_BLOCK, prepend=-1)).tolist() + [len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        files = np.repeat(indented.iloc[a:b].to_numpy(bool), sizes[a:b])
        levels, braces, parens, inner, start = line_table(masked_text.iloc[a:b].tolist(), files)
        signs = np.concatenate([np.asarray(x, np.int64) for x in marks.iloc[a:b]])
        links = link_files(sizes[a:b], levels, braces, parens, signs, inner, ~files)
        begin = np.cumsum(sizes[a:b])
        for own, link in zip(out, links, strict=False):
            own.extend(np.split(link.astype(np.int32), begin[:-1]))
        started = np.flatnonzero(start)
        cut = np.searchsorted(started, begin)
        local = started - np.repeat(begin - sizes[a:b], np.diff(cut, prepend=0))
        out[-1].extend(np.split(local.astype(np.int32), cut[:-1]))
    return pd.DataFrame(dict(zip(LINKS.names, out, strict=True)))


def _by_language(rules: tuple[SymbolRule, ...], pick) -> Column:
    """CASE on the language around the CASE of its own rules."""
    out = None
    for lang in supported_languages(rules):
        own = pick([r for r in rules if r.lang == lang])
        if own is not None:
            test = F.col("code_lang") == lang
            out = F.when(test, own) if out is None else out.when(test, own)
    return out if out is not None else F.lit(None).cast("int")


def _with_first_rule(rows: DataFrame, rules: tuple[SymbolRule, ...], own_test, name: str) -> DataFrame:
    """``rows`` with the index of the first rule whose test holds, null if none, as the column ``name``.

    Exploding an array of one element tests the rules once per row, in generated code; a filter on a plain column
    would test them twice, and one inside the array by interpreted expressions. Each language has an explode of its
    own, hence a generated method of its own: one with the rules of all is too long for the JVM to compile.
    """
    number = {r: i for i, r in enumerate(rules)}
    found = []
    for lang in supported_languages(rules):
        out = None
        for r in rules:
            test = own_test(r) if r.lang == lang else None
            if test is not None:
                out = F.when(test, F.lit(number[r])) if out is None else out.when(test, F.lit(number[r]))
        if out is not None:
            found.append(f"{name}_{lang}")
            rows = rows.select("*", _once(F.when(F.col("code_lang") == lang, out)).alias(found[-1]))
    index = F.coalesce(*found) if found else F.lit(None).cast("int")
    return rows.withColumn(name, index).drop(*found)


def _matches(text: str, rule: SymbolRule) -> Column:
    hit = F.rlike(text, F.lit(rule.regex))
    return F.contains(text, F.lit(rule.word)) & hit if rule.word else hit


def _name(rules: tuple[SymbolRule, ...], text: str, index: str) -> Column:
    """The name by the rule of that index. Its pattern is a constant: one from a column is compiled anew for every row."""
    number = {r: i for i, r in enumerate(rules)}

    def pick(own: list[SymbolRule]) -> Column:
        out = F
        for r in own:
            out = out.when(F.col(index) == number[r], F.regexp_extract(text, r.regex, 1))
        return out

    return _by_language(rules, pick)


def _rule_test(rule: SymbolRule) -> Column:
    """The head matches and the statement is where the rule wants it."""
    hit = _matches("head", rule)
    places = []
    if rule.parents:
        places.append(F.col("parent_kind").isin(*rule.parents))
    if rule.top:
        places.append(F.col("depth") == 0)
    return hit if not places else (places[0] if len(places) == 1 else places[0] | places[1]) & hit


def _container_test(rule: SymbolRule) -> Column | None:
    """The line opens a block with members."""
    return _matches("parent_text", rule) if rule.kind in CONTAINERS else None


RULE_ROW = "array<struct<kind:string,member:boolean,rank:int>>"


def _rule_table(rules: tuple[SymbolRule, ...]) -> Column:
    """The rules as one constant array, so that a row can look up its own."""
    rows = [
        {"kind": r.kind, "member": bool(r.parents), "rank": -1 if r.rank is None else r.rank}
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), RULE_ROW)


def _once(value: Column) -> Column:
    return F.explode(F.array(value))


def _signature() -> Column:
    """The statement head without the opener of its body."""
    one = F.trim(F.regexp_replace("head", r"\s+", " "))
    named = F.regexp_extract(one, r"^((?:async )?(?:def|class) .*?(?:\(.*\))?(?: ?-> ?.+?)?) ?:(?: .*)?$", 1)
    python = F.when(F.col("kind").isin("class", "function", "method") & (named != ""), F.rtrim(named)).otherwise(one)
    # What follows a brace is a body, except in the value of a variable.
    valued = F.col("kind").isin("constant", "property", "global", "field", "static", "import")
    braces = F.when(valued | ~F.contains("head", F.lit("{")), one).otherwise(F.regexp_replace(one, r"\s*\{.*$", ""))
    ended = F.when(F.contains("head", F.lit(";")), F.regexp_replace(braces, r"\s*;\s*$", "")).otherwise(braces)
    return F.when(F.col("code_lang").isin(*INDENTED), python).otherwise(ended)


# Strings and comments open no block and hold no definition. Possessive repeats run as
# loops: a literal of any length takes no stack. A quote that must be closed on its line and is not is no string.
LITERAL = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\"|\z)"
BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
LINE_COMMENT = r"//[^\n]*+"
HASH_COMMENT = r"#[^\n]*+"
#: Strings that may go on over lines, by language, before the comments and the others.
LONG_STRINGS = {
    "python": TRIPLE + "|" + TRIPLE.replace('\\"', "'"),
    "javascript": r"`(?:[^`\\]|\\[\s\S])*+(?:`|\z)",
    "typescript": r"`(?:[^`\\]|\\[\s\S])*+(?:`|\z)",
    "java": TRIPLE,
    "cpp": r"\bR\"([^()\\\s]{0,16}+)\((?:(?!\)\1\")[\s\S])*+(?:\)\1\"|\z)",
    "rust": r"\bb?r(#*+)\"(?:(?!\"\1)[\s\S])*+(?:\"\1|\z)|\"(?:[^\"\\]|\\[\s\S])*+(?:\"|\z)",
}
#: A lifetime has no second quote.
RUST_LITERAL = r"'(?:[^'\\\n]|\\[^\n'][^'\n]*+)'"


def tokens(lang: str) -> str:
    """A pattern of the strings and comments of a language, in the order in which they are tried."""
    plain = RUST_LITERAL if lang == "rust" else LITERAL
    comments = [HASH_COMMENT] if lang in INDENTED else [LINE_COMMENT, BLOCK_COMMENT]
    return "|".join([*([LONG_STRINGS[lang]] if lang in LONG_STRINGS else []), *comments, plain])


def masked(text: Column, lang: Column, languages: list[str]) -> Column:
    """``text`` with a quote for every string and nothing for every comment; lines stay, those inside a string are marked."""
    breaks = lambda x: F.regexp_replace(x, r"[^\n]++", "")
    comment = lambda x: F.startswith(x, F.lit("/")) | F.startswith(x, F.lit("#"))
    long = lambda x: F.when(comment(x), breaks(x)).otherwise(F.concat(F.lit('"'), F.replace(breaks(x), F.lit("\n"), F.lit("\n" + INNER))))
    shown = lambda x: F.when(F.contains(x, F.lit("\n")), long(x)).when(comment(x), "").otherwise('"')
    out = None
    for own in languages:
        pattern = tokens(own)
        between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        made = F.array_join(F.zip_with(between, F.transform(hits, shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        out = F.when(lang == own, made) if out is None else out.when(lang == own, made)
    return out


COMMENT_LINE = r"^\s*(?://|/\*|#(?![\[!]|\s*(?:include|define|if|endif|else|pragma)))"
COMMENT_MORE = r"^\s*\*|^[^\"']*\*/\s*$"


def statements(files: DataFrame, languages: list[str], content: str = "content") -> DataFrame:
    """One row per line that can start a definition, with what surrounds it.

    ``repo_id, path, code_lang, i, head, depth, parent_i, parent_text, doc_text,
    comment_text``. A file is one row until its lines are linked, so nothing is
    shuffled and the other columns of a file are not repeated.
    """
    indented = F.col("code_lang").isin(*INDENTED)
    text = F.regexp_replace(F.col(content), r"\r\n?", "\n")
    source = files.select(
        "repo_id", "path", P.code_language(F.col("path"), F.col(content)).alias("code_lang"), text.alias("_text")
    ).filter(F.col("code_lang").isin(*languages))
    lined = source.select(
        "repo_id",
        "path",
        "code_lang",
        F.split("_text", "\n", -1).alias("_lines"),
        masked(F.col("_text"), F.col("code_lang"), languages).alias("_masked"),
    )
    mark = F.transform(
        "_lines",
        # Every comment has one of these signs; a search for them spares the other lines the patterns.
        lambda x: F.when(~F.contains(x, F.lit("/")) & ~F.contains(x, F.lit("#")) & ~F.contains(x, F.lit("*")), 0)
        .when(F.rlike(x, F.lit(COMMENT_LINE)), 1)
        .when(F.rlike(x, F.lit(COMMENT_MORE)), 2)
        .otherwise(0),
    )
    linked = lined.withColumn("_links", _links("_masked", indented, mark)).drop("_masked")
    line = lambda i: F.get("_lines", i)
    at = lambda name, i: F.get(F.col("_links")[name], i)

    def statement(i: Column) -> Column:
        # A string that opens on the last line of a statement belongs to it.
        stop = F.when(indented, at("stop", i)).otherwise(at("string", at("stop", i)))
        rest = F.array_join(F.transform(F.slice("_lines", i + 2, stop - i), F.trim), " ")
        return F.struct(
            i.alias("i"),
            F.when(stop == i, line(i)).otherwise(F.concat(line(i), F.lit(" "), rest)).alias("head"),
            at("depth", i).alias("depth"),
            at("parent", i).alias("parent_i"),
            line(at("parent", i)).alias("parent_text"),
            F.when(
                indented & (at("next", stop) >= 0),
                F.array_join(F.slice("_lines", at("next", stop) + 1, at("string", at("next", stop)) - at("next", stop) + 1), "\n"),
            ).alias("doc_text"),
            F.when(
                at("comment", i) >= 0, F.array_join(F.slice("_lines", at("comment", i) + 1, i - at("comment", i)), "\n")
            ).alias("comment_text"),
        )

    return linked.select("repo_id", "path", "code_lang", F.inline(F.transform(F.col("_links")["start"], statement)))


def _doc() -> Column:
    """The string that opens a Python body, whole."""
    text = F.regexp_replace(F.trim("doc_text"), r"^[rRbBuU]{1,2}(?=[\"'])", "")
    found = F.regexp_extract(text, "^(?:" + LONG_STRINGS["python"] + "|" + LITERAL + ")", 0)
    return F.when(found != "", T.docstring_text(found))


# --- fixed values: kind of the constants of an enum ---------------------------
ENUM_MEMBERS = {"java": "enum_constant", "cpp": "enumerator", "c": "enumerator", "rust": "variant"}
ENTRY_COLUMNS = ["kind", "name", "signature", "parent", "parent_line", "modifiers", "doc", "comment", "rank"]
SYMBOL_COLUMNS = ["line_no", "kind", "name", "signature", "parent", "modifiers", "doc", "comment"]


def _symbol_rows(files: DataFrame, rules: tuple[SymbolRule, ...], content: str = "content") -> DataFrame:
    rows = statements(files, supported_languages(rules), content)
    placed = _with_first_rule(rows, rules, _container_test, "_container")
    table = _rule_table(rules)
    of = lambda index, name: F.get(table, F.col(index))[name]
    placed = placed.withColumn("parent_kind", of("_container", "kind"))
    hit = _with_first_rule(placed, rules, _rule_test, "_rule").filter("_rule is not null")
    is_member = of("_rule", "member") & F.col("_container").isNotNull()
    named = lambda text, index: _name(rules, text, index)
    words = "|".join(MODIFIERS)
    lead = F.regexp_extract(F.ltrim("head"), rf"^((?:(?:{words})(?:\([^)]*\))?\s++)++)", 1)
    documented = F.col("code_lang").isin(*INDENTED) & F.col("kind").isin("class", "function", "method")
    found = (
        hit.withColumn("kind", of("_rule", "kind"))
        .withColumn("_member", is_member)
        .select(
            "repo_id",
            "path",
            F.col("code_lang").alias("lang"),
            (F.col("i") + 1).alias("line_no"),
            "kind",
            named("head", "_rule").alias("name"),
            _signature().alias("signature"),
            F.when(F.col("_member"), named("parent_text", "_container")).alias("parent"),
            F.when(F.col("_member"), F.col("parent_i") + 1).alias("parent_line"),
            F.regexp_extract_all(lead, F.lit(r"\S+"), F.lit(0)).alias("modifiers"),
            F.when(documented, _doc()).alias("doc"),
            T.comment_text(F.col("comment_text")).alias("comment"),
            of("_rule", "rank").alias("rank"),
            "head",
        )
    )
    # A line of enum constants gives one symbol per constant, and so does the
    # body of an enum that stands on the line of its head.
    constants = F.when(F.col("kind").isin(*ENUM_MEMBERS.values()), F.col("head")).when(
        F.col("kind") == "enum", F.regexp_extract("head", r"\{(.*)\}", 1)
    )
    bare = F.regexp_replace(constants, r"\([^)]*\)|\{[^}]*\}|=[^,]*", "")
    names = F.regexp_extract_all(bare, F.lit(r"(?:^|,)\s*([A-Za-z_$][\w$]*)"), F.lit(1))
    is_enum = F.col("kind") == "enum"
    itself = [F.col(c).alias(c) for c in ENTRY_COLUMNS]
    listed = F.transform(
        names,
        lambda n: F.struct(
            F.when(is_enum, P.lookup(F.col("lang"), ENUM_MEMBERS)).otherwise(F.col("kind")).alias("kind"),
            n.alias("name"),
            F.when(is_enum, n).otherwise(F.col("signature")).alias("signature"),
            F.when(is_enum, F.col("name")).otherwise(F.col("parent")).alias("parent"),
            F.when(is_enum, F.col("line_no")).otherwise(F.col("parent_line")).alias("parent_line"),
            F.when(is_enum, F.array().cast("array<string>")).otherwise(F.col("modifiers")).alias("modifiers"),
            F.col("doc").alias("doc"),
            F.when(~is_enum, F.col("comment")).alias("comment"),
            F.when(is_enum, F.lit(-1)).otherwise(F.col("rank")).alias("rank"),
        ),
    )
    own = F.array(F.struct(*itself))
    entries = F.when(is_enum, F.concat(own, listed)).when(names.isNotNull(), listed).otherwise(own)
    return found.select("repo_id", "path", "lang", "line_no", F.inline(entries))


def symbols(files: DataFrame, rules: tuple[SymbolRule, ...] = DEFAULT_RULES, language: str | None = None) -> DataFrame:
    """``repo_id, path, lang`` and the columns of each symbol; of one language if named."""
    own = rules if language is None else tuple(r for r in rules if r.lang == language)
    return _symbol_rows(files, own).select("repo_id", "path", "lang", *SYMBOL_COLUMNS)


# --- fixed values: languages whose block entries are closed by a brace -------
BRACED = ("javascript", "typescript", "java", "cpp", "c")
BLOCK_KINDS = ("class", "interface", "enum", "struct", "trait", "impl", "namespace", "mod")


def summaries(
    files: DataFrame, rules: tuple[SymbolRule, ...] = DEFAULT_RULES, all_kinds: bool = False
) -> DataFrame:
    """``repo_id, path, summary``: header, then sections in the order of the language.

    Members follow their class. Without ``all_kinds`` only the kinds with a rank
    are printed. Symbols of a file are gathered by file, which its size bounds;
    every file in a language with rules has a summary.
    """
    coded = files.select("repo_id", "path", P.code_language(F.col("path"), F.col("content")).alias("code_lang")).filter(
        F.col("code_lang").isin(*supported_languages(rules))
    )
    found = _symbol_rows(files, rules).select(
        "repo_id",
        "path",
        F.col("lang").alias("code_lang"),
        F.struct(
            F.when(F.col("rank") >= 0, F.col("rank")).otherwise(F.lit(99)).alias("rank"),
            F.coalesce("parent_line", "line_no").alias("owner"),
            "line_no",
            "kind",
            F.col("parent_line").isNotNull().alias("member"),
            "signature",
            "doc",
        ).alias("entry"),
    )
    # A file without symbols still has its header.
    all_files = found.unionByName(coded, allowMissingColumns=True)
    with_entries = all_files.groupBy("repo_id", "path", "code_lang").agg(F.collect_list("entry").alias("_entries"))
    with_entries = with_entries.withColumn(
        "_ranks",
        F.map_from_entries(
            F.transform(F.filter("_entries", lambda e: ~e["member"]), lambda e: F.struct(e["line_no"], e["rank"]))
        ),
    )
    # A member takes the section of its owner.
    placed = F.array_sort(
        F.filter(
            F.transform(
                "_entries",
                lambda e: F.struct(
                    F.coalesce(F.try_element_at("_ranks", e["owner"]), F.lit(99)).alias("rank"),
                    e["owner"].alias("owner"),
                    e["line_no"].alias("line_no"),
                    e["kind"].alias("kind"),
                    e["member"].alias("member"),
                    e["signature"].alias("signature"),
                    e["doc"].alias("doc"),
                ),
            ),
            lambda e: F.lit(True) if all_kinds else (e["rank"] < 99),
        )
    )
    ordered = with_entries.withColumn("_placed", placed)
    python = F.col("code_lang").isin(*INDENTED)
    braced = F.col("code_lang").isin(*BRACED)

    def printed(e: Column, i: Column) -> Column:
        after = F.get("_placed", i + 1)
        new_owner = after.isNull() | (after["owner"] != e["owner"])
        new_section = after.isNull() | (after["rank"] != e["rank"])
        block = (e["member"] | e["kind"].isin(*BLOCK_KINDS)) & braced
        alone = e["member"] | e["kind"].isin(*BLOCK_KINDS, "function", "package")
        indent = F.when(e["member"], "    ").otherwise("")
        opener = (
            F.when(python & e["kind"].isin("class", "function", "method"), ":")
            .when(braced & ~e["member"] & e["kind"].isin(*BLOCK_KINDS), " {")
            .when(F.col("code_lang").isin(*BRACED) & e["kind"].isin("import", "package", "constant", "field", "property", "global") , F.when(F.col("code_lang").isin("c", "cpp") & (e["kind"] == "import"), "").otherwise(";"))
            .otherwise("")
        )
        doc = F.when(e["doc"].isNotNull(), F.concat(F.lit("\n    "), indent, F.lit('"""'), T.clean_docstring(e["doc"]), F.lit('"""'))).otherwise("")
        close = F.when(new_owner & block, "\n}").otherwise("")
        gap = F.when(F.when(alone, new_owner).otherwise(new_section), "\n").otherwise("")
        return F.concat(indent, e["signature"], opener, doc, close, gap)

    body = F.array_join(F.transform("_placed", printed), "\n")
    return ordered.select(
        "repo_id",
        "path",
        F.concat(F.lit("# File: "), F.col("path"), F.lit("\n# Language: "), F.col("code_lang"), F.lit("\n\n"), body).alias("summary"),
    )


def summary_or_full(files: DataFrame, rules: tuple[SymbolRule, ...] = DEFAULT_RULES) -> DataFrame:
    """``repo_id, path, is_summary, content``: full content where there is no summary."""
    made = summaries(files, rules)
    return files.join(made, ["repo_id", "path"], "left").select(
        "repo_id",
        "path",
        F.col("summary").isNotNull().alias("is_summary"),
        F.coalesce("summary", "content").alias("content"),
    )
