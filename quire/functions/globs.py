"""Ignore-file patterns as regular expressions.

The language is the public ignore-file one: the last matching rule decides, a
leading ``!`` negates, an inner or leading ``/`` anchors at the root, a trailing
``/`` asks for something below. Matching is per file, so a later ``!`` brings a
file back even below an ignored directory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def _segment(glob: str) -> str:
    """One path component: ``* ? [..]`` and backslash escapes."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] in ("!", "^")))) > 0:
            inner = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "".join(out)


def steps_of(line: str) -> tuple[bool, list[str], bool] | None:
    """``(negated, path components, asks for something below)`` of one line; None for blanks and comments."""
    line = line.rstrip("\r\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    below_only = body.endswith("/")
    steps = [s for s in body.strip("/").split("/")]
    if steps == [""]:
        return None
    anchored = body.startswith("/") or len(steps) > 1
    if not anchored and steps != ["**"]:
        steps.insert(0, "**")
    return negated, steps, below_only


def parse(line: str) -> tuple[bool, str] | None:
    """``(negated, regex)`` of one line; None for blanks and comments."""
    rule = steps_of(line)
    if rule is None:
        return None
    negated, steps, below_only = rule
    regex, last = "", len(steps) - 1
    for i, step in enumerate(steps):
        if step == "**":
            if i == last:
                regex += ".+"
            else:
                regex += "(?:.+/)?"
        else:
            regex += _segment(step) + ("/" if i < last else "")
    if steps[-1] != "**":
        regex += "/.*" if below_only else "(?:/.*)?"
    elif below_only:
        regex += "/.*"
    return negated, rf"\A{regex}\z"


def ignored_regex(rules: Iterable[tuple[bool, str]]) -> str | None:
    """One regex that matches exactly the paths whose last matching rule is positive.

    Each positive rule carries a look-ahead that refuses what a later negated
    rule matches.
    """
    later: list[str] = []
    kept: list[str] = []
    for negated, regex in reversed(list(rules)):
        if negated:
            later.append(f"(?:{regex})")
        else:
            kept.append((f"(?!{'|'.join(later)})" if later else "") + f"(?:{regex})")
    return "|".join(kept) or None


def compile_patterns(patterns: Iterable[str]) -> str | None:
    return ignored_regex(rule for p in patterns if (rule := parse(p)))


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """Last-match-wins test of a literal pattern list; an empty list matches nothing."""
    regex = compile_patterns(patterns)
    return F.lit(False) if regex is None else F.rlike(path, F.lit(regex))


RULE_TYPE = StructType([StructField("negated", BooleanType()), StructField("regex", StringType())])


@pandas_udf(RULE_TYPE)
def parsed_rule(lines: pd.Series) -> pd.DataFrame:
    """``parse`` over a column of rule lines (rule tables are small)."""
    rules = [parse(x) or (None, None) for x in lines]
    return pd.DataFrame(rules, columns=["negated", "regex"])


def literal(step: str) -> str | None:
    """The name that a path component stands for; None if it has wildcards."""
    out, i = "", 0
    while i < len(step):
        if step[i] in "*?[":
            return None
        i += step[i] == "\\" and i + 1 < len(step)
        out += step[i]
        i += 1
    return out


def dotted(step: str) -> str | None:
    """The literal end of a component from its first dot after the wildcards."""
    rest = re.split(r"[*?]", step)[-1]
    return rest[rest.index(".") :] if "." in rest and not set("[]\\") & set(step) else None


def key_of(line: str) -> tuple[str, str, bool, bool] | None:
    """``(kind, key, exact, asks for something below)``: what a path must have to match the line.

    A path has its leading folders (``path``), the names of its components (``name``) and the ends of
    those from each dot (``end``). If ``exact``, a path with the key matches; else the regular expression decides.
    """
    rule = steps_of(line)
    if rule is None:
        return None
    _, steps, below_only = rule
    names = [literal(s) for s in steps]
    anywhere = steps[0] == "**" and len(steps) == 2
    if None not in names:
        return "path", "/".join(names), True, below_only
    if anywhere and names[1] is not None:
        return "name", names[1], True, below_only
    end = dotted(steps[1]) if anywhere else None
    if end and steps[1] == f"*{end}":
        return "end", end, True, below_only
    lead = names[: names.index(None)]
    if lead:
        return "path", "/".join(lead), False, below_only
    if known := [n for n in names if n]:
        return "name", max(known, key=len), False, below_only
    ends = [e for s in steps if (e := dotted(s))]
    return ("end", ends[-1], False, below_only) if ends else ("path", "", False, below_only)


KEY_TYPE = StructType(
    [
        StructField("kind", StringType()),
        StructField("key", StringType()),
        StructField("exact", BooleanType()),
        StructField("below", BooleanType()),
    ]
)


@pandas_udf(KEY_TYPE)
def rule_key(lines: pd.Series) -> pd.DataFrame:
    """``key_of`` over a column of rule lines (rule tables are small)."""
    return pd.DataFrame([key_of(x) or (None,) * 4 for x in lines], columns=KEY_TYPE.fieldNames())


def path_keys(path: Column) -> Column:
    """All keys of a path, each with whether something is below that place (``above``)."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    key = lambda kind, value, above: F.struct(F.lit(kind).alias("kind"), value.alias("key"), above.alias("above"))
    folders = F.transform(F.sequence(F.lit(0), n), lambda i: key("path", F.array_join(F.slice(parts, F.lit(1), i), "/"), i < n))
    names = F.transform(parts, lambda s, i: key("name", s, i < n - 1))

    def ends(s: Column, i: Column) -> Column:
        d = F.split(s, "[.]", -1)
        places = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda k: k > 0)
        return F.transform(places, lambda k: key("end", F.concat(F.lit("."), F.array_join(F.slice(d, k + 1, F.size(d)), ".")), i < n - 1))

    return F.concat(folders, names, F.flatten(F.transform(parts, ends)))
