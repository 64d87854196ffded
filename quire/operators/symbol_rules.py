"""What a definition looks like, as data: one row per language and kind.

Users extend a language, or add one, by passing more rows.
"""

from __future__ import annotations

from dataclasses import dataclass

ID = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class SymbolRule:
    """``regex`` is tried on a whole statement head; rules of a language in order.

    ``parents`` restricts the rule to direct members of those kinds, ``top`` to
    statements outside any block. ``rank`` orders the sections of a summary;
    rules without a rank are printed on request only. ``word`` is a text every
    match contains; a search for it spares most lines the regex.
    """

    lang: str
    kind: str
    regex: str
    parents: tuple[str, ...] = ()
    top: bool = False
    rank: int | None = None
    word: str = ""


# --- fixed values: words that may stand before a definition ------------------
MODIFIERS = (
    "public private protected static final abstract synchronized native default sealed "
    "async export declare readonly override pub unsafe const extern virtual inline constexpr "
    "explicit friend mut get set"
).split()
#: Any number of them. Possessive repeats run as loops and never give back, so a word that is itself
#: the name (``get (x)``, ``async = 1``) must not be taken: no name, bracket or sign follows it.
MOD = r"(?:(?:" + "|".join(MODIFIERS) + r")(?:\([^)]*\))?\s++(?![(=;:,]))*+"
NOT_CALL = r"(?!(?:if|for|while|switch|catch|return|else|new|throw|do|delete|typeof|await|yield|case)\b)"
TYPE = r"[\w.:<>,\[\]&*?~ ]+?"

# --- fixed values: rules per language ----------------------------------------
PYTHON = [
    SymbolRule("python", "import", r"^\s*(?:from|import)\s+([\w.]+)(?:\s+import\b.*|\s*,.*|\s+as\b.*|\s*;?\s*(?:#.*)?)$", rank=0, word="import"),
    SymbolRule("python", "class", r"^\s*class\s+(\w+)", rank=2, word="class"),
    SymbolRule("python", "method", r"^\s*(?:async\s+)?def\s+(\w+)", parents=("class",), word="def"),
    SymbolRule("python", "function", r"^\s*(?:async\s+)?def\s+(\w+)", rank=3, word="def"),
    SymbolRule("python", "constant", r"^(_*[A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)", top=True, rank=1, word="="),
]
JS_MEMBER = r"(?:(?:static|async|get|set|public|private|protected|readonly|abstract|override|declare)\s++(?![(=;:,?!]))*+"


def _script(lang: str) -> list[SymbolRule]:
    return [
        SymbolRule(lang, "import", r"^\s*import\b\s*(?:.*\bfrom\s*)?[\"']([^\"']+)[\"']", rank=0, word="import"),
        SymbolRule(lang, "class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({ID})", rank=2, word="class"),
        SymbolRule(lang, "function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({ID})", rank=3, word="function"),
        SymbolRule(lang, "constant", r"^\s*(?:export\s+)?(?:const|let|var)\s+(_*[A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)", top=True, rank=1, word="="),
        SymbolRule(lang, "method", rf"^\s*{JS_MEMBER}\*?\s*{NOT_CALL}(#?{ID})\s*(?:<[^>]*>)?\(.*\)\s*(?::[^{{]+)?(?:\{{.*)?$", parents=("class",), word="("),
        SymbolRule(lang, "property", rf"^\s*{JS_MEMBER}(#?{ID})[?!]?\s*(?::[^=;]+)?(?:=[^>].*)?;?\s*$", parents=("class",)),
    ]


JAVA_TYPES = ("class", "interface", "enum")
JAVA = [
    SymbolRule("java", "package", r"^\s*package\s+([\w.]+)\s*;", rank=0, word="package"),
    SymbolRule("java", "import", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", rank=1, word="import"),
    SymbolRule("java", "class", rf"^\s*{MOD}class\s+({ID})", rank=2, word="class"),
    SymbolRule("java", "interface", rf"^\s*{MOD}@?interface\s+({ID})", word="interface"),
    SymbolRule("java", "enum", rf"^\s*{MOD}enum\s+({ID})", word="enum"),
    SymbolRule("java", "constructor", rf"^\s*{MOD}{NOT_CALL}({ID})\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\s*\{{", parents=("class",), word="("),
    SymbolRule("java", "method", rf"^\s*{MOD}(?:<[^>]+>\s+)?{NOT_CALL}{TYPE}\s+({ID})\s*\([^)]*\)[^;={{]*[;{{].*$", parents=JAVA_TYPES, word="("),
    SymbolRule("java", "field", rf"^\s*{MOD}{NOT_CALL}[\w.<>,\[\]? ]+\s+({ID})\s*(?:=.*)?;.*$", parents=JAVA_TYPES, word=";"),
    SymbolRule("java", "enum_constant", rf"^\s*({ID})\s*(?:\([^)]*\))?\s*[,;]?\s*(?:{ID}\s*(?:\([^)]*\))?\s*[,;]?\s*)*+$", parents=("enum",)),
]
CPP_SCOPES = ("class", "struct")


def _native(lang: str) -> list[SymbolRule]:
    return [
        SymbolRule(lang, "include", r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", rank=0, word="include"),
        SymbolRule(lang, "namespace", r"^\s*(?:inline\s+)?namespace\s+([\w:]+)", rank=1, word="namespace"),
        SymbolRule(lang, "typedef", r"^\s*typedef\b.*?(\w+)\s*;", word="typedef"),
        SymbolRule(lang, "class", rf"^\s*(?:template\s*<.*>\s*)?class\s+({ID})\s*(?:final\s*)?(?::[^;]*)?(?:\{{.*)?$", rank=2, word="class"),
        SymbolRule(lang, "struct", rf"^\s*(?:template\s*<.*>\s*)?struct\s+({ID})\s*(?:final\s*)?(?::[^;]*)?(?:\{{.*)?$", word="struct"),
        SymbolRule(lang, "enum", rf"^\s*enum\s+(?:class\s+|struct\s+)?({ID})", word="enum"),
        SymbolRule(lang, "method", rf"^\s*{MOD}(?:{TYPE}\s+)?[*&]*{NOT_CALL}(~?{ID})\s*\([^)]*\)[^;={{]*(?:=\s*\w+\s*)?(?:[;{{].*)?$", parents=CPP_SCOPES, word="("),
        SymbolRule(lang, "field", rf"^\s*{MOD}{NOT_CALL}(?!using\b|public:|private:|protected:){TYPE}[\s*&]+({ID})\s*(?:\[[^\]]*\]\s*)*+(?:=.*|\{{.*\}})?;.*$", parents=CPP_SCOPES, word=";"),
        SymbolRule(lang, "enumerator", rf"^\s*({ID})\s*(?:=[^,]+)?,?\s*$", parents=("enum",)),
        SymbolRule(lang, "function", rf"^\s*{MOD}{NOT_CALL}{TYPE}[\s*&]+((?:{ID}::)*+~?{ID})\s*\([^;]*\)[^;={{]*(?:\{{.*)?$", parents=("namespace",), top=True, word="("),
        SymbolRule(lang, "global", rf"^\s*{MOD}{NOT_CALL}(?!using\b|typedef\b|class\b|struct\b|enum\b|template\b){TYPE}[\s*&]+({ID})\s*(?:\[[^\]]*\]\s*)*+(?:=.*)?;.*$", parents=("namespace",), top=True, word=";"),
    ]


VIS = r"(?:pub(?:\([^)]*\))?\s+)?"
RUST = [
    SymbolRule("rust", "mod", rf"^\s*{VIS}mod\s+(\w+)", rank=0, word="mod"),
    SymbolRule("rust", "struct", rf"^\s*{VIS}struct\s+(\w+)", rank=1, word="struct"),
    SymbolRule("rust", "enum", rf"^\s*{VIS}enum\s+(\w+)", word="enum"),
    SymbolRule("rust", "trait", rf"^\s*{VIS}(?:unsafe\s+)?trait\s+(\w+)", rank=2, word="trait"),
    SymbolRule("rust", "impl", r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:.*\bfor\s+)?([\w:]+)", word="impl"),
    SymbolRule("rust", "method", rf"^\s*{VIS}(?:(?:const|unsafe|async|extern(?:\s+\"[^\"]*\")?)\s+)*+fn\s+(\w+)", parents=("impl", "trait"), word="fn"),
    SymbolRule("rust", "function", rf"^\s*{VIS}(?:(?:const|unsafe|async|extern(?:\s+\"[^\"]*\")?)\s+)*+fn\s+(\w+)", word="fn"),
    SymbolRule("rust", "static", rf"^\s*{VIS}static\s+(?:mut\s+)?(\w+)", word="static"),
    SymbolRule("rust", "field", rf"^\s*{VIS}(\w+)\s*:(?!:)\s*[^;]+,?\s*$", parents=("struct",), word=":"),
    SymbolRule("rust", "variant", r"^\s*(\w+)\s*(?:[({].*)?,?\s*$", parents=("enum",)),
]

DEFAULT_RULES: tuple[SymbolRule, ...] = tuple(
    PYTHON + _script("javascript") + _script("typescript") + JAVA + _native("cpp") + _native("c") + RUST
)

# --- fixed values: kinds with members, languages nested by indentation -------
CONTAINERS = ("class", "interface", "enum", "struct", "namespace", "trait", "impl", "mod")
INDENTED = ("python",)


def supported_languages(rules: tuple[SymbolRule, ...] = DEFAULT_RULES) -> list[str]:
    return sorted({r.lang for r in rules})
