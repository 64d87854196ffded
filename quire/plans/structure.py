"""Queries of the symbol scan over source files made from the part table.

The oracles state the expected symbols straight from the keys of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import symbols as S
from quire.operators.symbol_rules import DEFAULT_RULES, SymbolRule
from quire.plans import inputs as I
from quire.plans.registry import query

# (line, kind, name, signature, parent, modifiers, doc) per language; {k} and {z}
# are the key and the size of the part.
EXPECTED = {
    "python": [
        (1, "import", "m{z}", "import m{z}", None, "", None),
        (2, "constant", "LIMIT_{z}", "LIMIT_{z} = {k}", None, "", None),
        (4, "class", "C{k}", "class C{k}(Base)", None, "", "Describes the part number {k}."),
        (7, "method", "run", "def run(self, x)", "C{k}", "", None),
        (10, "function", "f{k}", "async def f{k}(a, b) -> int", None, "async", None),
    ],
    "javascript": [
        (1, "import", "./m{z}", "import m from './m{z}'", None, "", None),
        (2, "constant", "LIMIT_{z}", "const LIMIT_{z} = {k}", None, "const", None),
        (3, "class", "C{k}", "class C{k} extends Base", None, "", None),
        (4, "property", "size", "size = {z}", "C{k}", "", None),
        (5, "method", "run", "static async run(x)", "C{k}", "static async", None),
        (9, "function", "f{k}", "export function f{k}(a, b)", None, "export", None),
    ],
    "java": [
        (1, "package", "p{z}", "package p{z}", None, "", None),
        (2, "import", "java.util.List", "import java.util.List", None, "", None),
        (4, "class", "C{k}", "public final class C{k} extends Base implements I", None, "public final", None),
        (5, "field", "size", "private int size", "C{k}", "private", None),
        (6, "constructor", "C{k}", "public C{k}(int a)", "C{k}", "public", None),
        (9, "method", "run", "public int run(int x) throws E{z}", "C{k}", "public", None),
        (13, "interface", "I{k}", "interface I{k}", None, "", None),
        (15, "enum", "E{k}", "enum E{k}", None, "", None),
        (16, "enum_constant", "ONE", "ONE,", "E{k}", "", None),
        (17, "enum_constant", "TWO", "TWO", "E{k}", "", None),
    ],
    "cpp": [
        (1, "include", "m{z}", "#include <m{z}>", None, "", None),
        (2, "namespace", "n{k}", "namespace n{k}", None, "", None),
        (3, "class", "C{k}", "class C{k} : public Base", None, "", None),
        (4, "field", "size", "int size", "C{k}", "", None),
        (5, "method", "run", "void run(int x)", "C{k}", "", None),
        (7, "struct", "S{k}", "struct S{k}", None, "", None),
        (9, "enum", "E{k}", "enum E{k}", None, "", None),
        (10, "enumerator", "ONE", "ONE,", "E{k}", "", None),
        (12, "typedef", "T{k}", "typedef int T{k}", None, "", None),
        (13, "global", "g{k}", "int g{k} = {z}", "n{k}", "", None),
        (14, "function", "f{k}", "int f{k}(int a)", "n{k}", "", None),
    ],
    "rust": [
        (1, "mod", "m{z}", "mod m{z}", None, "", None),
        (2, "struct", "S{k}", "pub struct S{k}", None, "pub", None),
        (3, "field", "size", "size: i32,", "S{k}", "", None),
        (5, "enum", "E{k}", "enum E{k}", None, "", None),
        (6, "variant", "One", "One,", "E{k}", "", None),
        (8, "trait", "T{k}", "pub trait T{k}", None, "pub", None),
        (9, "method", "get", "fn get(&self) -> i32", "T{k}", "", None),
        (11, "impl", "S{k}", "impl T{k} for S{k}", None, "", None),
        (12, "method", "get", "fn get(&self) -> i32", "S{k}", "", None),
        (16, "function", "f{k}", "pub unsafe fn f{k}(a: i32) -> i32", None, "pub unsafe", None),
        (19, "static", "G{k}", "static G{k}: i32 = {z}", None, "static", None),
    ],
}


def text_sql(template: str | None) -> str:
    if template is None:
        return "cast(null as varchar)"
    quoted = template.replace("'", "''")
    return f"replace(replace('{quoted}', '{{k}}', cast(p_partkey as varchar)), '{{z}}', cast(p_size as varchar))"


def path_sql(lang: str) -> str:
    return f"'src/C' || p_partkey || '{I.CODE[lang][0]}'"


def expected_sql(lang: str, where=lambda row: True) -> str:
    return " union all ".join(
        f"""select p_brand as repo_id, {path_sql(lang)} as path, {line} as line_no, '{kind}' as kind, {text_sql(name)} as name,
            {text_sql(signature)} as signature, {text_sql(parent)} as parent, '{modifiers}' as modifiers, {text_sql(doc)} as doc from part"""
        for line, kind, name, signature, parent, modifiers, doc in filter(where, EXPECTED[lang])
    )


def shown(symbols):
    return symbols.select(
        "repo_id", "path", "line_no", "kind", "name", "signature", "parent",
        F.array_join("modifiers", " ").alias("modifiers"), "doc",
    )


def on_language(name: str, lang: str) -> None:
    @query(name, expected_sql(lang))
    def run(spark, sf_dir):
        return shown(S.symbols(I.code_files(spark, sf_dir, lang), language=lang))


on_language("symbols_python", "python")
on_language("symbols_js", "javascript")
on_language("symbols_java", "java")
on_language("symbols_cpp", "cpp")
on_language("symbols_rust", "rust")


@query(
    "symbol_parent",
    " union all ".join(
        f"select repo_id, path, line_no, name, parent from ({expected_sql(lang, lambda r: r[4] is not None)}) t" for lang in EXPECTED
    ),
)
def symbol_parent(spark, sf_dir):
    rows = S.symbols(I.code_files(spark, sf_dir)).filter("parent is not null")
    return rows.select("repo_id", "path", "line_no", "name", "parent")


@query(
    "symbol_signature",
    " union all ".join(f"select repo_id, path, line_no, signature from ({expected_sql(lang)}) t" for lang in EXPECTED),
)
def symbol_signature(spark, sf_dir):
    return S.symbols(I.code_files(spark, sf_dir)).select("repo_id", "path", "line_no", "signature")


@query(
    "symbol_comment",
    f"select p_brand as repo_id, {path_sql('java')} as path, 4 as line_no, 'Part ' || p_partkey || '.' as comment from part",
)
def symbol_comment(spark, sf_dir):
    rows = S.symbols(I.code_files(spark, sf_dir)).filter("comment is not null")
    return rows.select("repo_id", "path", "line_no", "comment")


# --- expected summaries of the generated files ---------------------------------
SUMMARIES = {
    "python": "import m{z}\n\nLIMIT_{z} = {k}\n\nclass C{k}(Base):\n    \"\"\"Describes the part number {k}.\"\"\"\n"
    "    def run(self, x):\n\nasync def f{k}(a, b) -> int:\n",
    "javascript": "import m from './m{z}';\n\nconst LIMIT_{z} = {k};\n\nclass C{k} extends Base {\n    size = {z};\n"
    "    static async run(x)\n}\n\nexport function f{k}(a, b)\n",
    "java": "package p{z};\n\nimport java.util.List;\n\npublic final class C{k} extends Base implements I {\n"
    "    private int size;\n    public C{k}(int a)\n    public int run(int x) throws E{z}\n}\n",
    "cpp": "#include <m{z}>\n\nnamespace n{k} {\n    int g{k} = {z};\n    int f{k}(int a)\n}\n\nclass C{k} : public Base {\n"
    "    int size;\n    void run(int x)\n}\n",
    "rust": "mod m{z}\n\npub struct S{k}\n    size: i32,\n\npub trait T{k}\n    fn get(&self) -> i32\n",
}


def summary_sql(lang: str) -> str:
    body = SUMMARIES[lang].replace("'", "''").replace("\n", "' || chr(10) || '")
    return (
        f"'# File: ' || {path_sql(lang)} || chr(10) || '# Language: {lang}' || chr(10) || chr(10) || "
        f"replace(replace('{body}', '{{k}}', cast(p_partkey as varchar)), '{{z}}', cast(p_size as varchar))"
    )


@query(
    "structure_summary",
    " union all ".join(f"select p_brand as repo_id, {path_sql(lang)} as path, {summary_sql(lang)} as summary from part" for lang in SUMMARIES),
)
def structure_summary(spark, sf_dir):
    return S.summaries(I.code_files(spark, sf_dir))


@query(
    "summary_or_full",
    " union all ".join(
        [f"select p_brand as repo_id, {path_sql(lang)} as path, true as is_summary, {summary_sql(lang)} as content from part" for lang in SUMMARIES]
        + ["select 'notes' as repo_id, 'part/' || p_partkey || '.txt' as path, false, p_name from part"]
    ),
)
def summary_or_full(spark, sf_dir):
    """Source files and plain notes together; notes have no language."""
    notes = I.table(spark, sf_dir, "part").select(
        F.lit("notes").alias("repo_id"),
        F.concat(F.lit("part/"), "p_partkey", F.lit(".txt")).alias("path"),
        F.col("p_name").alias("content"),
    )
    return S.summary_or_full(I.code_files(spark, sf_dir).unionByName(notes))


EXTRA = (SymbolRule("python", "return", r"^\s*return\s+(\w+)"),)


@query(
    "symbol_rules_custom",
    f"""select repo_id, path, line_no, kind, name from ({expected_sql('python')}) t
        union all select p_brand, {path_sql('python')}, 8, 'return', 'x' from part""",
)
def symbol_rules_custom(spark, sf_dir):
    """A user's own rule next to the built-in ones."""
    rows = S.symbols(I.code_files(spark, sf_dir, "python"), DEFAULT_RULES + EXTRA)
    return rows.select("repo_id", "path", "line_no", "kind", "name")
