"""The symbol scan on hand-made sources in every language family."""

import random
import re

import numpy as np
import pytest

from quire.operators import symbols as S
from quire.operators.symbol_rules import DEFAULT_RULES, SymbolRule, supported_languages

SOURCES = {
    "a.py": (
        'import os, sys\nfrom a.b import (c,\n   d)\nMAX = 3\nlow = 1\n\nclass A(Base, metaclass=M):\n'
        '    """Doc of A which is long enough."""\n    X = 1\n\n    def run(self, x: int) -> str:\n'
        "        '''short\n        second line'''\n        def inner(): pass\n        return x\n\n"
        '    async def go(self,\n                 y={"a": 1},\n                 ):\n        pass\n\n'
        'if True:\n    def g(a): return 1\n\ndef f(a, b):\n    # c\n    "one"\n    pass\n'
    ),
    "b.ts": (
        'import x from "./m";\nexport const LIMIT = 5;\nconst other = 1;\nclass A extends B {\n  count = 0;\n'
        "  static async go(a, b) {\n    if (a) { return f(b); }\n    call(a);\n  }\n  #priv(x) { }\n}\n"
        "export default async function main(a) {\n}\n"
    ),
    "C.java": (
        "package a.b;\nimport java.util.List;\n/** A doc.\n * more\n * @author me\n */\n"
        "public final class C extends Base implements I, J {\n    private static final int N = 3;\n    // make\n"
        "    public C(int a) throws E { this.a = a; }\n    public List<String> run(int x,\n        String y) throws E {\n"
        "        foo(x);\n        return bar;\n    }\n}\ninterface I {\n    void m(int a);\n}\nenum D {\n    A, B(1, 2),\n    C\n}\nenum F { X, Y(3) }\n"
    ),
    "k.h": (
        "#include <stdio.h>\nstruct P\n{\n    double x;\n};\nenum E {\n    ONE = 1,\n    TWO\n};\ntypedef int T;\nint g = 3;\n"
        "static int add(int a, int b)\n{\n    int local = a;\n    return local + b;\n}\n"
    ),
    "s.rs": (
        "pub mod m {\n    pub fn in_mod() {}\n}\npub struct S<T> {\n    pub a: i32,\n}\nenum E {\n    A,\n    B(i32),\n}\n"
        "pub trait Tr {\n    fn m(&self) -> i32;\n}\nimpl<T> Tr for S<T> {\n    fn m(&self) -> i32 { 1 }\n}\n"
        "// doc\npub async unsafe fn top(a: i32) -> i32 { 2 }\nstatic mut G: i32 = 1;\n"
    ),
}
WANT = {
    "a.py": [
        (1, "import", "os", None, None), (2, "import", "a.b", None, None), (4, "constant", "MAX", None, None),
        (7, "class", "A", None, "Doc of A which is long enough."), (11, "method", "run", "A", "short\nsecond line"),
        (14, "function", "inner", None, None), (17, "method", "go", "A", None), (23, "function", "g", None, None),
        (25, "function", "f", None, "one"),
    ],
    "b.ts": [
        (1, "import", "./m", None, None), (2, "constant", "LIMIT", None, None), (4, "class", "A", None, None),
        (5, "property", "count", "A", None), (6, "method", "go", "A", None), (10, "method", "#priv", "A", None),
        (12, "function", "main", None, None),
    ],
    "C.java": [
        (1, "package", "a.b", None, None), (2, "import", "java.util.List", None, None), (7, "class", "C", None, None),
        (8, "field", "N", "C", None), (10, "constructor", "C", "C", None), (11, "method", "run", "C", None),
        (17, "interface", "I", None, None), (18, "method", "m", "I", None), (20, "enum", "D", None, None),
        (21, "enum_constant", "A", "D", None), (21, "enum_constant", "B", "D", None), (22, "enum_constant", "C", "D", None),
        (24, "enum", "F", None, None), (24, "enum_constant", "X", "F", None), (24, "enum_constant", "Y", "F", None),
    ],
    "k.h": [
        (1, "include", "stdio.h", None, None), (2, "struct", "P", None, None), (4, "field", "x", "P", None),
        (6, "enum", "E", None, None), (7, "enumerator", "ONE", "E", None), (8, "enumerator", "TWO", "E", None),
        (10, "typedef", "T", None, None), (11, "global", "g", None, None), (12, "function", "add", None, None),
    ],
    "s.rs": [
        (1, "mod", "m", None, None), (2, "function", "in_mod", None, None), (4, "struct", "S", None, None),
        (5, "field", "a", "S", None), (7, "enum", "E", None, None), (8, "variant", "A", "E", None),
        (9, "variant", "B", "E", None), (11, "trait", "Tr", None, None), (12, "method", "m", "Tr", None),
        (14, "impl", "S", None, None), (15, "method", "m", "S", None), (17 + 1, "function", "top", None, None),
        (19, "static", "G", None, None),
    ],
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, t) for p, t in SOURCES.items()] + [("r", "e.py", ""), ("r", "d.md", "class X:"), ("r", "run", "#!/usr/bin/env python\ndef x(): pass")]
    return spark.createDataFrame(rows, "repo_id string, path string, content string")


@pytest.fixture(scope="module")
def found(files):
    return S.symbols(files).collect()


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_symbols(found, path):
    got = sorted((r.line_no, r.kind, r.name, r.parent, r.doc) for r in found if r.path == path)
    assert got == WANT[path]


def test_details(found):
    by = {(r.path, r.line_no): r for r in found}
    assert by["a.py", 2].signature == "from a.b import (c, d)"
    assert by["a.py", 17].signature == 'async def go(self, y={"a": 1}, )'
    assert by["C.java", 11].signature == "public List<String> run(int x, String y) throws E"
    assert by["C.java", 7].comment == "A doc. more" and by["C.java", 10].comment == "make"
    assert list(by["C.java", 8].modifiers) == ["private", "static", "final"]
    assert list(by["s.rs", 18].modifiers) == ["pub", "async", "unsafe"] and by["s.rs", 18].comment == "doc"
    assert by["run", 2].name == "x" and ("d.md", 1) not in by


def test_summaries(files):
    got = {r.path: r.summary for r in S.summaries(files).collect()}
    assert set(got) == {*SOURCES, "e.py", "run"}
    assert got["e.py"] == "# File: e.py\n# Language: python\n\n"
    assert got["b.ts"] == (
        '# File: b.ts\n# Language: typescript\n\nimport x from "./m";\n\nexport const LIMIT = 5;\n\n'
        "class A extends B {\n    count = 0;\n    static async go(a, b)\n    #priv(x)\n}\n\nexport default async function main(a)\n"
    )
    everything = {r.path: r.summary for r in S.summaries(files, all_kinds=True).collect()}
    assert "interface I {\n    void m(int a)\n}" in everything["C.java"] and "interface I" not in got["C.java"]


def test_fall_back_to_full_content(files):
    got = {r.path: r for r in S.summary_or_full(files).collect()}
    assert got["d.md"].content == "class X:" and not got["d.md"].is_summary and got["a.py"].is_summary


def test_user_rules(spark):
    rules = DEFAULT_RULES + (SymbolRule("go", "function", r"^func\s+(\w+)"), SymbolRule("python", "todo", r"^\s*raise\s+(\w+)"))
    assert "go" in supported_languages(rules)
    df = spark.createDataFrame([("r", "a.py", "def f():\n    raise Todo\n")], "repo_id string, path string, content string")
    assert {(r.kind, r.name) for r in S.symbols(df, rules).collect()} == {("function", "f"), ("todo", "Todo")}


def plain_links(levels, deltas, parens, marks):
    """Line by line, with stacks."""
    n = len(levels)
    depth, parent, stop, nxt, comment = [0] * n, [-1] * n, list(range(n)), [-1] * n, [-1] * n
    stack, waiting, pending, block, braces, opened = [], [], [], -1, 0, 0
    for i in range(n):
        level = levels[i] if deltas is None or levels[i] == -1 else braces
        if deltas is not None:
            braces = max(braces + deltas[i], 0)
        depth[i] = level if level != -1 else 0
        comment[i] = block
        block = (block if marks[i] == 2 else i) if marks[i] else -1
        if level != -1 and not waiting:
            while stack and depth[stack[-1]] >= level:
                stack.pop()
            parent[i] = stack[-1] if stack else -1
            stack.append(i)
        if level != -1:
            for j in pending:
                nxt[j] = i
            pending = []
        pending.append(i)
        if parens[i] > 0:
            waiting.append((i, opened))
        opened += parens[i]
        while waiting and opened <= waiting[-1][1]:
            stop[waiting.pop()[0]] = i
    return [depth, parent, stop, nxt, comment]


def test_links_against_a_line_loop():
    rng = random.Random(7)
    for _ in range(300):
        files = []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(1, 25)
            pick = lambda *x: [rng.choice(x) for _ in range(n)]  # noqa: B023, E731
            braced = rng.random() < 0.5
            marks = pick(0, 0, 1, 2)
            for i, m in enumerate(marks):  # a comment goes on only where one is open
                if m == 2 and (not i or not marks[i - 1]):
                    marks[i] = 0
            files.append((pick(-1, 0, 0) if braced else pick(-1, 0, 1, 2, 4), pick(-2, -1, 0, 0, 1, 2) if braced else None, pick(-2, -1, 0, 0, 0, 1, 2), marks))
        flat = lambda k: np.concatenate([np.array(f[k] if f[k] is not None else [0] * len(f[0])) for f in files])
        sizes = [len(f[0]) for f in files]
        got = S.link_files(sizes, flat(0), flat(1), flat(2), flat(3), flat(2) * 0 > 0, np.concatenate([[f[1] is not None] * len(f[0]) for f in files]))
        want = [sum(x, []) for x in zip(*(plain_links(*f) for f in files), strict=True)]
        assert [g.tolist() for g in got[:5]] == want


def test_nothing_out_of_strings_and_comments(spark):
    """Definitions inside strings and comments over several lines are none; what follows them is."""
    files = {
        "a.py": "S = '''\nclass Fake:\n    def no(self): pass\n'''\nclass Real:\n    \"\"\"\n    class Fake2:\n    # no\n    \"\"\"\n    def yes(self):\n        r\"\"\"Whole\n        doc.\"\"\"\nT = \"\"\"a \\\"\"\" def no2(): \"\"\"\ndef last(): pass\n",
        "b.ts": "const T = `\nclass Fake {\n  no() {\n`;\n/*\nfunction fake() {\n*/\nclass Real {\n  yes() { return `}`; }\n}\nfunction last() {}\n",
        "C.java": 'class Real {\n  String s = """\n    class Fake {\n    """;\n  /* int no;\n  class Fake2 { */\n  int yes;\n}\n',
        "d.cpp": 'const char* s = R"x(\nclass Fake {\n)" )x";\n/*\nint no;\n*/\nclass Real {\n  int yes;\n};\n',
        "e.rs": "static S: &str = r#\"\nfn fake() {\n\"\n\"#;\nstatic T: &str = \"a\n struct Fake {\";\nfn real<'a>(x: &'a str) -> char {\n  '{'\n}\nfn last() {}\n",
    }
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_id string, path string, content string")
    rows = S.symbols(df).collect()
    names = {p: {(r.name, r.parent) for r in rows if r.path == p} for p in files}
    assert names["a.py"] == {("S", None), ("T", None), ("Real", None), ("yes", "Real"), ("last", None)}
    assert names["b.ts"] == {("T", None), ("Real", None), ("yes", "Real"), ("last", None)}
    assert names["C.java"] == {("Real", None), ("s", "Real"), ("yes", "Real")}
    assert names["d.cpp"] == {("s", None), ("Real", None), ("yes", "Real")}
    assert names["e.rs"] == {("S", None), ("T", None), ("real", None), ("last", None)}
    docs = {r.name: r.doc for r in rows if r.path == "a.py"}
    assert docs["yes"] == "Whole\ndoc." and docs["Real"] == "class Fake2:\n# no"


def test_no_cap_on_modifiers_scopes_or_comments(spark):
    scopes = "".join(f"n{i}::" for i in range(100))
    files = {
        "a.cpp": f"int {scopes}far(int a) {{\n}}\nint g{'[2]' * 40} = {{}};\n",
        "B.java": "class B {\n  // " + "word " * 100 + "\n  " + "static " * 100_000 + "int x;\n}\n",
        "c.js": "class C {\n  get (x) { }\n  async = 1;\n  static get size() { }\n}\n",
        "d.py": "def f():\n    '''" + "long line " * 50 + "\n    more'''\n",
    }
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_id string, path string, content string")
    by = {(r.path, r.name): r for r in S.symbols(df).collect()}
    assert ("a.cpp", scopes + "far") in by and ("a.cpp", "g") in by
    assert by["B.java", "x"].comment == ("word " * 100).strip() and len(by["B.java", "x"].modifiers) == 100_000
    assert {n for p, n in by if p == "c.js"} == {"C", "get", "async", "size"}
    assert by["d.py", "f"].doc == ("long line " * 50).strip() + "\nmore"
    printed = {r.path: r.summary for r in S.summaries(df).collect()}
    assert ("long line " * 10).strip() in printed["d.py"] and "more" not in printed["d.py"]


def test_long_lines_end_no_executor(spark):
    """One literal, one enum or one run of modifiers of any length."""
    from quire.functions.html import with_page_text
    from quire.operators.symbols import symbols

    files = {
        "A.java": 'class A {\n  String s = "' + "x" * 1_000_000 + '";\n  void f() {}\n}\n',
        "E.java": "enum E {\n  " + ", ".join(f"C{i}" for i in range(20_000)) + ";\n}\n",
        "M.java": "class M {\n  " + "static " * 50_000 + "int x;\n}\n",
    }
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_id string, path string, content string")
    assert {r.name for r in symbols(df).collect()} >= {"A", "E", "M", "f"}
    page = spark.createDataFrame([("<form>a</form>" * 50_000 + "<p>kept</p>",)], "html string")
    assert with_page_text(page).first().text == "kept"


def test_names_are_taken_by_constant_patterns(spark):
    files = spark.createDataFrame([("r", "a.py", "class A:\n    def run(self):\n        pass\n")], "repo_id string, path string, content string")
    found = S.symbols(files)
    assert {(r.name, r.parent) for r in found.collect()} == {("A", None), ("run", "A")}
    assert "StructField(regex," not in found._jdf.queryExecution().analyzed().toString()


def test_line_table_against_plain_lines():
    texts = ["a(b) {\n  {\n\t\n } x\n  {  \n\u0001 y()\n", "", "\u00e4 = (\n \t z:\n\t# c\n)\n  \n~d", "{", "  {x\n#e  "]
    for indented in (True, False):
        lines = [x for t in texts for x in t.split("\n")]
        levels, braces, parens, inner, start = S.line_table(texts, np.full(len(lines), indented))
        for x, level, brace, paren, within, begins in zip(lines, levels, braces, parens, inner, start, strict=True):
            blank = x.startswith(S.INNER) or not x.strip(" ") or (not indented and x.strip(" ") == "{")
            assert level == (-1 if blank else len(x) - len(x.lstrip(" \t")) if indented else 0)
            assert brace == (0 if indented else x.count("{") - x.count("}")) and paren == x.count("(") - x.count(")")
            assert within == x.startswith(S.INNER) and begins == bool(re.match(r"\s*[A-Za-z0-9_#@~$*]", x))


def test_rules_of_each_language_are_a_method_of_their_own(spark):
    """One method with the rules of all languages is longer than the JVM compiles."""
    files = spark.createDataFrame([("r", "a.py", "class A:\n    def run(self):\n        pass\n")], "repo_id string, path string, content string")
    plan = S.symbols(files)._jdf.queryExecution().optimizedPlan().toString()
    tests = [x for x in plan.split("\n") if "Generate explode" in x and "RLIKE" in x]
    assert len(tests) > len(S.supported_languages()) and all(len(set(re.findall(r"code_lang#\d+L? = (\w+)", x))) == 1 for x in tests)
