"""Relations derived from the test tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import scan_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A documents row as a file: hidden, build and plain directories; data, binary,
# upper-case and missing extensions.
PATH_SQL = """concat(case when doc_id % 17 = 0 then 'build' when doc_id % 19 = 0 then '.cache'
    when doc_id % 23 = 0 then '.github' else 'docs' end,
  '/', lang, '/doc_', cast(doc_id as {S}),
  case doc_id % 8 when 0 then '.py' when 1 then '.md' when 2 then '.json' when 3 then '.csv'
    when 4 then '.js' when 5 then '.png' when 6 then '' else '.PY' end)"""

FILES_SQL = f"""(select source as repo_id, doc_id, {PATH_SQL.format(S='varchar')} as path,
  text as content from documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, path, content, doc_id``."""
    return scan_table(table(spark, sf_dir, "documents"), "source", PATH_SQL.format(S="string"), "text", "doc_id")


def raw(rows: DataFrame) -> DataFrame:
    """Text files as ``repo_id, path, size, mtime, content BINARY``, other columns kept."""
    return rows.withColumn("content", F.encode("content", "UTF-8")).withColumns(
        {"size": F.octet_length("content").cast("bigint"), "mtime": F.lit(0.0)}
    )


# Every repository has its own ignore file; the rules depend on its name.
RULE_LINES = (
    "'# rules of ' || source", "''", "'*.csv'", "'/build/'", "'docs/' || lang || '/doc_*7*'",
    "'!doc_?7.py'", "'doc_' || substr(source, 4) || '[0-4]*'",
)
IGNORE_SQL = f"""(select source as repo_id, '.gitignore' as path, {" || chr(10) || ".join(RULE_LINES)} as content
  from (select source, min(lang) as lang from documents group by source) d)"""


def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("lang"))
    return docs.select(
        F.col("source").alias("repo_id"),
        F.lit(".gitignore").alias("path"),
        F.expr(" || '\n' || ".join(RULE_LINES)).alias("content"),
    )


# (ordinal, pattern, negated, regex) as SQL over ``repo_id`` and ``lang``.
RULES_SQL = r"""(select repo_id, ordinal, pattern, negated, regex from (
  select source as repo_id, lang, substr(source, 4) as n from
    (select source, min(lang) as lang from documents group by source) d) r,
  lateral (values
    (2, '*.csv', false, '(?:.+/)?[^/]*\.csv(?:/.*)?'),
    (3, '/build/', false, 'build/.*'),
    (4, 'docs/' || lang || '/doc_*7*', false, 'docs/' || lang || '/doc_[^/]*7[^/]*(?:/.*)?'),
    (5, '!doc_?7.py', true, '(?:.+/)?doc_[^/]7\.py(?:/.*)?'),
    (6, 'doc_' || n || '[0-4]*', false, '(?:.+/)?doc_' || n || '[0-4][^/]*(?:/.*)?')
  ) v(ordinal, pattern, negated, regex))"""

# Two states of the corpus: a tenth of the files is moved (a deletion and an
# addition) and every seventh is edited.
STATE_SQL = {
    "prev": f"""(select source as repo_id, {PATH_SQL.format(S='varchar')} as path, text as content from documents)""",
    "curr": f"""(select source as repo_id,
      case when doc_id % 10 = 1 then 'moved/' else '' end || {PATH_SQL.format(S='varchar')} as path,
      case when doc_id % 7 = 0 then text || chr(10) || 'edited' else text end as content from documents)""",
}


def prev_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir)


def curr_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(files(spark, sf_dir))


def edited(rows: DataFrame) -> DataFrame:
    """The later state of a batch or stream of files."""
    return rows.withColumns(
        {
            "path": F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")),
            "content": F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\nedited"))).otherwise(
                F.col("content")
            ),
        }
    )


def conversations_as_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notebook per conversation: user turns are markdown, others code.

    Every second code cell has its source as an array of lines.
    """
    kind = F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type")
    cell = F.when(
        F.col("turn") % 4 == 1, F.to_json(F.struct(kind, F.array("text").alias("source")))
    ).otherwise(F.to_json(F.struct(kind, F.col("text").alias("source"))))
    cells = table(spark, sf_dir, "conversations").select("conv_id", "turn", cell.alias("cell"))
    return cells.groupBy("conv_id").agg(
        F.concat(
            F.lit('{"nbformat":4,"cells":['),
            F.expr("listagg(cell, ',') within group (order by turn)"),
            F.lit("]}"),
        ).alias("content")
    )


# Pieces of code per part row. ``{k}`` is the key, ``{z}`` the size, as text.
CODE = {
    "python": (
        ".py",
        "import m{z}\nLIMIT_{z} = {k}\n\nclass C{k}(Base):\n    \"\"\"Describes the part number {k}.\"\"\"\n\n"
        "    def run(self, x):\n        return x\n\nasync def f{k}(a, b) -> int:\n    pass\n",
    ),
    "javascript": (
        ".js",
        "import m from './m{z}';\nconst LIMIT_{z} = {k};\nclass C{k} extends Base {\n  size = {z};\n"
        "  static async run(x) {\n    return x;\n  }\n}\nexport function f{k}(a, b) {\n  return a;\n}\n",
    ),
    "java": (
        ".java",
        "package p{z};\nimport java.util.List;\n/** Part {k}. */\npublic final class C{k} extends Base implements I {\n"
        "  private int size;\n  public C{k}(int a) {\n    size = a;\n  }\n"
        "  public int run(int x) throws E{z} {\n    return x;\n  }\n}\ninterface I{k} {\n}\nenum E{k} {\n  ONE,\n  TWO\n}\n",
    ),
    "cpp": (
        ".cpp",
        "#include <m{z}>\nnamespace n{k} {\nclass C{k} : public Base {\n  int size;\n  void run(int x);\n};\n"
        "struct S{k} {\n};\nenum E{k} {\n  ONE,\n};\ntypedef int T{k};\nint g{k} = {z};\nint f{k}(int a) {\n"
        "  int local = a;\n  return local;\n}\n}\n",
    ),
    "rust": (
        ".rs",
        "mod m{z};\npub struct S{k} {\n    size: i32,\n}\nenum E{k} {\n    One,\n}\npub trait T{k} {\n    fn get(&self) -> i32;\n}\n"
        "impl T{k} for S{k} {\n    fn get(&self) -> i32 {\n        1\n    }\n}\npub unsafe fn f{k}(a: i32) -> i32 {\n    a\n}\n"
        "static G{k}: i32 = {z};\n",
    ),
}


def code_files(spark: SparkSession, sf_dir: str, *languages: str) -> DataFrame:
    """One file per part and language: ``repo_id`` is the brand."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.col("p_partkey").cast("string").alias("k"),
        F.col("p_size").cast("string").alias("z"),
    )
    variants = F.array(
        *[
            F.struct(F.lit(lang).alias("code"), F.lit(ext).alias("ext"), F.lit(body).alias("body"))
            for lang, (ext, body) in CODE.items()
            if not languages or lang in languages
        ]
    )
    # The keys are small and the files made from them are not: spread them first.
    rows = part.repartition(spark.sparkContext.defaultParallelism).select("*", F.inline(variants))
    return rows.select(
        "repo_id",
        F.concat(F.lit("src/C"), "k", "ext").alias("path"),
        F.replace(F.replace("body", F.lit("{k}"), F.col("k")), F.lit("{z}"), F.col("z")).alias("content"),
    )


def code_text_sql(lang: str) -> str:
    """The same file text as a DuckDB expression over ``part``."""
    quoted = CODE[lang][1].replace("'", "''").replace("\n", "' || chr(10) || '")
    return (
        "replace(replace('" + quoted + "', '{k}', cast(p_partkey as varchar)), '{z}', cast(p_size as varchar))"
    )


# Selected paths: two language directories in every repository, and single files
# that carry a quality label.
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    dirs = rows.filter(F.col("path").rlike(r"^docs/(?:en|fr)/")).select(
        "repo_id", F.regexp_extract("path", r"^(docs/[a-z]+)/", 1).alias("path"), F.lit(True).alias("is_dir")
    )
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    singles = rows.join(good, "doc_id", "left_semi").select("repo_id", "path", F.lit(False).alias("is_dir"))
    return dirs.distinct().unionByName(singles)


SELECTION_SQL = f"""(select distinct repo_id, regexp_extract(path, '^(docs/[a-z]+)/', 1) as path, true as is_dir
    from {FILES_SQL} where regexp_matches(path, '^docs/(?:en|fr)/')
  union all
  select repo_id, path, false from {FILES_SQL} where doc_id in (select doc_id from labels where quality = 1))"""

SELECTED_SQL = f"""(select distinct f.repo_id, f.path from {FILES_SQL} f, {SELECTION_SQL} s
  where f.repo_id = s.repo_id and ((s.is_dir and starts_with(f.path, s.path || '/')) or (not s.is_dir and f.path = s.path)))"""
