"""Code of notebook documents, read as semi-structured values in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C

ERROR_PREFIX = "# ERROR PROCESSING NOTEBOOK: "


def is_notebook_path(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".ipynb"))


def _cells(doc: str) -> str:
    """Cells as (type, source); a source is a string or an array of strings."""
    return f"""
      transform(try_variant_get({doc}, '$.cells', 'array<variant>'), c -> named_struct(
        'type', try_variant_get(c, '$.cell_type', 'string'),
        'source', if(startswith(schema_of_variant(variant_get(c, '$.source')), 'ARRAY'),
                     array_join(try_variant_get(c, '$.source', 'array<string>'), ''),
                     try_variant_get(c, '$.source', 'string'))))"""


def notebook_code(content: str) -> Column:
    """Sources of the code cells in order, a blank line between two, stripped.

    A text without the format key is not a notebook and is returned as it is; a
    text that has it but is no JSON document gives an error line.
    """
    doc = f"try_parse_json({content})"
    joined = F.expr(
        f"array_join(transform(filter({_cells(doc)}, c -> c.type = 'code'), c -> c.source), '\\n\\n')"
    )
    stripped = F.regexp_replace(joined, rf"\A[{C.SPACES}]+|[{C.SPACES}]+\z", "")
    bad = F.expr(f"{doc} is null")
    return (
        F.when(~F.contains(F.col(content), F.lit('"nbformat"')), F.col(content))
        .when(bad, F.lit(ERROR_PREFIX + "not a JSON document\n"))
        .otherwise(F.coalesce(stripped, F.lit("")))
    )


def code_cell_count(content: str) -> Column:
    doc = f"try_parse_json({content})"
    return F.expr(f"coalesce(size(filter({_cells(doc)}, c -> c.type = 'code')), 0)").cast("bigint")
