"""Text of HTML pages.

Plain pages stay in SQL expressions. Pages on which those could go wrong
(nested or unclosed dropped elements, rare entities, ``>`` inside an attribute)
are handed to the standard library's parser; the test decides per page and only
those pages leave the JVM.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quire import constants as C

# --- fixed values: entities decoded in SQL, elements without an end tag ------
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
VOID_ELEMENTS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
TAG_RE = r"<[/!?a-zA-Z][^>]*>"
# Text no tag is looked for in; the first opener wins.
OPAQUE_RE = r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->"
BLOCKS = "|".join(C.DROPPED_ELEMENTS[2:])
BLOCK_RE = rf"(?is)<({BLOCKS})(?:\s[^>]*)?>.*?</\1\s*>"
BLOCK_TAG_RE = rf"(?i)<(/?(?:{BLOCKS}))(?=[\s/>])"
PAIRED_RE = rf"(?i)\A(?:({BLOCKS}) /\1 )*+\z"
RARE_RE = (
    r"(?i)&(?!(?:amp|lt|gt|quot|apos|nbsp|copy|middot);)[#a-z]"  # other entities
    r"|=\s*\"[^\"<>]*>[^\"]*\"|=\s*'[^'<>]*>[^']*'"  # '>' in an attribute
    r"|<!\[|<!--|</?(?:script|style|textarea|plaintext|xmp|iframe|noembed|noframes)\b"
)


def _needs_parser(bare: Column) -> Column:
    """True if the SQL form is not sure to agree with a parser.

    ``bare`` is the page without scripts, styles and comments. The dropped
    elements must be closed one by one, without nesting.
    """
    tags = F.regexp_extract_all(bare, F.lit(BLOCK_TAG_RE), F.lit(1))
    sequence = F.array_join(F.transform(tags, lambda t: F.concat(F.lower(t), F.lit(" "))), "")
    return F.rlike(bare, F.lit(RARE_RE)) | ~F.rlike(sequence, F.lit(PAIRED_RE))


def _plain_text(bare: Column) -> Column:
    nodes = F.split(F.regexp_replace(bare, BLOCK_RE, "<!>"), TAG_RE, -1)

    def clean(node: Column) -> Column:
        decoded = node
        for entity, char in ENTITIES.items():
            decoded = F.replace(decoded, F.lit(entity), F.lit(char))
        decoded = F.when(F.contains(node, F.lit("&")), decoded).otherwise(node)
        return F.regexp_replace(decoded, rf"\A[{C.SPACES}]+|[{C.SPACES}]+\z", "")

    return F.array_join(F.filter(F.transform(nodes, clean), lambda x: x != ""), "\n")


class _TextNodes(HTMLParser):
    """Collects the text nodes outside the dropped elements.

    The parser hands over text in pieces; a node ends at the next tag or comment.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pieces: list[str] = []
        self.nodes: list[str] = []

    def end_node(self, *_) -> None:
        node = "".join(self.pieces).strip()
        self.pieces.clear()
        if node:
            self.nodes.append(node)

    handle_comment = handle_decl = handle_pi = unknown_decl = handle_startendtag = end_node

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in VOID_ELEMENTS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not any(tag in C.DROPPED_ELEMENTS for tag in self.open):
            self.pieces.append(data)


def parsed_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser.end_node()
    return "\n".join(parser.nodes)


@pandas_udf(StringType())
def _parser_text(pages: pd.Series) -> pd.Series:
    return pages.map(parsed_text, na_action="ignore")


def with_page_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the text nodes of a page, stripped, one per line."""
    staged = pages.withColumn("_bare", F.regexp_replace(html, OPAQUE_RE, "<!>"))
    staged = staged.withColumn("_odd", _needs_parser(F.col("_bare")))
    # Plain pages reach Python as nulls.
    staged = staged.withColumn("_parsed", _parser_text(F.when(F.col("_odd"), F.col(html))))
    out = F.when(F.col("_odd"), F.col("_parsed")).otherwise(_plain_text(F.col("_bare")))
    return staged.withColumn(text, out).drop("_bare", "_odd", "_parsed")
