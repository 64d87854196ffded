"""Token counters.

``words`` and ``pretokens`` are regular expressions inside the JVM. A byte-pair
vocabulary is a file the user names; each Python worker loads it once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from quire import constants as C
from quire.functions import text as T


def pretoken_count(text: Column) -> Column:
    """Pieces the public cl100k_base pattern cuts a text into."""
    # White space is that of Unicode in the public pattern.
    return F.regexp_count(text, F.lit("(?U)" + C.PRETOKEN_RE)).cast("bigint")


COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words": T.word_count,
    "pretokens": pretoken_count,
}


def token_count(text: Column, counter: str | Callable[[Column], Column] = "words") -> Column:
    return COUNTERS[counter](text) if isinstance(counter, str) else counter(text)


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import pyarrow.fs as pafs
    import tiktoken

    system, inner = pafs.FileSystem.from_uri(vocabulary)
    with system.open_input_stream(inner) as stream:
        rows = stream.read().split(b"\n")
    ranks = {base64.b64decode(tok): int(rank) for tok, rank in (r.split() for r in rows if r)}
    return tiktoken.Encoding("user", pat_str=C.PRETOKEN_RE, mergeable_ranks=ranks, special_tokens={})


def bpe_counter(vocabulary: str) -> Callable[[Column], Column]:
    """Counter for a ``token rank`` file at a URI all executors can read."""

    @pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(vocabulary)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)), na_action="ignore")

    return count
