"""Spelling variants of the words of a corpus, by a dictionary of trie node pairs.

*Words.* Letters runs are counted in each task and summed by Spark. A run whose checksum with
the id of its document is divisible by ``CUT`` loses one code point, the same one at every place in that document.

*Nodes.* The prefixes of all words are the nodes of a trie, their suffixes those of a reversed
one; both are numbered. A word parted at ``i`` is the pair (node of its first ``i``
code points, node of the rest); a word without the code point at ``i`` is the pair (node
of the first ``i``, node of what is behind it).

*Neighbours.* Two words that differ by a replaced code point have the same pair around it.
If one has a code point more, its pair around that is the pair of a split of
the other. So all neighbours come from equality joins on two integers. A code point in a row of
equal ones is skipped once, at the last, so each neighbour shows up once.

Words around one pair are never joined with each other: a pair knows how many they are and
the most frequent of them, which each of them reads back. A form is at least twice
as frequent as its word, so it is never the word itself. Chains of forms get
shorter by half in each round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces, rows_of
from quire.session import discard, written

CUT = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
FORM_FACTOR = 2
RUN = "[a-zÀ-ÿ]+"
FLUSH = 300_000


def counted(docs: DataFrame, cut: int = CUT) -> DataFrame:
    """``word, n``: the letter runs of ``text`` with A-Z in lower case, one code point cut from some, and how often each occurs."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), docs["text"]).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        runs, seen = re.compile(RUN).findall, Counter()

        def out() -> pa.RecordBatch:
            return rows_of(word=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))

        for batch in pieces(batches):
            ids = batch.column("id").to_pylist()
            for name, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                # Bytes: A-Z only.
                own = Counter(runs(text.as_py().lower().decode()))
                words = list(own)
                start = zlib.crc32(f"{name}:".encode())
                for word, h in zip(words, map(zlib.crc32, map(str.encode, words), repeat(start)), strict=True):
                    if h % cut == 0:
                        k, n = h % len(word), own.pop(word)
                        short = word[:k] + word[k + 1 :]
                        seen[short] += n  # beside the places where the document has the short one itself
                seen.update(own)
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(strings: DataFrame, label: str) -> DataFrame:
    """``s, node``: the distinct strings with a number each, fixed by writing them down."""
    return written(strings.distinct().select("s", F.monotonically_increasing_id().alias("node")), label)


def _best(n: Column, word: Column) -> Column:
    """Orders words by frequency, equal ones by descending code points: the maximum is the form."""
    # UTF-8 keeps the order of code points; the complement of its bytes, ended by one that is above all, turns it round.
    return F.struct(n.alias("n"), F.concat(F.translate(F.hex(word), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")).alias("turned"), word.alias("word"))


def pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``p, s, word, n`` of the splits of every word, and of what is around each code point, with ``last`` of equal ones."""
    size = F.length("word")
    at = F.explode(F.sequence(F.lit(0), size)).alias("i")
    parts = words.select("word", "n", size.alias("size"), at)
    front, back = F.substr("word", F.lit(1), F.col("i")), F.substr("word", F.col("i") + 1, F.col("size"))
    parts = parts.select("word", "n", "size", "i", front.alias("front"), back.alias("back"))
    forward = _numbered(parts.select(F.col("front").alias("s")), "prefixes")
    reversed_ = _numbered(parts.select(F.col("back").alias("s")), "suffixes")
    nodes = parts.join(forward.select(F.col("s").alias("front"), F.col("node").alias("p")), "front")
    nodes = nodes.join(reversed_.select(F.col("s").alias("back"), F.col("node").alias("s")), "back")
    # The nodes of one word, at most its length and one.
    nodes = nodes.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("i", "p", "s"))).alias("x"))
    nodes = written(nodes, "nodes")
    splits = nodes.select("word", "n", F.explode("x").alias("x")).select("x.p", "x.s", "word", "n")
    around = F.transform(
        F.sequence(F.lit(0), F.length("word") - 1),
        lambda i: F.struct(
            F.get("x", i)["p"].alias("p"),
            F.get("x", i + 1)["s"].alias("s"),
            (F.substr("word", i + 1, F.lit(1)) != F.substr("word", i + 2, F.lit(1))).alias("last"),
        ),
    )
    skips = nodes.select("word", "n", F.explode(around).alias("y")).select("y.p", "y.s", "y.last", "word", "n")
    return splits, skips


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: number of near words and the first among them; words without any are left out or have none."""
    splits, skips = pairs(words)
    # Replaced: all words around a pair.
    around = skips.groupBy("p", "s").agg(F.count(F.lit(1)).alias("k"), F.max(_best(F.col("n"), F.col("word"))).alias("best"))
    replaced = skips.join(around.filter("k > 1"), ["p", "s"]).select("word", (F.col("k") - 1).alias("k"), "best")
    replaced = replaced.withColumn("best", F.when(F.col("best.word") != F.col("word"), F.col("best")))
    # One code point more or less: a split is the pair of one word.
    short = splits.select("p", "s", F.col("word").alias("less"), F.col("n").alias("less_n"))
    links = written(skips.filter("last").join(short, ["p", "s"]).select("word", "n", "less", "less_n"), "links")
    one = F.lit(1).cast("bigint").alias("k")
    longer = links.select("word", one, _best(F.col("less_n"), F.col("less")).alias("best"))
    shorter = links.select(F.col("less").alias("word"), one, _best(F.col("n"), F.col("word")).alias("best"))
    every = replaced.unionByName(longer).unionByName(shorter)
    return every.groupBy("word").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms of every word of ``word, form``; forms are strictly more frequent, so there is one."""
    now = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        # A root that has a root of its own; hot ones are split by adaptive execution.
        ends = now.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(
    docs: DataFrame, cut: int = CUT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR
) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: one row per word.

    Needs ``doc_id`` and ``text``, other columns are ignored. A null text has no words, a null
    id counts as empty text. Repeated rows count each. Words have at least ``least_length``
    code points and ``least_count`` occurrences. ``form`` is the near word with the most occurrences, of
    equal ones the first by code points, if it has at least ``factor`` (over 1) times those of the word, else null.
    An empty table gives an empty table.
    """
    words = counted(docs, cut).filter((F.length("word") >= least_length) & (F.col("n") >= least_count))
    words = written(words, "words")
    near = words.join(neighbours(words), "word", "left")
    some = F.col("best.n") >= F.lit(factor) * F.col("n")
    rows = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(some, F.col("best.word")).alias("form"),
        F.when(some, F.col("best.n")).alias("form_n"),
    )
    rows = written(rows, "forms")
    return rows.join(roots(rows), "word")
