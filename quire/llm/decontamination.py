"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame operations only.

A window is what has to be found: ``window`` consecutive words of an item, or all
words of a shorter item. A document contains a window only if it contains all its
shingles, so one necessary shingle, the prefix, is enough to find every candidate.
Shingles are ordered by their frequency in the documents and the rarest of a
window is its prefix. A candidate fixes the window's place in the document; the
place must lie inside the document (position and length bounds), and the words
there must be equal to those of the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, bounded, packed
from quire.session import written

WINDOW = 10
SHINGLE = 3
#: Between words: all ASCII but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in lower case; null has none."""
    return F.coalesce(F.filter(F.split(text, GAP, -1), lambda w: w != ""), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """``words, size, q, item_ids``: the distinct windows with the items they come from."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(ascii_lower(F.col("text"))).alias("w"))
    cut = F.expr(f"transform(sequence(1, greatest(size(w) - {window - 1}, 1)), i -> slice(w, i, {window}))")
    return (
        items.filter("size(w) > 0")
        .select("item_id", F.explode(cut).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        .select("words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(shingle)).alias("q"), "item_ids")
    )


def shingles(words: str, q: int) -> Column:
    """One struct ``w0, w1, ...`` of neighbouring words per word, with nulls where the text ends."""
    rest = [F.slice(words, i + 1, 2147483647).alias(f"w{i}") for i in range(1, q)]
    return F.arrays_zip(F.col(words).alias("w0"), *rest)


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``_doc, n_words, n_hit, item_ids``: the row, its words, those inside a window, items that occur.

    Needs ``text`` in ``docs``, ``item_id`` and ``text`` in ``benchmark``; other
    columns stay in ``_doc``. Null texts and texts without a word have no hit.
    Items without a word are never found, items with a null id count but are not
    listed. Equal windows of several items are found for each of them; repeated
    items with one id count once. Empty tables give no hits.
    """
    windows = written(windows_of(benchmark, window, shingle).withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = [r.q for r in windows.select("q").distinct().collect()]  # at most `shingle` values
    plain = docs.select(
        F.sha2("text", 256).alias("_key"),
        F.split(ascii_lower(F.col("text")), GAP, -1).alias("s"),
    ).filter("_key is not null")
    plain = plain.select("_key", F.expr("slice(s, if(s[0] = '', 2, 1), size(s))").alias("s"))
    matches = []
    for q in sizes:
        own = windows.filter(F.col("q") == q).select("window", F.col("words").alias("w"))
        named = own.select("window", F.posexplode(shingles("w", q)).alias("offset", "shingle"))
        named = named.select("window", "offset", _hash("shingle", q).alias("h")).filter("h is not null")
        known = bounded(written(named.select("h").distinct(), "shingles"))
        place = plain.select("_key", F.posexplode(shingles("s", q)).alias("place", "shingle"))
        place = place.select("_key", "place", _hash("shingle", q).alias("h"))
        # Any text with a shingle of the benchmark; equal texts once.
        hits = written(place.join(known, "h").distinct(), "matches")
        rare = bounded(hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
        order = W.partitionBy("window").orderBy("n", "h", "offset")
        # A window with a shingle that no text has cannot occur.
        every = named.join(rare, "h", "left").withColumn("r", F.row_number().over(order)).filter("r = 1 and n is not null")
        prefix = bounded(every.select("h", "window", "offset"))
        matches.append(
            hits.join(prefix, "h").select("_key", "window", (F.col("place") - F.col("offset")).alias("start")).filter("start >= 0")
        )
    parts = F.split("text", GAP_ANY, -1)
    count = F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    out = packed(docs, "text").select(
        "_doc", F.sha2("text", 256).alias("_key"), F.coalesce(count.cast("bigint"), F.lit(0).cast("bigint")).alias("n_words")
    )
    if not matches:
        return out.drop("_key").select("*", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    needed = windows.select("window", "words", "size", "item_ids")
    candidates = reduce(DataFrame.unionByName, matches).join(bounded(needed), "window")
    candidates = candidates.groupBy("_key").agg(F.collect_list(F.struct("start", "size", "window")).alias("c"))
    texts = (
        docs.select(F.sha2("text", 256).alias("_key"), "text")
        .join(bounded(written(candidates, "candidates")), "_key")
        .groupBy("_key")
        .agg(F.first("text").alias("text"), F.first("c").alias("c"))
    )
    tested = (
        texts.select("_key", "c", words_of(ascii_lower(F.col("text"))).alias("w"))
        .select("_key", F.explode(F.expr("transform(c, x -> struct(x.start, x.size, x.window, slice(w, x.start + 1, x.size) as at))")).alias("x"))
        .select("_key", "x.*")
        .join(bounded(needed.drop("size")), "window")
        .filter("at = words")
        .groupBy("_key")
        .agg(
            F.expr("size(array_distinct(flatten(collect_list(sequence(start, start + size - 1)))))").cast("bigint").alias("n_hit"),
            F.expr("array_sort(array_distinct(flatten(collect_list(item_ids))))").alias("item_ids"),
        )
    )
    return (
        out.join(bounded(written(tested, "hits")), "_key", "left")
        .drop("_key")
        .withColumns(
            {
                "n_hit": F.coalesce("n_hit", F.lit(0).cast("bigint")),
                "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")),
            }
        )
    )


#: The same gaps in a text that still has capitals.
GAP_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hash(shingle: str, q: int) -> Column:
    """Null where the text ends before the shingle does."""
    parts = [F.col(f"{shingle}.w{i}") for i in range(q)]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.xxhash64(*parts))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` of every row; rules as in ``found``."""
    return found(docs.select("doc_id", "text"), benchmark, window, shingle).select("_doc.doc_id", "n_words", "n_hit", "item_ids")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; rules as in ``found``."""
    return found(docs, benchmark, window, shingle).filter("n_hit = 0").select("_doc.*")
