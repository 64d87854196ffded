"""Near duplicates by SimHash with pivot distance tables.

Every text gets a 64-bit fingerprint; texts are linked if their fingerprints
differ in at most ``max_distance`` bits, and the connected components are the
groups. Work after the fingerprints is on distinct fingerprints only.

*Pivot distance table.* The references are the zero word and one mask per block
of ``block`` bits. The Hamming distances ``d0`` to zero and ``di`` to a mask give the
coordinate ``d0 - di`` (twice the ones in the block, less its width). One
differing bit changes one coordinate, so of ``groups`` groups of coordinates at
most ``max_distance`` differ between two linked fingerprints: some choice of
``groups - max_distance`` groups is equal, and every link shows up in an equi
join on one of the choices. Of the pairs met there those are discarded whose
coordinates differ by more than the distance allows (the maximum coordinate
difference, over all references), and the survivors are verified bit by bit.

*Hot choices.* A choice shared by more than ``bucket`` fingerprints is not paired.
Its fingerprints emit all words within ``max_distance / 2`` flipped bits; two
fingerprints have such a word in common if and only if they are linked, so the
smallest fingerprint of each word gives edges that connect the same components.
That is linear in the fingerprints and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, packed, pieces
from quire.session import written

SHINGLE = 3
MAX_DISTANCE = 2
GROUPS = 4
BUCKET = 16
SEED = 42
BLOCK = 2

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text as a signed 64-bit number; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        stops = (ends[shingle - 1 :] - 1).tolist()
        starts = [0, *ends[:-shingle].tolist()]
        parts = [joined[a:b] for a, b in zip(starts, stops, strict=True)]
        hashes = np.array(list(map(xxh64_intdigest, parts, repeat(SEED))), dtype=np.uint64)
    cells = hashes.view(np.uint8).reshape(-1, 8) + _COLUMN
    ones = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = np.packbits(ones.reshape(64) * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``_doc, doc_id, fp``: the row, its id, and the fingerprint of its text."""
    rows = packed(docs, "doc_id", "text", keep=keep).withColumn("fp", F.lit(0).cast("bigint"))
    schema = rows.select("_doc", "doc_id", "fp").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").cast(pa.binary())
            made = pa.array([fingerprint(t.as_py() or b"", shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("doc_id"), made], ["_doc", "doc_id", "fp"])

    return rows.select("_doc", "doc_id", "text").mapInArrow(run, schema)


def coordinates(fp: Column, block: int = BLOCK) -> list[Column]:
    """``d(fp, 0) - d(fp, mask)`` of every mask."""
    zero = F.bit_count(fp)
    masks = [((1 << block) - 1) << i for i in range(0, 64, block)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return [(zero - F.bit_count(fp.bitwiseXOR(F.lit(m).cast("bigint")))).cast("tinyint") for m in signed]


def _choices(max_distance: int, groups: int) -> list[tuple[int, ...]]:
    """The groups of coordinates that may be equal in a linked pair, every choice."""
    return list(combinations(range(groups), groups - max_distance))


def links(
    distinct: DataFrame, max_distance: int = MAX_DISTANCE, groups: int = GROUPS, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """``a, b``: edges between distinct fingerprints ``fp`` with the components of all links."""
    n = 64 // block
    table = distinct.select("fp", F.array(*coordinates(F.col("fp"), block)).alias("t"))
    cuts = [(g * n // groups, (g + 1) * n // groups) for g in range(groups)]
    # A number for each group of coordinates; numbers that are equal by chance only add pairs to be discarded.
    numbers = [F.xxhash64(F.slice("t", a + 1, b - a)).alias(f"g{g}") for g, (a, b) in enumerate(cuts)]
    pivots = written(table.select("fp", *numbers), "pivots")
    keys = [F.xxhash64(F.lit(i), *[F.col(f"g{g}") for g in pick]) for i, pick in enumerate(_choices(max_distance, groups))]
    keyed = pivots.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = written(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = written(keyed.join(bounded(sizes), "k"), "shared")
    small = shared.filter(F.col("n") <= bucket)
    pairs = small.select("k", F.col("fp").alias("a")).join(small.select("k", F.col("fp").alias("b")), "k").filter("a < b")
    near = reduce(
        lambda x, y: x & y,
        [F.abs(p - q) <= 2 * max_distance for p, q in zip(coordinates(F.col("a"), block), coordinates(F.col("b"), block), strict=True)],
    )
    linked = pairs.filter(near).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance).select("a", "b")
    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    return linked.unionByName(_covered(hot, max_distance)).distinct()


def _covered(hot: DataFrame, max_distance: int) -> DataFrame:
    """``a, b``: edges that connect what is linked in ``hot``, from words at half the distance."""
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    # ``last`` is the number of the bit flipped last, zero if no more are to follow: each word of a fingerprint is made once.
    ball = hot.select("fp", F.posexplode(F.concat(F.array("fp"), F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))).alias("last", "w"))
    for _ in range(1, max_distance // 2):
        # The words of one fingerprint are spread over the tasks before more of their bits are flipped.
        later = F.when(F.col("last") > 0, F.slice(flips, F.col("last") + 1, F.lit(64))).otherwise(F.slice(flips, 1, 0))
        made = F.concat(F.array("w"), F.transform(later, lambda m: F.col("w").bitwiseXOR(m)))
        ball = ball.repartition("fp", "w").select("fp", "last", F.posexplode(made).alias("p", "w"))
        ball = ball.select("fp", F.when(F.col("p") > 0, F.col("last") + F.col("p")).otherwise(0).alias("last"), "w")
    # A word has at most as many neighbours as it has words within half the distance: 65 or 2,081.
    near = ball.groupBy("w").agg(F.collect_set("fp").alias("s")).filter("size(s) > 1")
    return near.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp, root``: the smallest fingerprint of the component of every fingerprint in ``edges``.

    Alternates large-star and small-star steps, each a minimum per node and a
    join, written after every round; the number of edges never grows.
    """
    edges = written(edges, "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # a < b: the neighbours of b that are smaller, and b itself, go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = written(small.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        last = state


def _grouped(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
    groups: int = GROUPS,
    bucket: int = BUCKET,
    block: int = BLOCK,
    keep: tuple[str, ...] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``_doc, doc_id, fp, _row`` of every row, and ``fp, head``: the id and the row that stand for a fingerprint's group."""
    if max_distance % 2:
        raise ValueError("max_distance must be even")
    rows = written(fingerprints(docs, shingle, keep).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    # The smallest id, nulls last, and the row that has it.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    distinct = written(rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_distance, groups, bucket, block))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    return rows, written(rooted.join(heads, "root").select("fp", "head"), "groups")


def near_groups(docs: DataFrame, **options: int | tuple[str, ...] | None) -> DataFrame:
    """``_doc, doc_id, fp, component_id, first``: every row with its group.

    Needs ``doc_id`` and ``text``; other columns stay in ``_doc``, all or those to ``keep``. Texts without
    words, null ones too, have the fingerprint zero and are linked like others.
    ``component_id`` is the smallest ``doc_id`` of the group, null only if all are
    null; ``first`` marks exactly one row of each group, one with that id.
    An empty table gives an empty table. ``max_distance`` must be even. ``options`` are those of ``_grouped``.
    """
    rows, named = _grouped(docs, **options)
    out = rows.join(named, "fp")
    return out.select("_doc", "doc_id", "fp", F.col("head.doc_id").alias("component_id"), (F.col("_row") == F.col("head.row")).alias("first"))


def near_kept(docs: DataFrame, **options: int | tuple[str, ...] | None) -> DataFrame:
    """One row of each group of ``docs``, with all its columns; rules and options as in ``near_groups``.

    Rows that go are found on narrow columns; texts are shuffled, by row number, only if those are too many to broadcast.
    """
    rows, named = _grouped(docs, **options)
    gone = rows.select("fp", "_row").join(named, "fp").filter(F.col("_row") != F.col("head.row")).select("_row")
    return rows.join(bounded(written(gone, "gone")), "_row", "left_anti").select("_doc.*")
