"""Ranked lexical search with bit-sliced Bloom signatures.

*Index.* Every document has a Bloom filter of its terms; a term that occurs ``2^j + 1`` times or more is
there once more for each such step, so the filter also bounds how often it occurs, from above only.
Documents whose filters have one width form blocks; a block is stored by bit slices: one bitmap over its
documents for each place of the filter.

*Bounds.* For each step of each term of the queries the slices at its places are met; what is left are
the documents that may hold it so often. The weighted sum over the terms of a query, each with the most
it can give in a document of that length, is an upper bound of the score.

*Search.* The documents with the highest bounds are scored exactly, from their whole texts; the score of
the k-th of them is a threshold for the query. All documents whose bound reaches it are scored exactly too,
so none is left out that could be among the first k. Queries are taken in blocks; documents are never
collected.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import bounded, pieces, rows_of
from quire.llm.suffix_dedup import _bytes_of
from quire.session import addressed, written

TOP = 10
#: Documents per query that give the threshold.
FIRST = 24
QUERY_BLOCK = 1000
HASHES = 3
BITS_PER_ENTRY = 8
BLOCK_ROWS = 512
BLOCK_BITS = 1 << 22
STRIDE = 4_000_000
#: Bounds are sums of doubles of at most 2^53; so much more covers their rounding.
MARGIN = 1 + 1e-9

_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}

INDEX = "width int, doc_id array<long>, file array<long>, at array<long>, n array<long>, slices binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWER:
        _POWER.clear()
        _POWER[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _POWER[size]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every term of the texts, and the number of terms before each text's end."""
    inside = _TERM[data]
    # A text's first byte begins a term, whatever is before it.
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])[: len(data)]))
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    stops = np.flatnonzero(inside & (fresh[1:] | ~after)) + 1
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(stops, starts[at] + STRIDE, side="right")))
        base = starts[at]
        part = _CODE[_LOWER[data[base : stops[last - 1]]]]
        power, inverse = _powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * power[: len(part)], dtype=np.uint64)])
        a, b = starts[at:last] - base, stops[at:last] - base
        h = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        out[at:last] = h ^ (h >> np.uint64(29))
        at = last
    return out, np.searchsorted(starts, offsets)


def steps(tf: np.ndarray) -> np.ndarray:
    """Entries of a term in the filter: 1, 2, 3, 4, ... for 1, 2, 3-4, 5-8, ... occurrences."""
    return np.where(tf > 1, np.ceil(np.log2(np.maximum(tf, 1) - 0.5)).astype(np.int64) + 1, 1)


def most(step: np.ndarray) -> np.ndarray:
    """The most occurrences of a term with so many entries."""
    return np.int64(1) << np.clip(step - 1, 0, 62)


def places(term: np.ndarray, step: np.ndarray, width: int) -> np.ndarray:
    """Places of the entries in a filter of ``width`` bits, a power of two."""
    h = (term + step.astype(np.uint64) * _BASE) * _MIX
    h ^= h >> np.uint64(32)
    jump = (h >> np.uint64(17)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * jump[:, None]) & np.uint64(width - 1)).astype(np.int64)


def index(rows: DataFrame) -> DataFrame:
    """Blocks of documents of ``doc_id, text, _file, _at``: their addresses, numbers of terms and slices."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)

        def block(width: int) -> pa.RecordBatch:
            own = held.pop(width)
            count = -(-len(own) // 8) * 8
            bits = np.zeros((width, count), bool)
            for i, (_, _, _, _, place) in enumerate(own):
                bits[place, i] = True
            columns = {name: pa.array([[r[k] for r in own]], pa.list_(pa.int64())) for k, name in enumerate(("doc_id", "file", "at", "n"))}
            slices = pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())
            return rows_of(width=pa.array([width], pa.int32()), **columns, slices=slices)

        for batch in pieces(batches):
            hashes, ends = terms(*_bytes_of(batch.column("text")))
            ids = [batch.column(c).to_pylist() for c in ("doc_id", "_file", "_at")]
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if a == b:
                    continue
                own, tf = np.unique(hashes[a:b], return_counts=True)
                n = steps(tf)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                width = 1 << max(6, int(BITS_PER_ENTRY * len(step) - 1).bit_length())
                held[width].append((*(x[i] for x in ids), b - a, places(np.repeat(own, n), step, width).ravel()))
                if len(held[width]) >= min(BLOCK_ROWS, max(8, BLOCK_BITS // width)):
                    yield block(width)
        for width in list(held):
            yield block(width)

    return rows.select("doc_id", "_file", "_at", "text").mapInArrow(build, INDEX)


@dataclass
class Queries:
    """A block of queries. Their terms have numbers; ``term``, ``times``: those of all queries in a row, ``cut``: where each begins."""

    item_id: list
    names: list[bytes]
    term: np.ndarray
    times: np.ndarray
    cut: np.ndarray
    hashes: np.ndarray
    docs: int = 0
    length: int = 0
    weight: np.ndarray | None = None

    @staticmethod
    def of(items: list[tuple]) -> Queries | None:
        counts = [(i, Counter(split(t))) for i, t in items if t is not None]
        counts = [(i, c) for i, c in counts if c]
        if not counts:
            return None
        names = sorted({t for _, c in counts for t in c})
        number = {t: k for k, t in enumerate(names)}
        sizes = np.cumsum([0] + [len(c) for _, c in counts])
        joined = b" ".join(names)
        hashes, _ = terms(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        return Queries(
            [i for i, _ in counts],
            names,
            np.array([number[t] for _, c in counts for t in c]),
            np.array([n for _, c in counts for n in c.values()], np.int64),
            sizes[:-1],
            hashes,
        )

    def norm(self, n):
        return 25 + (75 * n * self.docs) // self.length


def split(text: str) -> list[bytes]:
    import re

    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.encode().lower())


def measure(rows: DataFrame, queries: Queries) -> None:
    """Sets the number of documents, their length, and the weights, from all documents."""
    order = np.argsort(queries.hashes)
    sorted_ = queries.hashes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(len(order), np.int64), 0, 0
        for batch in pieces(batches):
            hashes, ends = terms(*_bytes_of(batch.column("text")))
            size = np.diff(ends)
            docs, length = docs + int((size > 0).sum()), length + len(hashes)
            at = np.minimum(np.searchsorted(sorted_, hashes), len(order) - 1)
            hit = np.flatnonzero(sorted_[at] == hashes)
            text = np.searchsorted(ends, hit, side="right") - 1
            df += np.bincount(order[np.unique(text * len(order) + at[hit]) % len(order)], minlength=len(order))
        some = np.flatnonzero(df)
        yield rows_of(k=pa.array(np.concatenate([[-1, -2], some])), c=pa.array(np.concatenate([[docs, length], df[some]])))

    # A row for each term of the block of queries and two.
    got = rows.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    sums = {r.k: r.c for r in got}
    queries.docs, queries.length = sums.get(-1, 0), sums.get(-2, 0)
    df = [sums.get(k, 0) for k in range(len(order))]
    queries.weight = np.array([math.floor(1000 * math.log((2 * queries.docs + 2) / (2 * n + 1))) if n else 0 for n in df], np.int64)


def bounds(width: int, n: np.ndarray, slices: bytes, queries: Queries) -> np.ndarray:
    """Upper bounds of the scores: a row for each query, a column for each document of a block."""
    rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
    step = np.zeros((len(queries.hashes), len(n)), np.int8)
    left = np.flatnonzero(queries.weight > 0)
    level, may = 1, None
    while len(left):
        at = places(queries.hashes[left], np.full(len(left), level), width)
        met = reduce(np.bitwise_and, [rows[at[:, j]] for j in range(HASHES)])
        may = met if may is None else may & met
        some = may.any(axis=1)
        left, may = left[some], may[some]
        step[left] += np.unpackbits(may, axis=1)[:, : len(n)].astype(np.int8)
        level += 1
    tf = most(np.arange(level, dtype=np.int64)).astype(np.float64)
    tf[0] = 0
    gain = 1e9 * tf[:, None] / (1000 * tf[:, None] + 8 * queries.norm(n)[None, :])
    own = gain[step, np.arange(len(n))[None, :]]
    weighed = own[queries.term] * (queries.times * queries.weight[queries.term])[:, None]
    return np.add.reduceat(weighed, queries.cut, axis=0) * MARGIN


def _bounded_rows(blocks: DataFrame, queries: Queries, least: np.ndarray | None) -> DataFrame:
    """``q, file, at, doc_id, bound``: the documents with the highest bounds in each task, or all whose bound reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.item_id]
        for batch in batches:
            for i in range(batch.num_rows):
                n, file, at, doc = (batch.column(c)[i].values for c in ("n", "file", "at", "doc_id"))
                made = bounds(batch.column("width")[i].as_py(), n.to_numpy(), batch.column("slices")[i].as_buffer(), queries)
                if least is not None:
                    q, d = np.nonzero(made >= least[:, None])
                else:
                    keep = min(FIRST, made.shape[1])
                    d = np.argpartition(-made, keep - 1, axis=1)[:, :keep].ravel()
                    q = np.repeat(np.arange(len(made)), keep)
                    some = made[q, d] > 0
                    q, d = q[some], d[some]
                own = pa.array(d)
                out = rows_of(q=pa.array(q), file=file.take(own), at=at.take(own), doc_id=doc.take(own), bound=pa.array(made[q, d]))
                if least is not None:
                    yield out
                else:
                    for r in zip(*(c.to_pylist() for c in out.columns), strict=True):
                        best[r[0]].append(r)
            if least is None:
                best = [sorted(x, key=lambda r: -r[4])[:FIRST] for x in best]
        if least is None:
            rows = [r for x in best for r in x]
            if rows:
                q, file, at, doc, bound = (list(x) for x in zip(*rows, strict=True))
                yield rows_of(
                    q=pa.array(q, pa.int64()), file=pa.array(file, pa.int64()), at=pa.array(at, pa.int64()),
                    doc_id=pa.array(doc, pa.int64()), bound=pa.array(bound, pa.float64()),
                )

    return blocks.mapInArrow(run, "q long, file long, at long, doc_id long, bound double")


def _scored(rows: DataFrame, wanted: DataFrame, queries: Queries) -> DataFrame:
    """``q, doc_id, score`` of the wanted ``q, file, at, doc_id``, from the whole texts."""
    # The queries of one document, at most those of the block.
    own = written(wanted.groupBy(F.col("file").alias("_file"), F.col("at").alias("_at")).agg(F.collect_set("q").alias("qs")), "wanted")
    keys = ["_file", "_at"]
    texts = rows.join(bounded(own.select(*keys)), keys, "left_semi").join(bounded(own), keys)
    stops = np.concatenate([queries.cut[1:], [len(queries.term)]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = queries.weight.tolist()
        own = [
            [(queries.names[t], k * weight[t]) for t, k in zip(queries.term[a:b].tolist(), queries.times[a:b].tolist(), strict=True) if weight[t]]
            for a, b in zip(queries.cut, stops, strict=True)
        ]
        for batch in pieces(batches):
            out = []
            for doc, text, qs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("qs").to_pylist(), strict=True):
                found = split(text.as_py())
                tf, m = Counter(found), queries.norm(len(found))
                for q in qs:
                    s = sum(w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, w in own[q] if t in tf)
                    out.append((q, doc, s))
            if out:
                q, doc, s = zip(*out, strict=True)
                yield rows_of(q=pa.array(q, pa.int64()), doc_id=pa.array(doc, pa.int64()), score=pa.array(s, pa.int64()))

    return texts.select("doc_id", "text", "qs").mapInArrow(score, "q long, doc_id long, score long")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest scores above zero for each row of ``queries``.

    Needs ``doc_id`` (a long) and ``text`` in ``docs``, ``item_id`` and ``text`` in ``queries``; other columns are ignored. A
    null text has no terms: it is neither found nor finds anything, like one without terms, and does not
    count as a document. Equal scores rank by ascending ``doc_id``, null last. Repeated rows
    are documents, or queries, of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = addressed(docs.select("doc_id", "text"), "documents").filter("text is not null")
    blocks, out = None, None
    items = queries.select("item_id", "text")
    for part in batched((tuple(r) for r in items.toLocalIterator()), query_block):
        own = Queries.of(list(part))
        if own is None:
            continue
        measure(rows, own)
        if not own.length:
            break
        blocks = blocks if blocks is not None else written(index(rows), "index")
        # At most FIRST rows of a query and task; the window keeps as many of each query.
        best = W.partitionBy("q").orderBy(F.desc("bound"), "file", "at")
        first = _bounded_rows(blocks, own, None).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= FIRST)
        least = np.ones(len(own.item_id))
        # One row of each query of the block.
        for r in _ranked(_scored(rows, written(first, "first"), own), top).filter(F.col("rank") == top).collect():
            least[r.q] = r.score
        scored = _scored(rows, written(_bounded_rows(blocks, own, least), "candidates"), own)
        names = spark.createDataFrame(list(enumerate(own.item_id)), items.select(F.lit(0).cast("bigint").alias("q"), "item_id").schema)
        made = _ranked(scored, top).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = made if out is None else out.unionByName(made)
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return out
