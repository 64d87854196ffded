"""Repeated byte strings removed from texts, by a distributed sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.

*Suffixes.* Every window of ``length`` bytes names one of its places, its anchor: the
leftmost one with the least hash of eight bytes among the first ``REACH`` places. Equal
windows have their anchor at the same offset, so only suffixes that start at an anchor
are needed, about one of ``REACH / 2``. An anchor owns the windows that name it; they are its
*context*: up to ``REACH - 1`` bytes before it and up to ``length`` from it on.

*Leading tokens.* Equal windows share the first ``LEAD`` bytes from their anchor. A suffix whose
lead occurs once matches nothing and is not sorted; counts combine on the map side.
Contexts that occur twice (lead and context hash: 128 bits) are repeated as a whole. What is
left are different contexts with one lead; their bytes are cut out, each once, however often it occurs.

*Sort.* These contexts are range-partitioned at sampled splitters by the suffix (and by
what is before it, so that equal suffixes may be cut); each bucket is sorted by
multikey quicksort, eight bytes a digit, and each suffix compared with its
neighbours; the ends of neighbouring buckets are compared across their boundary.
So each context knows the most bytes that it shares after the anchor with any other. The
same is done for the reversed bytes before it. A window at offset ``d`` can only be repeated if
``d`` bytes before and ``length - d`` bytes after are shared; those windows, nearly all of them
repeats, are counted by 128 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import bounded, packed, pieces, rows_of
from quire.session import addressed, discard, written

LENGTH = 200
REACH = 128
LEAD = 72
GRAM = 8
BUCKET_ROWS = 40_000
#: A long text is searched for anchors in strides of so many bytes.
STRIDE = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column in one array, and the offsets of its values."""
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return own[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    every = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    return every if at is None else every[at]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in ``data``, and the first and the last window that each owns."""
    begin, stop = offsets[:-1], offsets[1:] - length + 1  # windows of each text
    whole = stop > begin
    begin, stop = begin[whole], stop[whole]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    found = []
    for at in range(0, len(data) - length + 1, STRIDE):
        last = min(len(data) - length + 1, at + STRIDE)
        part = data[at : last + REACH + GRAM - 2]
        key = (_words(part) * _MIX >> np.uint64(29)) * _MIX2
        key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
        width = 1
        while width < REACH:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        own = (key[: last - at] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
        edges = np.zeros(last - at + 1, np.int8)
        a, b = np.clip(begin, at, last) - at, np.clip(stop, at, last) - at
        some = b > a
        edges[a[some]] += 1
        edges[b[some]] -= 1
        start = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        found.append((own[start], start + at))
    place, start = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return place[first], start[first], start[last]


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _MIX
    return h ^ (h >> np.uint64(31))


def _lead(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    h = np.zeros(len(place), np.uint64)
    for i in range(0, LEAD, 8):
        h = _mixed(h, _words(data, place + i))
    return (h * _MIX2).view(np.int64)


def _context(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each context and of where the anchor lies in it."""
    stop = last + LENGTH - 8
    h = _mixed(_mixed(np.full(len(place), 1, np.uint64), (place - first).astype(np.uint64)), (place - last).astype(np.uint64))
    # Words from the first window on; the last ones overlap, so that none ends behind the context.
    for i in range(0, LENGTH + REACH, 8):
        h = np.where(first + i - 8 < stop, _mixed(h, _words(data, np.minimum(first + i, stop))), h)
    return (h * _MIX2).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = _bytes_of(batch.column("text"))
        place, first, last = anchors(data, offsets)
        text = np.searchsorted(offsets, place, side="right") - 1
        own = pa.array(text)
        yield rows_of(
            _file=batch.column("_file").take(own),
            _at=batch.column("_at").take(own),
            pos=pa.array(place - offsets[text] << 16 | place - first << 8 | place - last),
            lead=pa.array(_lead(data, place)),
            c=pa.array(_context(data, place, first, last)),
        )


def _cut(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The strings ``data[start:stop]``."""
    size = stop - start
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = _bytes_of(batch.column("text"))
        own = batch.column("a")
        flat = own.flatten()
        pos = flat.field("pos").to_numpy(zero_copy_only=False)
        pos, hi, lo = pos >> 16, pos >> 8 & 255, pos & 255
        place = offsets[np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))] + pos
        # Contexts of a very long text are sent in parts.
        for at in range(0, max(1, len(place)), 20_000):
            k = slice(at, at + 20_000)
            yield rows_of(
                lo=pa.array(lo[k].astype(np.int16)),
                hi=pa.array(hi[k].astype(np.int16)),
                lead=flat.field("lead")[k],
                c=flat.field("c")[k],
                n=flat.field("n")[k],
                before=_cut(data, (place - hi)[k], place[k]),
                after=_cut(data, place[k], (place - lo)[k] + LENGTH),
            )


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (big-endian digits of eight bytes), and the bytes that neighbours share.

    Each digit parts what was equal so far; rows that differ from all others go no further.
    """
    n, digits = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    shared = np.full(max(0, n - 1), 8 * digits)
    open_ = np.ones(max(0, n - 1), bool)  # pairs of neighbours that are equal so far
    for d in range(digits):
        if d:
            rows = np.flatnonzero(np.concatenate([[False], open_]) | np.concatenate([open_, [False]]))
            if not len(rows):
                break
            run = np.cumsum(~np.concatenate([[False], open_]))[rows]
            order[rows] = order[rows[np.lexsort((words[order[rows], d], run))]]
        pairs = np.flatnonzero(open_)
        xor = words[order[pairs], d] ^ words[order[pairs + 1], d]
        differ = xor != 0
        bytes_ = xor[differ].astype(">u8").view(np.uint8).reshape(-1, 8)
        shared[pairs[differ]] = 8 * d + np.argmax(bytes_ != 0, axis=1)
        open_[pairs[differ]] = False
    return order, shared


def _matrix(column: pa.Array, width: int, backward: bool = False) -> np.ndarray:
    """The strings as rows of ``width`` bytes, padded with zeros."""
    data, offsets = _bytes_of(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    out[np.arange(width) < size[:, None]] = data
    if backward:
        back = np.clip(size[:, None] - 1 - np.arange(width), 0, None)
        out = np.where(np.arange(width) < size[:, None], np.take_along_axis(out, back, 1), 0).astype(np.uint8)
    return out


def _sorted_keys(table: pa.Table, backward: bool) -> np.ndarray:
    """What is sorted: the suffix, or the lead and the reversed bytes before it."""
    if not backward:
        keys = _matrix(table["after"].combine_chunks(), -(-LENGTH // 8) * 8)
    else:
        lead = table["lead"].combine_chunks().to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
        lead = lead ^ np.array([0x80] + [0] * 7, np.uint8)  # signed order
        keys = np.concatenate([lead, _matrix(table["before"].combine_chunks(), REACH, True)], axis=1)
    return np.ascontiguousarray(keys).view(">u8").astype(np.uint64)


def _neighbours(rows: DataFrame, column: str, backward: bool) -> DataFrame:
    """``rows`` with ``column``: the most bytes that a context shares with another after, or before, its anchor."""
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    behind = F.reverse(F.decode("before", "ISO-8859-1"))
    keys = [F.col("lead"), behind, F.col("after")] if backward else [F.col("after"), F.col("before")]
    made = StructType([f for f in rows.schema.fields if f.name != "bucket"])
    made = made.add(column, "integer").add("bucket", "integer").add("edge", "integer").add("bytes", "binary")
    skip = 8 if backward else 0

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        words = _sorted_keys(table, backward)
        order, shared = multikey(words)
        most = np.zeros(len(order), np.int64)
        most[order[1:]] = shared
        most[order[:-1]] = np.maximum(most[order[:-1]], shared)
        edge = np.zeros(len(order), np.int32)
        edge[order[0]] |= 1
        edge[order[-1]] |= 2
        text = [words[i].astype(">u8").tobytes() if edge[i] else None for i in range(len(order))]
        table = table.append_column(column, pa.array(np.maximum(most - skip, 0).astype(np.int32)))
        table = table.append_column("bucket", pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32)))
        table = table.append_column("edge", pa.array(edge)).append_column("bytes", pa.array(text, pa.binary()))
        yield from table.to_batches(max_chunksize=10_000)

    placed = written(rows.repartitionByRange(n, *keys).mapInArrow(sort, made), "sorted")
    # At most two rows of a bucket.
    ends = sorted(placed.filter("edge > 0").select("bucket", "edge", "bytes").collect())
    firsts = [(b, x) for b, e, x in ends if e & 1]
    lasts = [(b, x) for b, e, x in ends if e & 2]
    across = []
    for (left, x), (right, y) in zip(lasts, firsts[1:], strict=False):
        k = next((i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p != q), len(x))
        across += [(left, 2, max(0, k - skip)), (right, 1, max(0, k - skip))]
    if not across:
        return placed.drop("bucket", "edge", "bytes")
    more = rows.sparkSession.createDataFrame(across, "bucket int, side int, more int")
    more = more.groupBy("bucket").pivot("side", [1, 2]).agg(F.max("more"))
    met = placed.join(F.broadcast(more), "bucket", "left")
    own = [F.when(F.col("edge").bitwiseAND(s) > 0, F.coalesce(F.col(f"`{s}`"), F.lit(0))).otherwise(0) for s in (1, 2)]
    return met.withColumn(column, F.greatest(column, *own)).drop("bucket", "edge", "bytes", "1", "2")


def _repeats(few: DataFrame) -> DataFrame:
    """``lead, c, d``: runs ``[first, last]`` of the offsets of repeated windows, for the contexts that occur once."""
    half = _neighbours(few, "f", False)
    bound = _neighbours(half, "b", True)
    discard(half)
    low, high = F.greatest(F.col("lo").cast("int"), F.lit(LENGTH) - F.col("f")), F.least(F.col("hi").cast("int"), F.col("b"))
    open_ = bound.select("lead", "c", "n", "hi", F.concat("before", "after").alias("s"), low.alias("low"), high.alias("high"))
    open_ = open_.filter("low <= high").select("lead", "c", "n", "hi", "s", F.explode(F.sequence("low", "high")).alias("d"))
    window = F.xxhash64(F.expr(f"substring(s, hi - d + 1, {LENGTH})"))
    # Equal windows have one lead; with its hash they are counted by 128 bits.
    windows = open_.select("lead", "c", "n", "d", window.alias("w"))
    twice = written(windows.groupBy("lead", "w").agg(F.sum("n").alias("t")).filter("t > 1").select("lead", "w"), "twice")
    # The offsets of one context are at most REACH.
    found = windows.filter("n = 1").join(twice, ["lead", "w"]).groupBy("lead", "c").agg(F.collect_set("d").alias("d"))
    runs = F.expr(
        """transform(filter(d, x -> not array_contains(d, x - 1)),
           x -> struct(x as first, array_min(filter(d, y -> y >= x and not array_contains(d, y + 1))) as last))"""
    )
    out = written(found.select("lead", "c", runs.alias("d")), "runs")
    discard(twice, bound)
    return out


def _fetched(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """``held`` joined to ``wanted`` by address; texts that are not wanted are not shuffled while the addresses can be broadcast."""
    return held.join(bounded(wanted.select("_file", "_at")), ["_file", "_at"], "left_semi").join(wanted, ["_file", "_at"])


def repeated_spans(held: DataFrame) -> DataFrame:
    """``_file, _at, spans``: byte ranges ``[start, stop)`` to remove, of every row of ``held`` (``text`` and its address) that has some."""
    made = "_file long, _at long, pos long, lead long, c long"
    texts = held.select("_file", "_at", "text")
    places = written(texts.mapInArrow(_anchor_rows, made), "anchors")
    leads = places.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("one"), F.max("c").alias("other"))
    leads = written(leads.filter("n > 1").select("lead", (F.col("one") != F.col("other")).alias("mixed")), "leads")
    met = written(places.join(leads, "lead"), "met")
    discard(places, leads)
    mixed = met.filter("mixed")
    # Each context once, with the number of its places; its bytes are cut from one of them.
    kinds = mixed.groupBy("lead", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_file", "_at", "pos")).alias("at"))
    kinds = written(kinds.select("lead", "c", "n", "at.*"), "kinds")
    # The anchors of one text.
    sought = kinds.groupBy("_file", "_at").agg(F.collect_list(F.struct("pos", "lead", "c", "n")).alias("a"))
    wanted = written(sought, "sought")
    joined = _fetched(texts, wanted).select("text", "a")
    few = written(joined.mapInArrow(_context_rows, "lo short, hi short, lead long, c long, n long, before binary, after binary"), "few")
    hi, lo = (F.shiftright("pos", k).bitwiseAND(F.lit(255)).cast("int") for k in (8, 0))
    own = F.array(F.struct(lo.alias("first"), hi.alias("last"))).alias("d")
    some = written(_repeats(few).unionByName(kinds.filter("n > 1").select("lead", "c", own)), "repeats")
    parts = mixed.join(some, ["lead", "c"]).select("_file", "_at", "pos", F.explode("d").alias("d"))
    whole = met.filter("not mixed").select("_file", "_at", "pos", F.struct(lo.alias("first"), hi.alias("last")).alias("d"))
    place = F.shiftright("pos", 16)
    span = F.struct((place - F.col("d.last")).alias("start"), (place - F.col("d.first") + LENGTH).alias("stop"))
    spans = whole.unionByName(parts).groupBy("_file", "_at").agg(F.collect_list(span).alias("spans"))
    out = written(spans, "spans")
    discard(met, kinds, few, wanted)
    return out


def without_repeats(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``_doc, n_bytes, n_removed, n_spans, kept``: every row with what is left of its text, as bytes.

    Needs ``text``; other columns stay in ``_doc``, all or those to ``keep``. Null counts as
    empty; texts of fewer than 200 bytes lose nothing. Of a repeated row each copy counts
    as another place, so copies of at least 200 bytes go whole. What is left need not be
    UTF-8: a cut may fall inside a character. An empty table gives an empty table.
    """
    rows = packed(docs, "text", keep=keep)
    rows = addressed(rows, "texts")
    rows = rows.select("_file", "_at", "_doc", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = F.octet_length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    whole = [size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept")]
    short = rows.filter(size < LENGTH).select("_doc", *whole)
    held = rows.filter(size >= LENGTH)
    spans = repeated_spans(held)
    rest = held.join(bounded(spans.select("_file", "_at")), ["_file", "_at"], "left_anti")
    schema = StructType([held.schema["_doc"]])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = _bytes_of(batch.column("text"))
            own = batch.column("spans")
            flat = own.flatten()
            text = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            edges = np.zeros(len(data) + len(own) + 1, np.int32)
            # One place more for each text, so that its ranges end before the next one's first byte.
            base = offsets + np.arange(len(offsets))
            for name, sign in (("start", 1), ("stop", -1)):
                np.add.at(edges, base[text] + flat.field(name).to_numpy(zero_copy_only=False), sign)
            gone = np.cumsum(edges) > 0
            starts = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
            runs = np.bincount(np.searchsorted(base, starts, side="right") - 1, minlength=len(own))
            at = np.arange(len(data)) + np.repeat(np.arange(len(own)), np.diff(offsets))
            left = ~gone[at]
            ends = np.concatenate([[0], np.cumsum(left)])[offsets]
            yield rows_of(
                _doc=batch.column("_doc"),
                n_bytes=pa.array(np.diff(offsets)),
                n_removed=pa.array(np.diff(offsets) - np.diff(ends)),
                n_spans=pa.array(runs.astype(np.int64)),
                kept=pa.Array.from_buffers(
                    pa.binary(), len(own), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[left]))]
                ),
            )

    changed = _fetched(held, spans).select("_doc", "text", "spans").mapInArrow(remove, schema)
    return short.unionByName(rest.select("_doc", *whole)).unionByName(changed)
