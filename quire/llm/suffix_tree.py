"""Language-model scores from a probabilistic suffix tree over words.

The tokens of a text are its words in lower case and one end. The empty context has
the smoothed unigram distribution of the training texts, exact for every word. A
longer context, of up to ``levels`` words, is a node of the tree if it occurs in training and its next-symbol
distribution diverges from that of its suffix: the gain in log likelihood over the suffix has to pay for
the parameters of the node (half the log of its count each). Nodes list every symbol that follows
them; ``smoothing`` counts are dealt by the distribution of the suffix, so each node's
probabilities sum to one. A token is scored by the longest context that is a node.

No context, symbol or word is left out for being rare. Up to ``TREE_TOKENS`` training tokens
the tree is built on the driver and sent to the tasks (``grow``). Beyond, texts are cut into pieces. Length by length a piece
asks buckets (by a hash of the context) about its distinct grams; a bucket adds up what all pieces have, tests its contexts and
answers with counts. A context that occurs once is known to its piece alone and not asked for. Nothing of
the tree is broadcast or collected but the contexts frequent enough to be split over buckets.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from struct import calcsize, pack, unpack_from
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold_of, packed, pieces, rows_of
from quire.session import addressed, discard, written

LEVELS = 3
#: Training tokens up to which the tree is held in memory.
TREE_TOKENS = 100_000
#: Beyond, texts are cut into pieces of so many tokens, and there are as many buckets as training tokens have these.
PIECE = 1 << 20
BUCKET = 3 << 19
#: Contexts with so many training tokens behind them are split over the buckets.
SPLIT = 1 << 19
#: Contexts of more than one word are asked for in so many turns for each length, each with its share of the buckets: only one turn's questions are on disk.
TURNS = 2
#: Rows from which a pack is compressed.
PACKED = 256
HEAD = "<Bq"
SMOOTHING = 4.0
UNIGRAM = 0.1
FOLDS = 10
#: A word holds no white space, so this is none.
END = b"\n"
#: Which bytes are of words.
WORD = np.array([not bytes([i]).isspace() for i in range(256)])
FLUSH = 400_000


@dataclass
class Level:
    """Nodes of one length. ``key``: id of the suffix node and the word before it, sorted."""

    key: np.ndarray
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


@dataclass
class Tree:
    ids: dict[bytes, int]
    base: np.ndarray  # unigram probability of the head words
    tokens: int
    distinct: int
    levels: list[Level]
    smoothing: float

    @property
    def size(self) -> int:
        return max(1, len(self.ids))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys``, -1 for those that are not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def tokens_of(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Tokens of a batch in one list, and where each text ends."""
    words, ends = [], []
    for text in column.cast(pa.binary()):
        words += (text.as_py() or b"").lower().split()
        words.append(END)
        ends.append(len(words))
    return words, np.array(ends, np.int64)


def contexts(tree: Tree, symbols: np.ndarray, ends: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each level the node before every token, -1 where there is none."""
    n = len(symbols)
    starts = np.zeros(n, np.int64)
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    starts[begin] = begin
    place = np.arange(n) - np.maximum.accumulate(starts)
    nodes, last = [], np.zeros(n, np.int64)
    for k in range(1, levels + 1):
        word = np.full(n, -1, np.int64)
        word[k:] = symbols[:-k]
        ok = (last >= 0) & (word >= 0) & (place >= k)
        found = find(tree.levels[k - 1].key, last * tree.size + word)
        last = np.where(ok, found, -1)
        nodes.append(last)
    return nodes


def probabilities(tree: Tree, symbols: np.ndarray, nodes: list[np.ndarray], unigram: np.ndarray) -> np.ndarray:
    p = unigram
    for level, node in zip(tree.levels, nodes, strict=False):
        at = np.flatnonzero(node >= 0)
        at = at[level.kept[node[at]]]
        own = node[at]
        entry = np.where(symbols[at] >= 0, find(level.entry, own * tree.size + symbols[at]), -1)
        count = np.where(entry >= 0, level.count[entry], 0) if len(level.count) else np.zeros(len(at))
        p = p.copy()
        p[at] = (count + (level.rest[own] + tree.smoothing) * p[at]) / (level.total[own] + tree.smoothing)
    return p


def _word_counts(texts: DataFrame) -> DataFrame:
    """``word, c``, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in pieces(batches):
            seen.update(tokens_of(batch.column("text"))[0])
            if len(seen) >= FLUSH:
                yield rows_of(word=pa.array(list(seen), pa.binary()), c=pa.array(list(seen.values()), pa.int64()))
                seen = Counter()
        yield rows_of(word=pa.array(list(seen), pa.binary()), c=pa.array(list(seen.values()), pa.int64()))

    parts = texts.select("text").mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def _next_counts(texts: DataFrame, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys ``node * size + next symbol`` of a level, their counts, and the counts of the nodes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for batch in pieces(batches):
            words, ends = tokens_of(batch.column("text"))
            symbols = np.fromiter((tree.ids.get(w, -1) for w in words), np.int64, len(words))
            node = contexts(tree, symbols, ends, level)[-1]
            at = node >= 0
            # The count of a node itself is kept under -1 - node.
            pairs = np.concatenate([(node * tree.size + symbols)[at & (symbols >= 0)], -1 - node[at]])
            held.append(np.unique(pairs, return_counts=True))
            room += len(held[-1][0])
            if room >= 4 * FLUSH:
                yield merged(held)
                held, room = [], 0
        if held:
            yield merged(held)

    def merged(held: list) -> pa.RecordBatch:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
        return rows_of(pair=pa.array(keys), c=pa.array(counts))

    parts = texts.select("text").mapInArrow(count, "pair long, c long")
    # No more pairs than training tokens.
    made = parts.groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    keys, counts = made["pair"].to_numpy(), made["c"].to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    own = keys < 0
    nodes = np.zeros(len(tree.levels[level - 1].key), np.int64)
    nodes[-1 - keys[own]] = counts[own]
    return keys[~own], counts[~own], nodes


def _grown(tree: Tree, level: int, keys: np.ndarray, counts: np.ndarray, nodes: np.ndarray) -> Level:
    """The level with its entries and the divergence test of its nodes."""
    own = Level(tree.levels[level - 1].key, keys, counts, nodes.astype(float))
    node, symbol = keys // tree.size, keys % tree.size
    listed = np.bincount(node, counts, len(nodes))
    own.rest = own.total - listed
    # What the suffix says of the same symbols.
    suffix = tree.base[symbol]
    chain = [own.key[node] // tree.size]
    for above in range(level - 1, 1, -1):
        chain.append(tree.levels[above - 1].key[chain[-1]] // tree.size)
    if level > 1:
        suffix = probabilities(tree, symbol, chain[::-1], suffix)
    said = (counts + (own.rest[node] + tree.smoothing) * suffix) / (own.total[node] + tree.smoothing)
    gain = np.bincount(node, counts * np.log(said / suffix), len(nodes))
    left = (own.rest + tree.smoothing) / (own.total + tree.smoothing)
    gain += np.where(own.rest > 0, own.rest * np.log(left), 0.0)
    size = np.bincount(node, minlength=len(nodes))
    own.kept = gain > 0.5 * np.log(np.maximum(own.total, 1)) * size
    own.kept &= size > 0
    return own


def grow(training: DataFrame, vocabulary: DataFrame, levels: int = LEVELS) -> Tree:
    """The whole tree of few training texts (``text``), in memory; ``vocabulary`` has their ``word, c``."""
    made = vocabulary.orderBy(F.desc("c"), "word").toArrow()
    words, counts = made["word"].to_pylist(), made["c"].to_numpy()
    tokens, distinct = int(counts.sum()), len(words)
    base = (counts + UNIGRAM) / (tokens + UNIGRAM * (distinct + 1))
    tree = Tree({w: i for i, w in enumerate(words)}, base, tokens, distinct, [], SMOOTHING)
    if not words:
        return tree
    end = tree.ids[END]
    keys = np.flatnonzero(np.arange(distinct) != end).astype(np.int64)
    for level in range(1, levels + 1):
        if not len(keys):
            break
        tree.levels.append(Level(keys))
        made = _next_counts(training, tree, level)
        tree.levels[-1] = own = _grown(tree, level, *made)
        # A longer node: what follows a node, seen from its own end.
        more = own.entry % tree.size != end
        node, symbol = own.entry[more] // tree.size, own.entry[more] % tree.size
        keys = _longer(tree, level, node, symbol)
    return tree


def _longer(tree: Tree, level: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of the nodes that are a node followed by a symbol; their suffix is a node as well."""
    words = [symbol]  # last word first
    for k in range(level, 0, -1):
        key = tree.levels[k - 1].key[node]
        words.insert(1, key % tree.size)
        node = key // tree.size
    last = np.zeros(len(symbol), np.int64)
    for k in range(level):
        last = np.where(last >= 0, find(tree.levels[k].key, last * tree.size + words[k]), -1)
    return np.unique((last * tree.size + words[level])[last >= 0])


class Numbers(dict):
    """Numbers of words from zero, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = own = len(self)
        return own


def _narrow(numbers: np.ndarray) -> type:
    low, high = (numbers.min(), numbers.max()) if len(numbers) else (0, 0)
    return next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _planes(column: np.ndarray) -> list[np.ndarray]:
    """The first bytes of all numbers, the second ones, and so on."""
    bits = column.view(f"u{column.itemsize}")
    return [(bits >> np.array(8 * i, bits.dtype)).astype(np.uint8) for i in range(column.itemsize)]


def _packed(columns: list[np.ndarray], ends: np.ndarray) -> list[bytes]:
    """Consecutive rows of number columns as bytes: the narrowest type; longer ones by byte planes and compressed. ``ends`` starts with zero."""
    columns = [c if c.dtype.kind == "f" else c.astype(_narrow(c)) for c in columns]
    head, made = "".join(c.dtype.str[1:] for c in columns).encode(), []
    planes = [p for c in columns for p in _planes(c)] if np.diff(ends).max(initial=0) >= PACKED else []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a < PACKED:
            raw = b"".join([c[a:b].tobytes() for c in columns])
        else:
            raw = pa.compress(b"".join([p[a:b] for p in planes]), "zstd", asbytes=True)
        made.append(pack(HEAD, len(columns), b - a) + head + raw)
    return made


def _unpacked(data: bytes) -> list[np.ndarray]:
    n, rows = unpack_from(HEAD, data)
    start = calcsize(HEAD) + 2 * n
    kinds = [np.dtype(data[a : a + 2].decode()) for a in range(calcsize(HEAD), start, 2)]
    if rows >= PACKED:
        data, start = pa.decompress(data[start:], rows * sum(k.itemsize for k in kinds), "zstd", asbytes=True), 0
    columns = []
    for k in kinds:
        if rows >= PACKED:
            own = np.empty(rows, k)
            for i in range(k.itemsize):
                own.view(np.uint8)[i :: k.itemsize] = np.frombuffer(data, np.uint8, rows, start + i * rows)
        else:
            own = np.frombuffer(data, k, rows, start)
        columns.append(own)
        start += rows * k.itemsize
    return columns


def _columns(packs: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The columns of several packs, one after the other; none without a pack."""
    return [np.concatenate(c) for c in zip(*[_unpacked(x.as_py()) for x in packs], strict=True)]


def _inverse(order: np.ndarray) -> np.ndarray:
    made = np.empty(len(order), np.int64)
    made[order] = np.arange(len(order))
    return made


def _ends(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _places(ends: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each token, and its place there; before place zero are the ``lead`` tokens of the part before."""
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), lengths)
    return text, np.arange(len(text)) - (ends - lengths + lead)[text]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of a batch in one array, and where each text ends; ``tokens_of`` by array operations."""
    kind = pa.large_binary()
    closed = pc.binary_join_element_wise(column.cast(kind), pa.scalar(END, kind), pa.scalar(b"", kind), null_handling="replace", null_replacement=b"")
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset :][: len(closed) + 1]
    data = np.frombuffer(closed.buffers()[2][offsets[0] : offsets[-1]].to_pybytes().lower(), np.uint8)
    ends = offsets[1:] - offsets[0] - 1
    kept = WORD[data]
    kept[ends] = True
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    first[ends] = True
    # What follows an end begins a text.
    first[ends[:-1] + 1] = kept[ends[:-1] + 1]
    last = np.searchsorted(np.flatnonzero(first), ends) + 1
    data, starts = data[kept], np.flatnonzero(first[kept])
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]), last


def _lines(words: pa.Array) -> bytes:
    """All words with a space between two."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(b" ", words.type))[0].as_py()


def _cut(docs: DataFrame, size: int, lead: int) -> DataFrame:
    """``docs`` (``_file, _at, _train, text``) as pieces of at least ``size`` tokens, if there are so many, and less than twice as many.

    A piece is a row: its distinct words by their crc32, how often they train, all tokens as places of their words, and
    of each text or part of a long one its address, whether it trains, how many of its tokens are those of the part before, and where it ends.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, texts, room = [], [], 0
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            words, ends = _words(batch.column("text"))
            keys = zip(*[batch.column(c).to_pylist() for c in ("_file", "_at", "_train")], strict=True)
            begin = 0
            for key, end in zip(keys, ends.tolist(), strict=True):
                for a in range(begin, end, size):
                    before = min(a - begin, lead)
                    held.append(words.slice(a - before, min(size, end - a) + before))
                    room += len(held[-1])
                    texts.append((*key, before, room))
                    if room >= size:
                        yield made(number, held, texts)
                        number += 1
                        held, texts, room = [], [], 0
                begin = end
        if texts:
            yield made(number, held, texts)

    def made(number: int, held: list[pa.Array], texts: list) -> pa.RecordBatch:
        tokens = pa.concat_arrays(held).dictionary_encode()
        # No word holds a space.
        words = _lines(tokens.dictionary).split(b" ")
        crc = np.fromiter(map(crc32, words), np.int64, len(words))
        order = np.argsort(crc, kind="stable")
        symbols = _inverse(order).astype(np.int32)[tokens.indices.to_numpy()]
        file, at, train, before, ends = np.array(texts, np.int64).T
        text, place = _places(ends, before)
        counts = np.bincount(symbols[(place >= 0) & (train[text] > 0)], minlength=len(words))
        return rows_of(
            piece=pa.array([number]),
            trained=pa.array([int(counts.sum())]),
            words=pa.array([b" ".join([words[i] for i in order.tolist()])], pa.binary()),
            counts=pa.array(_packed([counts, np.minimum(np.bincount(symbols), 2)], np.array([0, len(counts)])), pa.binary()),
            tokens=pa.array(_packed([symbols], np.array([0, len(symbols)])), pa.binary()),
            texts=pa.array(_packed([file, at, train, before, ends], np.array([0, len(ends)])), pa.binary()),
        )

    schema = "piece long, trained long, words binary, counts binary, tokens binary, texts binary"
    return docs.select("_file", "_at", "_train", "text").mapInArrow(cut, schema)


#: What a bucket answers to a piece, in the order of the question. Rows without a piece hold sums of the bucket by ``key``.
ANSWER = "level int, bucket int, piece long, data binary, key array<long>, sums array<double>"
ASKED = "bucket int, piece long, data binary"
#: The column of a question that is sent as differences.
ASCENDING = 3


def _asked(piece: int, bucket: np.ndarray, parts: int, columns: list[np.ndarray]) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The questions of a piece, one row for each bucket; ``bucket`` is sorted."""
    sizes = np.bincount(bucket, minlength=parts)
    used = np.flatnonzero(sizes)
    ends = _ends(sizes[used])
    if len(columns) > ASCENDING:
        first = columns[ASCENDING]
        columns[ASCENDING] = np.diff(columns[ASCENDING], prepend=0)
        columns[ASCENDING][ends[:-1]] = first[ends[:-1]]
    own = pa.array(np.full(len(used), piece, np.int64))
    return {"bucket": pa.array(used.astype(np.int32)), "piece": own, "data": pa.array(_packed(columns, ends), pa.binary())}, ends


def _answers(level: int, asked: list[pa.RecordBatch], columns: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    data, done = _packed(columns, ends), 0
    for batch in asked:
        n = batch.num_rows
        own = {"level": pa.array(np.full(n, level, np.int32)), "bucket": batch.column("bucket"), "piece": batch.column("piece")}
        yield rows_of(**own, data=pa.array(data[done : done + n], pa.binary()), key=pa.nulls(n, pa.list_(pa.int64())), sums=pa.nulls(n, pa.list_(pa.float64())))
        done += n


def _sums(level: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    own = {"level": pa.array(np.full(n, level, np.int32)), "bucket": pa.nulls(n, pa.int32()), "piece": pa.nulls(n, pa.int64()), "data": pa.nulls(n, pa.binary())}
    return rows_of(**own, key=pa.array(keys.tolist(), pa.list_(pa.int64())), sums=pa.array(sums.tolist(), pa.list_(pa.float64())))


def _numbered(cut: DataFrame, parts: int) -> DataFrame:
    """To each word of each piece its number from one, its count in training, and whether it is met again; the sums are distinct words in training, and the highest number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, words, counts in zip(*[batch.column(c) for c in ("piece", "words", "counts")], strict=True):
                own = words.as_py().split(b" ")
                crc = np.fromiter(map(crc32, own), np.int64, len(own))
                made, ends = _asked(piece.as_py(), crc * parts >> 32, parts, _unpacked(counts.as_py()))
                blocks = [b" ".join(own[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield rows_of(**made, words=pa.array(blocks, pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Numbers] = defaultdict(Numbers)
        asked, numbers, packs = [], [], []
        for batch in batches:
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                own = words.as_py().split(b" ")
                # No two buckets give the same number.
                numbers.append(np.fromiter(map(known[bucket].__getitem__, own), np.int64, len(own)) * parts + bucket + 1)
            packs += [_unpacked(x.as_py()) for x in batch.column("data")]
            asked.append(batch.select(["bucket", "piece"]))
        if numbers:
            ends = _ends([len(x) for x in numbers])
            all_numbers = np.concatenate(numbers)
            word, back = np.unique(all_numbers, return_inverse=True)
            totals, seen = (np.bincount(back, np.concatenate(c), len(word)).astype(np.int64) for c in zip(*packs, strict=True))
            yield from _answers(0, asked, [all_numbers, totals[back], (seen > 1)[back].astype(np.int8)], ends)
            yield _sums(0, np.zeros((1, 1), np.int64), np.array([[(totals > 0).sum(), word[-1]]], float))

    asked = cut.select("piece", "words", "counts").mapInArrow(ask, ASKED + ", words binary")
    return asked.repartitionById(parts, "bucket").mapInArrow(count, ANSWER)


@dataclass
class Shape:
    """What every piece has to know: numbers, and for each length the kept ones of the contexts that are split (hashes, sorted)."""

    parts: int
    split: int
    tokens: int
    distinct: int
    top: int
    kept: list[np.ndarray] = field(default_factory=list)


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of word numbers."""
    return reduce(_mixed_with, words, np.zeros(len(words[0]), np.uint64))


def _mixed_with(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _sorted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys below ``most`` in order, the row of each, and where distinct ones begin; one sort of keys with their rows, if both fit a number."""
    bits = len(keys).bit_length()
    if int(most).bit_length() + bits > 63:
        rows = np.argsort(keys, kind="stable")
        ordered = keys[rows]
    else:
        both = keys << bits
        both |= np.arange(len(keys))
        both.sort()
        ordered = both >> bits
        both &= (1 << bits) - 1
        rows = both
    first = np.empty(len(keys), bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered, rows, first


def _distinct(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``most``, sorted, and the place of each key among them."""
    ordered, rows, first = _sorted(keys, most)
    place = np.empty(len(keys), np.int64)
    place[rows] = np.cumsum(first) - 1
    return ordered[first], place


class Grams:
    """The grams of a piece, from single words to those behind a context of ``level`` words.

    Of each token: ``n`` is the count of its gram in all training texts, ``again`` whether any text has it at another place, ``p`` its
    probability. Only tokens whose context trains and is met again are asked for; those of a longer context are some of them,
    so each length sorts fewer. Of these, ``place`` has the gram. ``row`` has a token of each gram, ``words`` the word of each token, ``hash`` that of its context.
    """

    def __init__(self, row: pa.Table, answers: pa.Table, shape: Shape):
        self.shape, self.level = shape, 0
        self.piece = row.column("piece")[0].as_py()
        tokens = _unpacked(row.column("tokens")[0].as_py())[0]
        self.file, self.at, train, lead, self.ends = (x.astype(np.int64) for x in _unpacked(row.column("texts")[0].as_py()))
        lengths = np.diff(self.ends, prepend=0)
        self.within = np.arange(len(tokens), dtype=np.int32) - np.repeat((self.ends - lengths).astype(np.int32), lengths)
        self.own = self.within >= np.repeat(lead.astype(np.int32), lengths)
        self.train = self.own & np.repeat(train > 0, lengths)
        self.answers = answers.sort_by([("level", "ascending"), ("bucket", "ascending")])
        ids, n, again = self.answer()
        order = np.argsort(ids)
        self.ids = ids[order].astype(np.int64)
        self.tokens = _inverse(order).astype(np.int32)[tokens]
        n = n[order].astype(np.int64)
        self.known, self.base = n > 0, (n + UNIGRAM) / (shape.tokens + UNIGRAM * (shape.distinct + 1))
        self.n, self.again, self.p = n[self.tokens], (again[order] > 0)[self.tokens], self.base[self.tokens]
        self.place, self.most = self.tokens.copy(), len(n)
        self.words, self.hash = self.ids[self.tokens], np.zeros(len(self.tokens), np.uint64)

    def answer(self) -> list[np.ndarray]:
        return _columns(self.answers.filter(pc.equal(self.answers.column("level"), self.level)).column("data"))

    def longer(self) -> None:
        """Goes on to the grams with one word more before them; ``p`` of those that are asked for is still that of the suffix."""
        self.level = k = self.level + 1
        # A context is the gram of the token before, so its count is known.
        node = self.within >= k
        node[1:] &= self.n[:-1] > 0
        open_ = node.copy()
        open_[1:] &= self.again[:-1]
        self.live = np.flatnonzero(open_)
        # A context that is nowhere else is kept if it trains, as that pays if its suffix is not sure. One that never trains is no node. Both are known here.
        alone = node & ~open_
        before = self.n
        self.n, self.again = alone.astype(np.int64), np.zeros(len(alone), bool)
        self.p = np.where(alone & (self.p < 1), self.followed(1, self.p, 1), self.p)
        self.hash[k:] = _mixed_with(self.hash[k:], self.words[:-k])
        size = len(self.ids)
        keys = self.place[self.live] * np.int64(size)
        keys += self.tokens[self.live - k]
        _, self.rows, self.first = _sorted(keys, self.most * size)
        self.begin = np.flatnonzero(self.first)
        self.most = len(self.begin)
        self.row = self.live[self.rows[self.first]]
        self.total = before[self.row - 1]
        self.mixed = self.hash[self.row]
        self.hot = self.total >= self.shape.split
        key = self.mixed.copy()
        key[self.hot] = _mixed([self.mixed[self.hot], self.words[self.row[self.hot]]])
        # Sorted by radix as long as the buckets are numbers of two bytes.
        self.bucket = ((key >> np.uint64(20)) % np.uint64(self.shape.parts)).astype(np.min_scalar_type(self.shape.parts))
        self.order = np.argsort(self.bucket, kind="stable")

    def learn(self) -> None:
        """Takes the answers: ``n`` of each gram, and whether its context is kept."""
        n, said = np.zeros((2, len(self.row)), np.int64)
        for own, column in zip((n, said), self.answer(), strict=False):
            own[self.order] = column
        kept = said % 2 > 0
        if self.hot.any():
            kept[self.hot] = find(self.shape.kept[self.level - 1], self.mixed[self.hot]) >= 0
        place, p = np.empty(len(self.live), np.int32), self.p[self.row]
        place[self.rows] = np.cumsum(self.first, dtype=np.int32) - 1
        self.place[self.live] = place
        self.n[self.live], self.again[self.live] = n[place], (said >= 2)[place]
        self.p[self.live] = np.where(kept, self.followed(n, p, self.total), p)[place]

    def followed(self, n: np.ndarray | int, p: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        """Probabilities of grams whose context is kept."""
        return (n + SMOOTHING * p) / (total + SMOOTHING)

    def asked(self, turn: int, turns: int) -> pa.Table:
        """What the buckets of a turn are asked: grams with their count here (``-1 - count`` if the context is split), and what the suffix says."""
        order = self.order if turns == 1 else self.order[self.bucket[self.order] % turns == turn]
        n = np.add.reduceat(self.train[self.live[self.rows]], self.begin, dtype=np.int64) if len(self.row) else self.begin
        seen = np.minimum(np.diff(self.begin, append=len(self.rows)), 2)
        row = self.row[order]
        words = [self.words[row - j] for j in range(self.level + 1)]
        columns = [self.p[row], np.where(self.hot, -1 - n, n)[order], seen[order], *words]
        return pa.table(_asked(self.piece, self.bucket[order], self.shape.parts, columns)[0])

    def scores(self) -> pa.Table:
        begin = np.concatenate([[0], self.ends[:-1]])
        of = lambda x: pa.array(np.add.reduceat(np.where(self.own, x, 0), begin))
        sums = {"n_tokens": of(1), "n_known": of(self.known[self.tokens].astype(np.int64))}
        sums |= {"base_score": of(np.log10(self.base)[self.tokens]), "score": of(np.log10(self.p))}
        return pa.table({"_file": pa.array(self.file), "_at": pa.array(self.at), **sums})


def _folded(words: list[np.ndarray], top: int) -> np.ndarray:
    """One number for each row of word numbers up to ``top``, without collisions."""
    made, most = words[0].astype(np.int64), top + 1
    for w in words[1:]:
        if most * (top + 1) >= 1 << 63:
            made = np.unique(made, return_inverse=True)[1]
            most = len(made)
        made, most = made * (top + 1) + w, most * (top + 1)
    return made


def _solved(asked: DataFrame, level: int, shape: Shape, turns: int) -> DataFrame:
    """The answers for grams behind ``level`` words: their count, and one if the context is kept, plus two if the gram is met again.

    Contexts that are split over the buckets get sums instead, to be tested when these are added up.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packs = [], []
        for batch in batches:
            for x in batch.column("data"):
                packs.append(_unpacked(x.as_py()))
                packs[-1][ASCENDING] = np.cumsum(packs[-1][ASCENDING], dtype=np.int64)
            held.append(batch.select(["bucket", "piece"]))
        if not packs:
            return
        ends = _ends([len(x[0]) for x in packs])
        q, n, seen, *words = (np.concatenate(c) for c in zip(*packs, strict=True))
        del packs
        words, n = [w.astype(np.int64) for w in words], n.astype(np.int64)
        folded = _folded(words[1:], shape.top)
        distinct, context = _distinct(folded, int(folded.max()) + 1)
        gram, back = _distinct(context * (shape.top + 1) + words[0], len(distinct) * (shape.top + 1))
        hot = np.zeros(len(gram), bool)
        hot[back[n < 0]] = True
        count = np.bincount(back, np.where(n < 0, -1 - n, n), len(gram))
        suffix = np.empty(len(gram))
        suffix[back] = q
        begin = np.flatnonzero(np.diff(gram // (shape.top + 1), prepend=-1))
        total = np.add.reduceat(count, begin)
        gain = np.add.reduceat(count * (np.log(count + SMOOTHING * suffix) - np.log(suffix)), begin)
        different = np.add.reduceat((count > 0).astype(float), begin)
        kept = _pays(total, gain, different) & ~hot[begin]
        again = np.bincount(back, seen, len(gram)) > 1
        said = np.repeat(kept, np.diff(begin, append=len(gram))) + 2 * again
        yield from _answers(level, held, [count[back].astype(np.int64), said[back]], ends)
        split = np.flatnonzero(hot[begin])
        if len(split):
            row = np.empty(len(gram), np.int64)
            row[back] = np.arange(len(back))
            keys = np.stack([w[row[begin[split]]] for w in words[1:]], 1)
            yield _sums(level, keys, np.stack([total, gain, different], 1)[split])

    return asked.repartitionById(-(-shape.parts // turns), (F.col("bucket") / turns).cast("int")).mapInArrow(solve, ANSWER)


def _pays(total: np.ndarray, gain: np.ndarray, different: np.ndarray) -> np.ndarray:
    """The divergence test of contexts, ``gain`` without the term of the total."""
    return (total > 0) & (gain - total * np.log(total + SMOOTHING) > 0.5 * np.log(np.maximum(total, 1)) * different)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``written``; the shuffle files of the job go when it has ended."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return written(df, label)
    finally:
        conf.set(name, before)


def _sent(cut: DataFrame, answers: list[DataFrame], shape: Shape, level: int, act: Callable[[Grams], pa.Table], schema: str) -> DataFrame:
    """What ``act`` makes of the grams of each piece, with the answers for ``level`` words of context, no more."""

    def make(row: pa.Table, known: pa.Table) -> pa.Table:
        grams = Grams(row, known, shape)
        for _ in range(level):
            grams.longer()
            grams.learn()
        return act(grams)

    known = reduce(DataFrame.unionByName, [x.select("level", "bucket", "piece", "data").filter("piece is not null") for x in answers])
    own = cut.select("piece", "tokens", "texts")
    return own.groupBy("piece").cogroup(known.groupBy("piece")).applyInArrow(make, schema)


def _joined(rows: DataFrame, cut: DataFrame, tokens: int, levels: int, split: int) -> DataFrame:
    """The scores of addressed ``rows``; their pieces meet the counts of each length in buckets."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET + 1)
    answers = [_stored(_numbered(cut, parts), "grams0")]
    sums = answers[0].filter("key is not null").agg(F.sum(F.col("sums")[0]), F.max(F.col("sums")[1])).first()
    shape = Shape(parts, split, tokens, int(sums[0]), int(sums[1]))
    # The words of the pieces are read no more.
    texts = _stored(cut.select("piece", "tokens", "texts"), "pieces")
    discard(cut)
    for level in range(1, levels + 1):
        made = []
        turns = TURNS if level > 1 else 1
        for turn in range(turns):

            def ask(grams: Grams, turn: int = turn, turns: int = turns) -> pa.Table:
                grams.longer()
                return grams.asked(turn, turns)

            asked = _sent(texts, answers, shape, level - 1, ask, ASKED)
            made.append(_stored(_solved(asked, level, shape, turns), f"grams{level}"))
        answers += made
        # At most as many as training tokens hold contexts with ``split`` of them.
        hot = reduce(DataFrame.unionByName, made).filter("key is not null").groupBy("key").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(3)])
        hot = hot.toArrow()
        keys = np.array(hot["key"].to_pylist(), np.int64).reshape(-1, level)[_pays(*[hot[f"s{i}"].to_numpy() for i in range(3)])]
        shape.kept.append(np.sort(_mixed(list(keys.T))))
    scored = _sent(texts, answers, shape, levels, Grams.scores, "_file long, _at long, n_tokens long, n_known long, base_score double, score double")
    scored = scored.groupBy("_file", "_at").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return rows.drop("text").join(scored, ["_file", "_at"])


def _by_tree(rows: DataFrame, tree: Tree) -> DataFrame:
    """The scores of ``rows`` by a tree that is sent to the tasks."""
    schema = rows.select("_doc", "_held").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    unseen = UNIGRAM / (tree.tokens + UNIGRAM * (tree.distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, ends = tokens_of(batch.column("text"))
            symbols = np.fromiter((tree.ids.get(w, -1) for w in words), np.int64, len(words))
            known = symbols >= 0
            unigram = np.where(known, tree.base[symbols], unseen) if len(tree.base) else np.full(len(words), unseen)
            own = probabilities(tree, symbols, contexts(tree, symbols, ends, len(tree.levels)), unigram)
            begin = np.concatenate([[0], ends[:-1]])
            yield rows_of(
                _doc=batch.column("_doc"),
                _held=batch.column("_held"),
                n_tokens=pa.array(ends - begin),
                n_known=pa.array(np.add.reduceat(known.astype(np.int64), begin)),
                base_score=pa.array(np.add.reduceat(np.log10(unigram), begin)),
                score=pa.array(np.add.reduceat(np.log10(own), begin)),
            )

    return rows.select("_doc", "_held", "text").mapInArrow(score, schema)


def scores(
    docs: DataFrame,
    held_out: Column | None = None,
    levels: int = LEVELS,
    keep: tuple[str, ...] | None = None,
    tree_tokens: int = TREE_TOKENS,
    piece: int = PIECE,
    split: int = SPLIT,
) -> DataFrame:
    """``_doc, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row.

    Needs ``doc_id`` and ``text``; other columns stay in ``_doc``, all or those to
    ``keep``. The rows that are not ``held_out`` (crc32 of the id as text, modulo ten, zero) train the tree. Null
    texts and those without words have one token, the end. Scores are decimal logarithms:
    ``base_score`` of the smoothed unigrams, ``score`` of the tree. Repeated rows train
    and are scored each. An empty table gives an empty table; without training rows all probabilities are one
    (there is one unseen symbol). Above ``tree_tokens`` training tokens the tree is joined, not sent to the tasks; it is the same tree.
    """
    out = fold_of(docs["doc_id"], FOLDS) == 0 if held_out is None else held_out
    rows = addressed(packed(docs.withColumn("_held", out), "_held", "text", keep=keep or tuple(docs.columns)), "texts")
    train = F.when(~F.col("_held"), 1).otherwise(0).alias("_train")
    cut = _stored(_cut(rows.select("_file", "_at", train, "text"), piece, levels), "pieces")
    tokens = cut.agg(F.sum("trained")).first()[0] or 0
    if tokens <= tree_tokens:
        training = docs.filter(~out).select("text")
        made = _by_tree(rows, grow(training, written(_word_counts(training), "words"), levels))
    else:
        made = _joined(rows, cut, tokens, levels, split)
    return made.select(
        "_doc",
        F.col("_held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
