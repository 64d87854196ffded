"""Toxicity scores by a counterfactual-regularised classifier.

A logistic regression on the presence of words and word stems (prefixes of four
to six letters), learnt from labelled texts. Sentences with an identity term are
copied with the term swapped for every other one of its group; a penalty on the squared change of
the logit between a text and its copy keeps the weights of identity terms, and of
what only goes with them, from telling groups apart. Mentions of a group alone then do not
raise a score.

Features are hashed to ``BUCKETS``; their frequencies by label are counted over the whole
sample, and the most telling by rank of their chi-square are used, along with all identity terms: a share ``PER_TEXT``
of the number of labelled texts, ``CHOSEN`` at most. No value of chi-square decides, as it grows with the number of labels.
Features of fewer than ``LEAST`` texts are not used, and equal texts count once. Without a telling feature every score is the share of label 1. The sample of labelled rows is bounded by the parameter ``sample``; scoring covers whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drawn, fold_of, packed, pieces, rows_of
from quire.session import written

SAMPLE = 20_000
BUCKETS = 1 << 20
CHOSEN = 4096
STEMS = (4, 5, 6)
FOLDS = 5
PENALTY = 1.0
RIDGE = 0.00005
LEAST = 5
PER_TEXT = 0.05
STEPS = 800
CACHE = 400_000
#: Terms of a group are swapped for each other. A parameter, not data.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican"),
    ("old", "young"), ("disabled", "deaf", "blind"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer"), ("frau", "mann"), ("femmes", "hommes"), ("femme", "homme"), ("mujeres", "hombres"), ("mujer", "hombre"),
)

#: A-Z to small letters, other ASCII but small letters to spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def buckets(word: bytes) -> list[int]:
    """The word itself and its stems, hashed."""
    text = word.decode()
    out = [crc32(word) % BUCKETS]
    return out + [crc32(f"{text[:n]}*".encode()) % BUCKETS for n in STEMS if len(text) > n]


@dataclass
class Model:
    places: dict[int, int]  # bucket -> weight
    weights: np.ndarray
    bias: float


class Features:
    """Places of the chosen features of a text; words seen are remembered, up to ``CACHE``."""

    def __init__(self, places: dict[int, int]):
        self.places, self.seen = places, {}

    def of(self, words: set[bytes]) -> set[int]:
        out: set[int] = set()
        for word in words:
            own = self.seen.get(word)
            if own is None:
                own = tuple(p for p in map(self.places.get, buckets(word)) if p is not None)
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[word] = own
            if own:
                out.update(own)
        return out


def others(identity: tuple[tuple[str, ...], ...]) -> dict[bytes, list[bytes]]:
    """The other terms of its group for each identity term."""
    return {t.encode(): [o.encode() for o in group if o != t] for group in identity for t in group}


def swaps(text: bytes, groups: dict[bytes, list[bytes]]) -> Iterator[tuple[bytes | None, bytes]]:
    """A text's swaps, of every sentence: the term that leaves the text (none if another sentence has it too) and the one that comes."""
    if groups.keys().isdisjoint(words_of(text)):
        return
    sentences = text.replace(b"!", b".").replace(b"?", b".").replace(b"\n", b".").split(b".")
    terms = [groups.keys() & words_of(s) for s in sentences]
    within = Counter(t for own in terms for t in own)
    for own in terms:
        for term in sorted(own):
            for other in groups[term]:
                yield term if within[term] == 1 else None, other


def swapped(text: bytes, identity: tuple[tuple[str, ...], ...]) -> list[set[bytes]]:
    """The words of a text with an identity term of a sentence swapped, one set for each other term."""
    whole = set(words_of(text))
    return [whole - {gone} | {come} for gone, come in swaps(text, others(identity))]


def fit(
    labelled: DataFrame,
    identity: tuple[tuple[str, ...], ...] = IDENTITY,
    penalty: float = PENALTY,
    ridge: float = RIDGE,
    least: int = LEAST,
    per_text: float = PER_TEXT,
) -> Model:
    """The classifier from ``text, label`` (0 or 1; other rows are left out).

    The rows should be a bounded sample; their texts stay in the tasks, the driver
    gets the places of the chosen features and, of each text, its distinct changes by a swap with their number,
    so a very long text sends no more than the pairs of terms allow.
    Without rows of both labels, or without a feature that tells them apart, every score is the smoothed share of label 1.
    """
    rows = labelled.filter("label in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    rows = written(rows.distinct(), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        total = np.zeros((2, BUCKETS), np.int64)
        n = [0, 0]
        for batch in pieces(batches):
            for text, label in zip(batch.column("text").cast(pa.binary()), batch.column("label").to_pylist(), strict=True):
                own: set[int] = set()
                for word in set(words_of(text.as_py())):
                    if word not in seen:
                        if len(seen) >= CACHE:
                            seen.clear()
                        seen[word] = buckets(word)
                    own.update(seen[word])
                total[label, list(own)] += 1
                n[label] += 1
        used = np.flatnonzero(total.sum(0))
        yield rows_of(bucket=pa.array(np.append(used, -1)), c0=pa.array(np.append(total[0, used], n[0])), c1=pa.array(np.append(total[1, used], n[1])))

    counts = rows.mapInArrow(count, "bucket long, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    bucket, c0, c1 = (counts[k].to_numpy() for k in ("bucket", "c0", "c1"))
    n0, n1 = (int(c[bucket == -1].sum()) for c in (c0, c1))
    prior = (n1 + 0.5) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    expected = (c0 + c1) * n1 / (n0 + n1)
    chi = (c1 - expected) ** 2 / np.maximum(expected * n0 / (n0 + n1), 1e-9)
    chi[(bucket == -1) | (c0 + c1 < least)] = 0
    best = np.lexsort((bucket, -chi))[: min(CHOSEN, int(np.ceil(per_text * (n0 + n1))))]
    chosen = [int(b) for b in bucket[best[chi[best] > 0]]]
    if not chosen:
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    chosen += [b for group in identity for term in group for b in buckets(term.encode())[:1]]
    places = {b: i for i, b in enumerate(dict.fromkeys(chosen))}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, groups = Features(places), others(identity)
        for batch in pieces(batches):
            here, there, times = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                text = text.as_py()
                words = set(words_of(text))
                at = own.of(words)
                here.append(sorted(at))
                # What changes, a feature that goes as -1 - place, and how many swaps change it so. Only swaps with a
                # changed feature say something; a text has at most the square of the number of terms of them.
                changes: Counter[tuple[int, ...]] = Counter()
                left: dict[bytes | None, set[int]] = {None: at}
                for (gone, come), n in Counter(swaps(text, groups)).items():
                    if gone not in left:
                        left[gone] = own.of(words - {gone})
                    new = left[gone] | own.of({come})
                    if new != at:
                        changes[*sorted(new - at), *(-1 - p for p in sorted(at - new))] += n
                there.append(list(changes))
                times.append(list(changes.values()))
            kind = pa.list_(pa.int32())
            yield rows_of(
                label=batch.column("label"),
                here=pa.array(here, kind),
                there=pa.array(there, pa.list_(kind)),
                times=pa.array(times, pa.list_(pa.int64())),
            )

    got = rows.mapInArrow(gather, "label int, here array<int>, there array<array<int>>, times array<bigint>").toArrow()
    return Model(places, *_trained(got, len(places), penalty, ridge))


def _trained(got: pa.Table, size: int, penalty: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum on the regularised loss, classes weighed alike."""
    y = got["label"].to_numpy().astype(float)
    here = got["here"].to_pylist()
    row = np.repeat(np.arange(len(y)), [len(h) for h in here])
    col = np.array([c for h in here for c in h], np.int64)
    pair, column, sign = [], [], []
    changes = [change for own in got["there"].to_pylist() for change in own]
    for i, change in enumerate(changes):
        pair += [i] * len(change)
        column += [c if c >= 0 else -1 - c for c in change]
        sign += [1.0 if c >= 0 else -1.0 for c in change]
    pair, column, sign = np.array(pair, np.int64), np.array(column, np.int64), np.array(sign)
    # Equal changes of a text count as often as they were made.
    share = np.array([t for own in got["times"].to_pylist() for t in own], float)
    share /= max(share.sum(), 1)

    def pull(v: np.ndarray) -> np.ndarray:
        """Gradient of half the mean squared change of the logit."""
        change = share * np.bincount(pair, sign * v[column], len(changes))
        return np.bincount(column, sign * change[pair], size)

    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, speed, speed_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    # The largest curvature by power iteration: steps with momentum hold up to nearly four times its inverse.
    v, v_b, curve = np.ones(size), 1.0, 1.0
    for _ in range(100):
        own = 0.25 * weight * (np.bincount(row, v[col], len(y)) + v_b)
        u, u_b = np.bincount(col, own[row], size) + ridge * v, own.sum()
        if changes:
            u += penalty * pull(v)
        curve = max(float(np.sqrt(u @ u + u_b * u_b)), 1e-9)
        v, v_b = u / curve, u_b / curve
    step = 2.0 / curve
    for _ in range(STEPS):
        z = np.bincount(row, w[col], len(y)) + b
        wrong = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(col, wrong[row], size) + ridge * w
        if changes:
            gradient += penalty * pull(w)
        speed = 0.95 * speed - step * gradient
        speed_b = 0.95 * speed_b - step * wrong.sum()
        w, b = w + speed, b + speed_b
    return w, float(b)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``_doc, score``: every row with the score of its whole text, from 0 to 1.

    Needs ``text``; other columns stay in ``_doc``, all or those to ``keep``. Null counts as
    empty; a text without a known feature gets the score of the bias. Equal
    texts have equal scores. An empty table gives an empty table.
    """
    rows = packed(docs, "text", keep=keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(model.places)
        weights = model.weights.tolist()
        for batch in pieces(batches):
            z = [
                model.bias + sum(weights[i] for i in sorted(own.of(set(words_of(text.as_py() or b"")))))
                for text in batch.column("text").cast(pa.binary())
            ]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield rows_of(_doc=batch.column("_doc"), score=pa.array(p))

    return rows.mapInArrow(score, packed(docs, keep=keep).schema.add("score", "double"))


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """The classifier from about ``sample`` documents with a ``toxic`` label, none of the held-out fold."""
    known = labels.filter(fold_of(labels["doc_id"], FOLDS) != 0).select("doc_id", F.col("toxic").alias("label"))
    known = F.broadcast(drawn(known, sample))
    return fit(docs.select("doc_id", "text").join(known, "doc_id").select("text", "label"), **options)


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, FOLDS) == 0


def not_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    return scored(docs, model).filter(F.col("score") < threshold).select("_doc.*")
