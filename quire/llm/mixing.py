"""Document rates that mix soft domains to target weights.

A classifier learnt from a labelled table gives every document a posterior over
domains (naive Bayes on hashed words and word shapes, with the evidence of a text
tempered by its length). A document of ``t`` tokens sampled at rate ``r`` then adds ``r * t * p_k``
expected tokens to domain ``k``. Nonnegative rates are fitted so that the expected totals
match the targets, by projected gradient on the weighted least squares

    sum over k of (total_k(r) - target_k)^2 / tokens_k,

where ``tokens_k`` is the total at rate one. In the metric of the tokens the step of one
document is ``r <- clip(r - sum over k of p_k * error_k / tokens_k)``, and a step length of one is
always safe, as the scaled Gram matrix is stochastic. Steps are accelerated: each starts from
where the last two point, and from the last alone after a step that made the fit worse (which is
taken back). Only the ``K`` sums of an iteration pass through the driver; a task repeats the last few steps of
its rows from ``K + 1`` numbers each, and after ``HELD`` of them the rates are written down, so a lost executor costs a re-read.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quire.llm.common import drawn, packed, pieces, rows_of
from quire.session import discard, written

SAMPLE = 20_000
BUCKETS = 1 << 15
EVIDENCE = 30.0
MAX_RATE = math.inf
TOLERANCE = 1e-4
HELD = 20
#: Without a hundredth of the misfit gone in so many steps the targets count as out of reach.
WINDOW = 50
CACHE = 400_000

_LOG = logging.getLogger(__name__)
_SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256)
)
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray  # bucket x domain, log probabilities less their mean over the domains


class Evidence:
    """Hashed features of the words of a text: its letters and its shape."""

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: bytes) -> np.ndarray:
        out, seen = [], self.seen
        for word in text.split():
            own = seen.get(word)
            if own is None:
                if len(seen) >= CACHE:
                    seen.clear()
                shape = word.translate(_SHAPE)
                own = (crc32(word.translate(_LETTERS).strip()) % BUCKETS, crc32(b"#" + shape[:1] + shape[-3:]) % BUCKETS)
                seen[word] = own
            out += own
        return np.array(out, np.int64)


def learn(labelled: DataFrame) -> Classifier:
    """The classifier from ``text, domain``; rows with a null domain are left out. No rows, no domains."""
    rows = written(labelled.filter("domain is not null").select(F.coalesce("text", F.lit("")).alias("text"), "domain"), "labelled")
    # Domains are named by the labels: as many as there are targets, not as there are rows.
    domains = [r.domain for r in rows.groupBy("domain").count().orderBy("domain").collect()]
    place = {d: i for i, d in enumerate(domains)}
    k = len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, total, n = Evidence(), np.zeros((BUCKETS, k), np.int64), np.zeros(k, np.int64)
        for batch in pieces(batches):
            for text, domain in zip(batch.column("text").cast(pa.binary()), batch.column("domain").to_pylist(), strict=True):
                total[:, place[domain]] += np.bincount(evidence.of(text.as_py()), minlength=BUCKETS)
                n[place[domain]] += 1
        b, d = np.nonzero(total)
        yield rows_of(
            bucket=pa.array(np.append(b, np.full(k, -1))), domain=pa.array(np.append(d, np.arange(k))), c=pa.array(np.append(total[b, d], n))
        )

    if not k:
        return Classifier([], np.zeros(0), np.zeros((BUCKETS, 0)))
    got = rows.mapInArrow(count, "bucket long, domain long, c long").groupBy("bucket", "domain").agg(F.sum("c").alias("c")).toArrow()
    b, d, c = (got[x].to_numpy() for x in ("bucket", "domain", "c"))
    total, n = np.zeros((BUCKETS, k)), np.zeros(k)
    n[d[b < 0]] = c[b < 0]
    total[b[b >= 0], d[b >= 0]] = c[b >= 0]
    logs = np.log((total + 0.5) / (total.sum(0) + 0.5 * BUCKETS))
    return Classifier(domains, np.log(n / n.sum()), logs - logs.mean(1, keepdims=True))


def posteriors(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``_doc, tokens, p``: words of the whole text and the probability of each domain, in the classifier's order."""
    rows = packed(docs, "text", keep=keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, evidence = classifier, Evidence()
        for batch in pieces(batches):
            counts, p = [], []
            for text in batch.column("text").cast(pa.binary()):
                own = evidence.of(text.as_py() or b"")
                z = model.weights[own].sum(0)
                z = model.prior + z * (EVIDENCE / (EVIDENCE + len(own)))
                z = np.exp(z - z.max()) if len(z) else z
                counts.append(len(own) // 2)
                p.append((z / z.sum()).tolist() if len(z) else [])
            yield rows_of(_doc=batch.column("_doc"), tokens=pa.array(counts, pa.int64()), p=pa.array(p, pa.list_(pa.float64())))

    schema = packed(docs, keep=keep).schema.add("tokens", "long").add("p", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)


def _stepped(p: np.ndarray, steps: list, top: float, rate: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of rows after the given steps, and one step earlier; a step is its momentum and what a domain takes off."""
    for push, off in steps:
        rate, before = np.clip(rate + push * (rate - before) - p @ off, 0.0, top), rate
    return rate, before


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy().reshape(-1, k)


def mixed(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] | Callable[[list[str]], dict[str, float]] | None = None,
    max_rate: float = MAX_RATE,
    steps: int | None = None,
    tolerance: float = TOLERANCE,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``_doc, tokens, domain, p, rate``: every row with its likeliest domain, its posterior and its rate.

    Needs ``text`` in ``docs``; other columns stay in ``_doc``, all or those to ``keep``.
    ``labelled`` has ``text, domain`` and should be a bounded sample. ``targets`` are the wanted shares
    of the tokens by domain (default: equal), or what makes them from the names of the labelled domains; they are scaled to one,
    and domains without one get none.
    The total is the smallest at which no domain has to give up tokens it has: scarce
    domains are repeated before others are thinned out. A ``max_rate`` (default: none) can keep totals from their targets.
    Steps end at the tolerance, or when ``WINDOW`` of them in a row hardly better the fit, as with targets that no rates meet (or
    after ``steps``, if given); the totals of each domain are logged, as a warning if they miss the targets. Null and
    empty texts have no tokens and their posterior is the prior; their rate is fitted as
    that of any row. Without labelled rows there are no domains and all rates are one. Repeated
    rows have equal rates; an empty table gives an empty table.
    """
    classifier = learn(labelled)
    rows = written(posteriors(docs, classifier, keep), "posteriors")
    k = len(classifier.domains)
    names = F.array(*[F.lit(d) for d in classifier.domains]) if k else F.array().cast("array<string>")
    named = F.get(names, F.expr("array_position(p, array_max(p)) - 1").cast("int")).alias("domain")
    if not k:
        return rows.select("_doc", "tokens", named, "p", F.lit(1.0).alias("rate"))
    if callable(targets):
        targets = targets(classifier.domains)
    share = np.array([(targets or {}).get(d, 0.0 if targets else 1.0) for d in classifier.domains], float)
    share = share / share.sum() if share.sum() > 0 else np.full(k, 1.0 / k)

    ones = rows.select("tokens", "p", F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))

    def held(batch: pa.RecordBatch, own: list) -> tuple[np.ndarray, np.ndarray]:
        return _stepped(_matrix(batch, k), own, max_rate, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("rate", "before")))

    def totals(state: DataFrame, own: list) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for batch in batches:
                out += (held(batch, own)[0] * batch.column("tokens").to_numpy()) @ _matrix(batch, k)
            yield rows_of(k=pa.array(range(k), pa.int32()), s=pa.array(out))

        got = state.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(k)
        for r in got:
            out[r.k] = r.s
        return out

    def advanced(state: DataFrame, own: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rate, before = held(batch, own)
                yield rows_of(tokens=batch.column("tokens"), p=batch.column("p"), rate=pa.array(rate), before=pa.array(before))

        return written(state.mapInArrow(run, ones.schema), "rates")

    plain = totals(ones, [])
    wanted = share * max((plain[i] / share[i] for i in range(k) if share[i] > 0), default=0.0)
    misfit = lambda x: float(np.divide((x - wanted) ** 2, plain, out=np.zeros(k), where=plain > 0).sum())
    state, pending, done = ones, [], []
    last = earlier = plain
    fits, pace = [misfit(plain)], 1.0
    while np.abs(last - wanted).max() > tolerance * max(wanted.sum(), 1.0) and (steps is None or len(done) < steps):
        quicker = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / quicker
        # Totals are linear in the rates, so those of the starting point need no pass.
        error = last + push * (last - earlier) - wanted
        step = (push, np.divide(error, plain, out=np.zeros(k), where=plain > 0))
        now = totals(state, [*pending, step])
        if misfit(now) >= fits[-1]:
            if push == 0:
                break
            pace = 1.0
            continue
        pending, done = [*pending, step], [*done, step]
        last, earlier, pace = now, last, quicker
        fits.append(misfit(now))
        if len(fits) > WINDOW and fits[-1] > 0.99 * fits[-1 - WINDOW]:
            break
        if len(pending) >= HELD:
            old, state, pending = state, advanced(state, pending), []
            if old is not ones:
                discard(old)
    met = np.abs(last - wanted).max() <= tolerance * max(wanted.sum(), 1.0)
    said = ", ".join(f"{d} {a:.1f} of {b:.1f}" for d, a, b in zip(classifier.domains, last, wanted, strict=True))
    _LOG.log(logging.INFO if met else logging.WARNING, "mixing: tokens by domain after %d steps: %s", len(done), said)
    if state is not ones:
        discard(state)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = np.ones(batch.num_rows)
            own = pa.array(_stepped(_matrix(batch, k), done, max_rate, ones, ones)[0])
            yield rows_of(**{n: batch.column(n) for n in ("_doc", "tokens", "p")}, rate=own)

    out = rows.mapInArrow(rate, rows.withColumn("rate", F.lit(1.0)).schema)
    return out.select("_doc", "tokens", named, "p", "rate")


def labelled_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, domain`` of about ``sample`` labelled documents: their language, and whether they are good text."""
    known = F.broadcast(drawn(labels.select("doc_id", "quality"), sample))
    rows = docs.select("doc_id", "text", "lang").join(known, "doc_id")
    kind = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return rows.select("text", F.concat(F.coalesce("lang", F.lit("other")), F.lit("/"), kind).alias("domain"))


def language_targets(domains: list[str]) -> dict[str, float]:
    """Of each language that has labels the same share, a tenth of it poor text if it has both kinds."""
    part = {"good": 0.9, "poor": 0.1}
    pairs = [tuple(d.rsplit("/", 1)) for d in domains]
    whole = {lang: sum(part[k] for own, k in pairs if own == lang) for lang, _ in pairs}
    return {f"{lang}/{kind}": part[kind] / whole[lang] for lang, kind in pairs}


def repeats(rate, key):
    """Whole copies of a row: the rate rounded up or down by a hash of its key, so that sums are kept on average."""
    u = F.pmod(F.xxhash64(key, F.lit("repeats")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")
