import math
import random
import re
from collections import Counter

import numpy as np

import quire.llm.lexical as L
from quire.llm.lexical import bounds, index, measure, most, search, split, steps
from quire.session import addressed
from tests.llm.brute import az_lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(TERM, az_lower(text)) if text is not None else []


def all_scores(docs, items):
    counted = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    total, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for _, text in items:
        own = words(text)
        out.append([
            sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * n * total) // length))) for t in own if t in c) if n else 0
            for (_, c), n in zip(counted, sizes, strict=True)
        ])
    return out


def brute(docs, items, top=10):
    out = Counter()
    for (item, _), scores in zip(items, all_scores(docs, items), strict=True):
        ranked = sorted((-s, d is None, d or 0) for (d, _), s in zip(docs, scores, strict=True) if s > 0)[:top]
        out.update((item, k, None if null else d, -s) for k, (s, null, d) in enumerate(ranked, 1))
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    lexicon = [f"{rng.choice('abcäÉ')}{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(lexicon[: rng.choice([5, 60])], k=rng.choice([0, 1, 5, 30, 400])))) for i in range(n)]
    docs += [(n, None), (n + 1, "... !"), (None, docs[3][1]), (5, docs[5][1]), (n + 2, "word " * 30_000 + "x" * 70_000), (n + 3, "A0,A0;b1--C2")]
    items = [(i, ", ".join(rng.choices(lexicon, k=rng.choice([1, 4, 20])))) for i in range(25)]
    return docs, items + [(25, None), (26, ""), (27, "unknownword"), (None, "word a0"), (3, "A0 a0 word"), (28, "x" * 70_000)]


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, _file int, score string").repartition(3)
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, q int")


def test_against_brute_force(spark):
    for seed in range(2):
        docs, items = made(seed)
        got = Counter(tuple(r) for r in search(*frames(spark, docs, items)).select("item_id", "rank", "doc_id", "score").collect())
        assert got == brute(docs, items)


def test_blocks_of_queries_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 16)
    monkeypatch.setattr(L, "STRIDE", 64)
    docs, items = made(5)
    got = Counter(tuple(r) for r in search(*frames(spark, docs, items), top=3, query_block=7).collect())
    assert got == brute(docs, items, 3)


def test_bounds_are_never_below_the_score(spark):
    docs, items = made(8)
    d, _ = frames(spark, docs, [])
    rows = addressed(d.select("doc_id", "text")).filter("text is not null")
    own = L.Queries.of(items)
    measure(rows, own)
    exact = {}
    for (doc, _), scores in zip(docs, zip(*all_scores(docs, [i for i in items if words(i[1])]), strict=True), strict=True):
        exact.setdefault(doc, []).append(scores)
    seen = 0
    for b in index(rows).collect():
        made_ = bounds(b.width, np.array(b.n), bytes(b.slices), own)
        for k, doc in enumerate(b.doc_id):
            assert any((made_[:, k] >= np.array(s)).all() for s in exact[doc])
            seen += 1
    assert seen == sum(bool(words(t)) for _, t in docs)


def test_steps():
    tf = np.arange(1, 5000)
    assert (most(steps(tf)) >= tf).all() and (steps(tf)[1:] >= steps(tf)[:-1]).all()
    assert split("Ab-É 1_2 x") == ["ab".encode(), "É".encode(), b"1", "2 x".encode()]


def test_empty_tables(spark):
    docs, items = made(1, 20)
    d, q = frames(spark, docs, items)
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0
