import random
from collections import defaultdict

import numpy as np
import pytest

import quire.llm.suffix_dedup as M
from quire.llm.suffix_dedup import LENGTH, multikey, without_repeats


def brute(texts):
    """What is left of each text, and the runs removed."""
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, b in enumerate(data):
        for p in range(len(b) - LENGTH + 1):
            places[b[p : p + LENGTH]].append((i, p))
    gone = [bytearray(len(b)) for b in data]
    for own in places.values():
        if len(own) > 1:
            for i, p in own:
                gone[i][p : p + LENGTH] = b"\x01" * LENGTH
    out = []
    for b, g in zip(data, gone, strict=True):
        runs = sum(1 for i, x in enumerate(g) if x and (not i or not g[i - 1]))
        out.append((len(b), sum(g), runs, bytes(x for x, y in zip(b, g, strict=True) if not y)))
    return out


def check(spark, texts, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r._doc.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def made(seed, letters="abcdefgh ", n=40):
    """Texts that share passages of around the length, with edits inside, before and behind them."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(letters, k=k))
    shared = [word(k) for k in (150, 199, 200, 201, 260, 400, 900)]
    texts = []
    for _ in range(n):
        text = word(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(part)), rng.randint(0, len(part))))
            part = part[a:b] if rng.random() < 0.5 else part
            if part and rng.random() < 0.4:
                k = rng.randrange(len(part))
                part = part[:k] + rng.choice("xyzä") + part[k + 1 :]
            text += part + word(rng.randint(0, 200))
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    check(spark, made(seed))


def test_boundaries_of_small_buckets(spark, monkeypatch):
    """With two rows a bucket nearly every neighbour is across a boundary."""
    monkeypatch.setattr(M, "BUCKET_ROWS", 2)
    check(spark, made(9, n=12))


def test_edges(spark):
    one = "".join(random.Random(4).choices("abc", k=500))
    texts = [
        None, "", "short", None, "x" * 199, "x" * 199, "y" * 200, "z" * 201, "q" * 5000, "pq" * 400, "\0" * 300 + "a", "\0" * 300,
        one, one, one[1:], "é" * 120, "é" * 120, "ü" + one[:199], "ü" + one[:199] + "w", one[:200] + "\n" + one[300:],
    ]
    check(spark, texts)


def test_long_text_in_strides(spark, monkeypatch):
    monkeypatch.setattr(M, "STRIDE", 1000)
    rng = random.Random(2)
    one = "".join(rng.choices("abcdefghij", k=30_000))
    check(spark, [one[:20_000] + one[5_000:9_000] + "!" + one[5_000:5_210], one[19_900:], "k" * 20_000], parts=1)


def test_repeated_rows_other_columns_and_empty_tables(spark):
    text = "".join(random.Random(1).choices("abcdef", k=260))
    own = "text string, row long, spans string, lead int, n_bytes int, _doc string"
    rows = [(text, 1, "s", 2, 3, "d")] * 3 + [(None, None, None, None, None, None), (text[:210], 1, "s", 2, 3, "d")]
    got = without_repeats(spark.createDataFrame(rows, own)).collect()
    assert len(got) == 5 and all(r.n_removed == r.n_bytes and r._doc.lead in (2, None) for r in got)
    assert without_repeats(spark.createDataFrame([], own)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 24), dtype=np.uint8)
    rows[::3, :20] = 1
    order, shared = multikey(rows.view(">u8").astype(np.uint64))
    keys = [r.tobytes() for r in rows]
    assert [keys[i] for i in order] == sorted(keys)
    for a, b, k in zip(order, order[1:], shared, strict=False):
        same = next((i for i in range(24) if keys[a][i] != keys[b][i]), 24)
        assert k == same
