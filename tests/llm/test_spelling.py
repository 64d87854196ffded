import random
import re
import zlib
from collections import Counter, defaultdict

from quire.llm.queries import QUERIES
from quire.llm.spelling import counted, variants
from tests.llm.brute import az_lower


def brute_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = az_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    return seen


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(seen):
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    gaps = defaultdict(set)  # pairs of near words share a string with one code point less, or one is such a string
    for w in words:
        gaps[w].add(w)
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w, n in words.items():
        some = {v for s in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for v in gaps[s]}
        own = [v for v in some if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(own), form, words.get(form))
    def root(w):
        while out[w][2]:
            w = out[w][2]
        return w
    return {w: (*v, root(w)) for w, v in out.items()}


def got(df):
    rows = df.collect()
    made = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(made) == len(rows)
    return made


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(brute_words(rows))
    assert got(QUERIES["op11_spelling"](spark, sf_dir)) == want
    assert any(v[2] for v in want.values())


def test_near_words_of_every_kind(spark):
    """A small alphabet: rows of equal letters, ties, chains of forms, letters of two bytes."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abÀÿ×", k=rng.randint(4, 7))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "abcde", "abcdf", "abcdeé"]
    text = [" ".join(w for w in words for _ in range(rng.choice([1, 2, 3, 3, 7, 20]))) for _ in range(5)]
    rows = list(enumerate(text)) + [(None, text[0]), (7, None), (8, ""), (8, "1 2"), (1, text[1]), (9, "AAAAA Abcde ABCDE É" * 4), (10, "x" * 100_000 + " " + "é" * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    assert {r.word: r.n for r in counted(df).collect()} == dict(brute_words(rows))
    want = brute(brute_words(rows))
    assert got(variants(df)) == want and len({v[4] for v in want.values()}) > 1


def test_chain_and_ties(spark):
    text = "lettera " * 3 + "letterb " * 3 + "letterbc " * 6 + "letterbcd " * 12 + "letterx " * 6
    made = got(variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), cut=1 << 33))
    assert made["lettera"][2] == "letterx" and made["letterb"][2] == "letterbc"
    assert made["letterb"][4] == made["letterbcd"][4] == "letterbcd" and made["letterbcd"][2] is None


def test_empty_table(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
