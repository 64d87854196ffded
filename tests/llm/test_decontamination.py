import random
import re

import pytest

from quire.llm.decontamination import contamination, uncontaminated
from tests.llm.brute import az_lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", az_lower(text or ""))


def brute(docs, items, window):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, question in items:
            q = words(question)
            n = min(window, len(q))
            for k in range(len(q) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == q[k : k + n]:
                        hit.update(range(i, i + n))
                        found.add(item)
        out[doc] = (len(w), len(hit), sorted(str(f) for f in found if f is not None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(["a", "B", "ä", "Ä", "c3"]) + rng.choice([" ", ". ", "_", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "...")]
    items = [(i, text(rng.randint(1, 9))) for i in range(8)] + [(50, None), (51, "?!"), (52, "c3"), (None, "a b a b"), (53, "a b a b")]
    docs += [(200, "x " + items[0][1]), (201, items[0][1] * 3)]
    got = contamination(
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, window string"),
        spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, size string"),
        window=5,
    ).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == brute(docs, items, 5)


def test_clean_rows_stay_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7), (1, "a b c d", 7), (2, "q r s t u", 8)], "doc_id long, text string, n_hit long")
    items = spark.createDataFrame([(1, "R, s T"), (1, "R, s T")], "item_id long, text string")
    kept = uncontaminated(docs, items, window=3)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d", 7)] * 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in contamination(docs, no_items).collect()] == [(2, 0)]
    assert contamination(none, items).count() == 0
    assert [(r.n_hit, r.item_ids) for r in contamination(docs, items).collect()] == [(2, ["1"])]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000 + "a b c"), (2, "z" * 1_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in contamination(docs, items).collect()) == [(1, 3), (2, 0)]


def test_final_sigma(spark):
    """Lower case of a letter does not hang on what stands beside its word."""
    from quire.llm.decontamination import contamination

    docs = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒ")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "ΟΔΟΣ ΑΒ")], "item_id long, text string")
    assert [(r.n_hit, r.item_ids) for r in contamination(docs, bench).collect()] == [(2, ["7"])]
