import math
import re
from collections import Counter
from zlib import crc32

import numpy as np

from quire.llm import suffix_tree as T
from quire.llm.queries import QUERIES
from tests.llm.brute import SPACE, az_lower

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return [*re.findall(SPACE, az_lower(text or "")), "\n"]


def test_base_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {i: crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(t for i, x in docs.items() if not out[i] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for r in QUERIES["op10_suffix_tree"](spark, sf_dir).collect():
        own = tokens(docs[r.doc_id])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(t in counts for t in own), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0


def corpus():
    rows = []
    for i in range(400):
        rows.append((i, f"the cat sat on the mat number{i % 3} so it goes", "x"))
        rows.append((1000 + i, f"a dog ran over the hill number{i % 5} so it went", "x"))
    return rows


def plain_score(tree, words):
    """Recursive probabilities from the tree's own counts, token by token."""
    ids = [tree.ids.get(w.encode(), -1) for w in words]
    total = 0.0
    for t, symbol in enumerate(ids):
        p, node = tree.base[symbol], 0
        for k in range(1, len(tree.levels) + 1):
            if t - k < 0 or ids[t - k] < 0:
                break
            level = tree.levels[k - 1]
            at = np.flatnonzero(level.key == node * tree.size + ids[t - k])
            if not len(at):
                break
            node = int(at[0])
            if level.kept[node]:
                c = level.count[level.entry == node * tree.size + symbol].sum()
                p = (c + (level.rest[node] + tree.smoothing) * p) / (level.total[node] + tree.smoothing)
        total += math.log10(p)
    return total


def test_tree_against_plain_counts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    texts = docs.select("text")
    tree = T.grow(texts, T._word_counts(texts))
    assert len(tree.levels) == 3 and all(level.kept.any() for level in tree.levels[:1])
    words = [t.encode() for t in ("the", "cat")]
    for k, gram in ((1, ("the",)), (2, ("on", "the"))):
        want = Counter()
        for _, text, _x in corpus():
            own = tokens(text)
            want.update(tuple(own[i : i + k + 1]) for i in range(len(own) - k) if tuple(own[i : i + k]) == gram)
        node = 0
        for level, word in zip(tree.levels, reversed(gram), strict=False):
            node = int(np.flatnonzero(level.key == node * tree.size + tree.ids[word.encode()])[0])
        level = tree.levels[k - 1]
        own = level.entry // tree.size == node
        names = {i: w for w, i in tree.ids.items()}
        got = {(*gram, names[e % tree.size].decode()): c for e, c in zip(level.entry[own].tolist(), level.count[own].tolist(), strict=True)}
        assert got == dict(want) and level.total[node] == sum(want.values())
    assert all(w in tree.ids for w in words)
    for r in T.scores(docs).filter("not held_out").limit(20).collect():
        own = T.grow(docs.filter(T.fold_of(docs.doc_id, 10) != 0).select("text"), T._word_counts(docs.filter(T.fold_of(docs.doc_id, 10) != 0)))
        assert abs(r.score - plain_score(own, tokens(r._doc.text))) < 1e-6
        break


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame(corpus(), SCHEMA).select("text")
    tree = T.grow(texts, T._word_counts(texts))
    known = np.arange(tree.size)
    unseen = 1 - tree.base.sum()
    for k in range(1, len(tree.levels) + 1):
        level = tree.levels[k - 1]
        for node in np.flatnonzero(level.kept)[:5]:
            chain = [np.full(tree.size, node)]
            for above in range(k, 1, -1):
                chain.insert(0, tree.levels[above - 1].key[chain[0]] // tree.size)
            p = T.probabilities(tree, known, chain, tree.base)
            left = T.probabilities(tree, np.array([-1]), [c[:1] for c in chain], np.array([unseen]))
            assert abs(p.sum() + left[0] - 1) < 1e-9


def test_better_than_unigrams_on_held_out_texts(spark):
    got = T.scores(spark.createDataFrame(corpus(), SCHEMA)).filter("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_edge_rows(spark):
    rows = [(None, None, "x"), (7, "", "x"), (7, "", "x"), (8, "w " * 300_000, "x"), (9, "z" * 500_000, "x"), (20, "ä Ä A a", "x")]
    got = T.scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert [r.n_tokens for r in got if r._doc.doc_id in (None, 7)] == [1, 1, 1]
    only = T.scores(spark.createDataFrame([(i, "a b", "x") for i in range(200) if crc32(str(i).encode()) % 10 == 0], SCHEMA)).collect()
    assert only and all(r.base_score == r.score == 0 and r.train_tokens == 0 for r in only)
    assert T.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joined_tree_is_the_same(spark):
    rows = [*corpus(), (None, None, "x"), (7, "", "x"), (7, "", "x"), (3, "w " * 3000, "x"), (20, "the unseen \u00c4 cat sat", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (str(r._doc.doc_id), r._doc.text or "")
    sent = sorted(T.scores(docs).collect(), key=key)
    joined = sorted(T.scores(docs, tree_tokens=0).collect(), key=key)
    assert len(sent) == len(joined) == len(rows)
    for a, b in zip(sent, joined, strict=True):
        assert a[:5] == b[:5]
        assert abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6


def test_rare_contexts_are_nodes(spark):
    # 160,000 tokens of other words: a passage that occurs twice is far below any share of them.
    filler = [(i, " ".join(f"f{(i * 40 + j) * 7919 % 90_001}" for j in range(40)), "x") for i in range(100, 4100)]
    own = [" ".join(f"{name}{j}" for j in range(20)) for name in ("once", "twice")]
    rows = [*filler, (1, own[0], "x"), (2, own[1], "x"), (3, own[1], "x")]
    got = {r._doc.doc_id: r for r in T.scores(spark.createDataFrame(rows, SCHEMA)).filter("_doc.doc_id < 4").collect()}
    total = got[1].train_tokens + 0.1 * (len({w for i, t, _ in rows for w in t.split() if crc32(str(i).encode()) % 10}) + 2)
    for doc, times in ((1, 1), (2, 2), (3, 2)):
        # Each word but the first has a context of one, two and three words that is always followed by it.
        p = [(times + 0.1) / total] * 20 + [(sum(crc32(str(i).encode()) % 10 != 0 for i, _, _ in rows) + 0.1) / total]
        for k in (1, 2, 3):
            p = [x if j < k else (times + 4 * x) / (times + 4) for j, x in enumerate(p)]
        assert abs(got[doc].score - sum(math.log10(x) for x in p)) < 1e-6


def test_pieces_and_split_contexts(spark):
    rows = [*corpus(), (None, None, "x"), (7, "", "x"), (7, "", "x"), (3, "w " * 3000, "x"), (20, "the unseen Ä cat sat", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (str(r._doc.doc_id), r._doc.text or "")
    sent = sorted(T.scores(docs).collect(), key=key)
    # Texts go over several pieces, and contexts over several buckets.
    cut = sorted(T.scores(docs, tree_tokens=0, piece=50, split=3).collect(), key=key)
    assert len(sent) == len(cut) == len(rows)
    for a, b in zip(sent, cut, strict=True):
        assert a[:5] == b[:5]
        assert abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6


def test_questions_are_small(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"f{(i * 40 + j) * 7919 % 90_001}" for j in range(400)), "x") for i in range(300)], SCHEMA)
    asked, solved = [], T._solved

    def seen(questions, *more):
        asked.append(questions.selectExpr("sum(length(data))").first()[0] or 0)
        return solved(questions, *more)

    monkeypatch.setattr(T, "_solved", seen)
    got = T.scores(docs, tree_tokens=0, piece=20_000).collect()
    # A token has a gram of four 8-byte numbers and a count; that took 24 bytes of shuffle at the longest contexts alone.
    assert len(got) == 300 and 0 < sum(asked) < 24 * sum(r.n_tokens for r in got)


def test_settled_contexts_are_not_sorted(spark, monkeypatch):
    # Each word occurs often, a pair of words hardly ever; so contexts of two words are known to their piece.
    some = np.random.default_rng(1)
    rows = [(i, " ".join(f"f{j}" for j in some.integers(0, 1000, 40)), "x") for i in range(1000)]
    docs = T.addressed(spark.createDataFrame(rows, SCHEMA).selectExpr("text", "1 as _train"))
    cut = T._stored(T._cut(docs, 1 << 20, 3), "pieces")
    answers = [T._numbered(cut, 4)]
    sums = answers[0].filter("key is not null").selectExpr("sum(sums[0])", "max(sums[1])").first()
    shape = T.Shape(4, 1 << 30, cut.selectExpr("sum(trained)").first()[0], int(sums[0]), int(sums[1]))

    def ask(grams):
        grams.longer()
        return grams.asked(0, 1)

    answers.append(T._solved(T._sent(cut, answers, shape, 0, ask, T.ASKED), 1, shape, 1))
    known = answers[0].unionByName(answers[1]).filter("piece is not null").select("level", "bucket", "piece", "data").toArrow()
    keys = []
    for name in ("_distinct", "_sorted"):
        own = getattr(T, name, None)
        if own:
            monkeypatch.setattr(T, name, lambda x, most, own=own: keys.append(len(x)) or own(x, most))
    tokens = again = 0
    pieces = cut.toArrow()
    for i in range(len(pieces)):
        row = pieces.slice(i, 1)
        grams = T.Grams(row, known.filter(T.pc.equal(known.column("piece"), row.column("piece")[0])), shape)
        tokens += len(grams.tokens)
        grams.longer()
        grams.learn()
        keys.clear()
        grams.longer()
        again += sum(keys)
    # What is sorted for contexts of two words.
    assert tokens == 41_000 and 0 < again < tokens / 4


def test_words_of_a_batch_are_its_tokens():
    texts = ["", None, " \t", "A b\x0bC\x0c\r\n", "\n\n", "one", " lead", "trail ", "\x1c\x85  Ä Z\x00z", "x" * 3000, "a a"]
    for column in (T.pa.array(texts), T.pa.array(["cut off", *texts, "too"]).slice(1, len(texts)), T.pa.array([""]), T.pa.array(["a"], T.pa.large_string())):
        want, ends = T.tokens_of(column)
        words, got = T._words(column)
        assert words.to_pylist() == want and got.tolist() == ends.tolist()
        assert T._lines(words).split(b" ") == want
