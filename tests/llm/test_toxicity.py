import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm.queries import QUERIES
from quire.llm.toxicity import IDENTITY, buckets, fit, held_out, not_toxic, scored, swapped, words_of

SCHEMA = "doc_id long, text string, label int, score string"


def sentences(rng, n):
    """Toxic ones hold an insult. Labels lean: most insults name one group, neutral mentions the other."""
    plain = [f"word{i}" for i in range(200)]
    for i in range(n):
        toxic = rng.random() < 0.3
        own = rng.sample(plain, 8)
        if toxic:
            own.insert(rng.randrange(8), rng.choice(["idiot", "moron", "scum"]))
        if rng.random() < (0.8 if toxic else 0.05):
            own.insert(rng.randrange(8), "muslim")
        elif rng.random() < 0.3:
            own.insert(rng.randrange(8), "christian")
        yield i, " ".join(own) + ".", int(toxic), "x"


def test_swapping_holds_groups_together(spark):
    rows = spark.createDataFrame(list(sentences(random.Random(1), 1500)), SCHEMA)
    texts = ["The muslim reads word1.", "The christian reads word1.", "The muslim is an idiot.", "word3 word4"]
    ask = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], SCHEMA)

    def scores(**options):
        return {r._doc.doc_id: r.score for r in scored(ask, fit(rows, **options)).collect()}

    fair, blunt = scores(penalty=5.0), scores(penalty=0.0)
    assert abs(fair[0] - fair[1]) < abs(blunt[0] - blunt[1]) and abs(fair[0] - fair[1]) < 0.05
    assert fair[0] < 0.5 < fair[2] and fair[3] < 0.5


def plain_loss(model, rows, penalty, ridge):
    """The regularised loss, every swap of every sentence by itself."""

    def logit(words, w, b):
        return b + sum(w[p] for p in {model.places[k] for word in words for k in buckets(word) if k in model.places})

    texts = sorted({(t, y) for _, t, y, _x in rows})
    count = Counter(y for _, y in texts)

    def loss(w, b):
        total, changes = 0.5 * ridge * float(w @ w), []
        for text, y in texts:
            own = logit(words_of(text.encode()), w, b)
            total += 0.5 / count[y] * np.log1p(np.exp(-own if y else own))
            whole = set(words_of(text.encode()))
            place = lambda words: {model.places[k] for word in words for k in buckets(word) if k in model.places}
            changes += [logit(copy, w, b) - own for copy in swapped(text.encode(), IDENTITY) if place(copy) != place(whole)]
        return total + 0.5 * penalty * sum(c * c for c in changes) / max(len(changes), 1)

    return loss


def test_weights_and_scores_against_the_plain_loss(spark):
    rows = list(sentences(random.Random(2), 300))
    # Repeated sentences: the same change counts as often as it is made.
    rows += [(900 + i, f"word{i} muslim here. A muslim there. One more muslim. An old man.", i % 2, "") for i in range(6)]
    ridge = 0.01
    model = fit(spark.createDataFrame(rows, SCHEMA), penalty=2.0, ridge=ridge)
    loss = plain_loss(model, rows, 2.0, ridge)
    least, rng = loss(model.weights, model.bias), np.random.default_rng(1)
    for size in (0.3, 0.03):
        for _ in range(12):
            step = rng.normal(size=len(model.weights) + 1)
            step *= size / np.linalg.norm(step)
            assert loss(model.weights + step[1:], model.bias + step[0]) > least - 1e-9
    ask = spark.createDataFrame(rows[:40], SCHEMA)
    for r in scored(ask, model).collect():
        at = {model.places[k] for word in words_of(r._doc.text.encode()) for k in buckets(word) if k in model.places}
        assert abs(r.score - 1 / (1 + np.exp(-model.bias - sum(model.weights[p] for p in at)))) < 1e-9


def test_a_long_text_sends_few_changes(spark):
    """A hundred thousand sentences with identity terms and the same text once weigh the same, as their changes do."""
    base = list(sentences(random.Random(3), 200))
    last = "A muslim reads. A man reads."
    once, often = (fit(spark.createDataFrame([*base, (999, text, 0, "")], SCHEMA), penalty=0.0) for text in (last, last * 50_000))
    assert once.places == often.places and np.allclose(once.weights, often.weights)
    assert fit(spark.createDataFrame([*base, (999, last * 50_000, 0, "")], SCHEMA), penalty=5.0).places == once.places


def test_swapped_sentences():
    copies = swapped(b"A muslim here. A man there!", (("muslim", "jewish", "hindu"), ("man", "woman")))
    assert sorted(b" ".join(sorted(c)).decode() for c in copies) == sorted(
        " ".join(sorted(t.split())) for t in ("a jewish here man there", "a hindu here man there", "a muslim here woman there")
    )
    assert words_of("Ärger! IDIOT's".encode()) == ["Ärger".encode(), b"idiot", b"s"]


def test_edge_rows(spark):
    rows = spark.createDataFrame([(1, "bad idiot", 1, ""), (2, None, 0, ""), (3, "x", None, "")] * 4, SCHEMA)
    ask = spark.createDataFrame([(None, None, 1, ""), (5, "", 1, ""), (6, "idiot " * 200_000, 1, "")] * 2, SCHEMA)
    got = scored(ask, fit(rows)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert not_toxic(ask, fit(rows)).columns == ask.columns


def test_no_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    ask = spark.createDataFrame([(1, "text", 0, "")], SCHEMA)
    assert [r.score for r in scored(ask, fit(none)).collect()] == [0.25]
    assert scored(none, fit(none)).count() == 0


def test_query(spark, sf_dir):
    got = QUERIES["op1_toxicity"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count()
    assert got.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").isEmpty()
    assert got.filter(F.col("held_out") != held_out(F.col("doc_id"))).isEmpty()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = {r.toxic: r.right for r in got.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).collect()}
    assert right[0] > 0.97 and right[1] > 0.85


def test_few_labels_keep_clean_texts(spark):
    """The number of labels does not switch the classifier off; telling words weigh on a small table too."""
    rows = spark.createDataFrame([(i, t, y, "x") for i, t, y, _ in sentences(random.Random(2), 80)], SCHEMA)
    ask = spark.createDataFrame([(i, f"word{i} word{i + 1} word{i + 2}", None, "") for i in range(40)] + [(99, "idiot scum moron", None, "")], SCHEMA)
    kept = {r.doc_id for r in not_toxic(ask, fit(rows)).collect()}
    assert len(kept) >= 36 and 99 not in kept


def test_nothing_telling_gives_the_share(spark):
    rows = spark.createDataFrame([(i, f"only{i}", int(i % 5 == 0), "x") for i in range(50)], SCHEMA)
    model = fit(rows)
    assert not model.places and [round(r.score, 3) for r in scored(rows.limit(1), model).collect()] == [round(10.5 / 52, 3)]


def test_every_sentence_is_swapped():
    text = b"A man walks. " * 100
    assert len(swapped(text, (("man", "woman"),))) == 100
