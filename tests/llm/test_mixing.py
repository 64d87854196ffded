import numpy as np
from pyspark.sql import functions as F

from quire.llm.mixing import mixed, repeats
from quire.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, rate string"
LABELLED = [("alpha beta gamma " * 5, "a"), ("alpha gamma delta " * 5, "a"), ("un deux trois " * 5, "b"), ("deux quatre un " * 5, "b"), ("x", None)]


def labelled(spark):
    return spark.createDataFrame(LABELLED * 5, "text string, domain string")


def test_totals_match_targets(spark):
    docs = [(i, "alpha beta delta " * (1 + i % 7), "x") for i in range(60)] + [(100 + i, "un trois quatre " * (1 + i % 5), "x") for i in range(20)]
    docs += [(200, "alpha un beta deux " * 6, "x"), (201, None, "x"), (201, "", "x")]
    rows = mixed(spark.createDataFrame(docs, SCHEMA), labelled(spark), {"a": 0.5, "b": 0.5}).collect()
    assert len(rows) == len(docs)
    p, tokens, rate = np.array([r.p for r in rows]), np.array([r.tokens for r in rows]), np.array([r.rate for r in rows])
    total = (rate * tokens) @ p
    assert np.allclose(total, total.mean(), rtol=1e-2) and rate.min() >= 0
    assert np.allclose(p.sum(1), 1)


def test_against_plain_projected_gradient(spark):
    """The fitted objective is as low as that of many plain steps on one machine."""
    docs = [(i, ("alpha " * (i % 5) + "un " * (i % 3) + "word ") * 3, "x") for i in range(40)]
    targets = {"a": 0.2, "b": 0.8}
    rows = mixed(spark.createDataFrame(docs, SCHEMA), labelled(spark), targets, max_rate=3.0, steps=200, tolerance=1e-9).collect()
    p, tokens = np.array([r.p for r in rows]), np.array([float(r.tokens) for r in rows])
    plain = tokens @ p
    share = np.array([0.2, 0.8])
    wanted = share * (plain / share).max()
    loss = lambda r: (((r * tokens) @ p - wanted) ** 2 / plain).sum()
    rate = np.ones(len(rows))
    for _ in range(20_000):
        rate = np.clip(rate - 0.5 * p @ (((rate * tokens) @ p - wanted) / plain), 0, 3.0)
    assert loss(np.array([r.rate for r in rows])) <= loss(rate) * 1.01 + 1e-3


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], SCHEMA)
    none = spark.createDataFrame([], "text string, domain string")
    assert [r.rate for r in mixed(docs, none).collect()] == [1.0, 1.0]
    assert mixed(docs.limit(0), labelled(spark)).count() == 0
    assert mixed(docs, labelled(spark), {"other": 1.0}).count() == 2


def test_repeats_keep_the_sum(spark):
    got = spark.range(20_000).select(repeats(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1.3) < 0.02 and tuple(got[1:]) == (1, 2)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_mixing"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.agg(F.count("*"), F.avg(F.col("domain").startswith(F.col("lang")).cast("int")), F.min("rate")).first()
    assert row[0] == 1000 and row[1] > 0.95 and row[2] >= 0


def test_scarce_domain_meets_its_target(spark, caplog):
    """A domain of about one token in sixty gets half of the mix: rates above any fixed cap."""
    docs = [(i, "alpha beta delta gamma " * 6, "x") for i in range(120)] + [(900 + i, "un trois quatre deux " * 6, "x") for i in range(2)]
    rows = mixed(spark.createDataFrame(docs, SCHEMA), labelled(spark), {"a": 0.5, "b": 0.5}).collect()
    p, tokens, rate = np.array([r.p for r in rows]), np.array([r.tokens for r in rows]), np.array([r.rate for r in rows])
    total = (rate * tokens) @ p
    assert np.allclose(total / total.sum(), 0.5, rtol=1e-2) and rate.max() > 8
    assert not caplog.records
    mixed(spark.createDataFrame(docs, SCHEMA), labelled(spark), {"a": 0.5, "b": 0.5}, max_rate=2.0)
    assert any("tokens by domain" in r.getMessage() for r in caplog.records)


def test_soft_posteriors_reach_their_targets(spark, monkeypatch, caplog):
    """Domains that overlap widely: plain steps need thousands of passes, and rates are written on the way."""
    import quire.llm.mixing as M

    rng = np.random.default_rng(1)
    for k, spread, share in ((2, 0.7, [0.25, 0.75]), (4, 1.0, [0.1, 0.2, 0.3, 0.4])):
        z = np.exp(rng.normal(0, spread, (2000, k)))
        rows = [(i, int(t), (x / x.sum()).tolist()) for i, (t, x) in enumerate(zip(rng.integers(10, 500, 2000), z, strict=True))]
        given = spark.createDataFrame(rows, "id long, tokens long, p array<double>").selectExpr("struct(id) as _doc", "tokens", "p")
        names = [f"d{i}" for i in range(k)]
        monkeypatch.setattr(M, "learn", lambda labelled: M.Classifier(names, np.zeros(k), np.zeros((1, k))))  # noqa: B023
        monkeypatch.setattr(M, "posteriors", lambda *a: given)  # noqa: B023
        monkeypatch.setattr(M, "HELD", 7)
        caplog.clear()
        got = mixed(given, given, dict(zip(names, share, strict=True))).collect()
        p, tokens, rate = np.array([r.p for r in got]), np.array([r.tokens for r in got]), np.array([r.rate for r in got])
        total = (rate * tokens) @ p
        assert np.allclose(total / total.sum(), share, atol=2e-4) and rate.min() >= 0 and not caplog.records


def test_any_language_has_a_target():
    from quire.llm.mixing import language_targets

    got = language_targets(["it/good", "it/poor", "other/good", "zh/x/good", "zh/x/poor"])
    assert {k: round(v, 9) for k, v in got.items()} == {"it/good": 0.9, "it/poor": 0.1, "other/good": 1.0, "zh/x/good": 0.9, "zh/x/poor": 0.1}


def test_clean_documents_of_an_unlisted_language_stay(spark, tmp_path):
    import corpus_pipeline as P

    own = [(i, "uno due tre quattro " * 5, "it") for i in range(20)] + [(100 + i, "one two three four " * 5, "en") for i in range(20)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in own], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in P.mixing(spark, docs, str(tmp_path)).collect()} == {i for i, _, _ in own}
