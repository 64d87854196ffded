import pytest

import corpus_pipeline as P
from __spark_entry__ import queries
from quire.llm.decontamination import contamination
from quire.llm.exact_dedup import exact_groups
from quire.llm.simhash import near_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_columns_and_sizes(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.columns == first.columns for s in stages[:-1])
    assert stages[-1].columns[: len(first.columns)] == first.columns
    sizes = [first.count(), *(s.count() for s in stages)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_decisions_take_effect(spark, stages):
    assert exact_groups(stages[1]).filter("not kept").isEmpty()
    assert near_groups(stages[2], **P.NEAR).filter("not first").isEmpty()
    assert contamination(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit > 0").isEmpty()
    assert stages[4].filter("mix_copies < 1 or mix_rate < 0").isEmpty()


def test_run_is_the_stages(spark, stages):
    got = queries()["pipeline"](spark, SF)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "mix_domain", "mix_copies").collect())
    assert key(got) == key(stages[-1])


def test_rows_with_nulls_and_clashing_names(spark, tmp_path):
    own = "doc_id long, text string, lang string, source string, n_chars long, _doc string, score int, kept string, fp int"
    rows = [(None, None, None, None, None, "a", 1, "b", 2), (1, "", "en", "s", 0, "a", 1, "b", 2)] + [(i, f"text number {i} " * 5, "en", "s", 9, "a", 1, "b", 2) for i in (3, 3, 4)]
    tables = {
        "documents": (rows, own),
        "labels": ([(1, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(None, None), (1, "quite other words than these")], "item_id long, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'x' as mix_rate", "1 as mix_copies", "2 as mix_domain")
    mixed = P.mixing(spark, docs, str(tmp_path))
    assert sorted(mixed.columns) == sorted(set(mixed.columns)) and dict(mixed.dtypes)["mix_rate"] == "double"
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 1, 3, 4} and all(r._doc == "a" and r.fp == 2 for r in got)
    for name, (_, schema) in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def made():
    """Documents of which each stage keeps some and drops some, with what must happen to them."""
    import random

    rng = random.Random(3)
    lexicon = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(lexicon, k=k))
    docs, toxic, labels = {}, set(), []
    for i in range(240):
        bad = i % 6 == 0
        docs[i] = text(60) + (" vilegrub filthspit gnarlscum" * 3 if bad else "")
        toxic |= {i} if bad else set()
        if i % 2 == 0:
            labels.append((i, i % 4 // 2, int(bad)))
    equal = {1000 + i: docs[i * 6 + 1] for i in range(10)}  # the larger id stays
    near = {}
    for i in range(10):
        words = docs[i * 6 + 2].split()
        # Very long texts, one word of many changed: at most two bits differ, or the brute force below says so.
        long = words * 200
        docs[i * 6 + 2] = " ".join(long)
        near[2000 + i] = " ".join([*long, "tail"])
    item = text(14)
    hit = {3000 + i: text(20) + " " + item + " " + text(20) for i in range(5)}
    return docs | equal | near | hit, toxic, set(equal), set(hit), labels, item


def test_each_stage_keeps_and_drops_what_it_should(spark, tmp_path):
    from tests.llm.brute import near_components, simhash

    docs, toxic, equal, hit, labels, item = made()
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [set(docs)]
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    clean, exact, near, plain = kept[1:]
    assert not clean & toxic and clean >= set(docs) - toxic
    groups = {}
    for i in clean:
        groups.setdefault(docs[i], []).append(i)
    assert exact == {max(g) for g in groups.values()} and len(exact) < len(clean)
    component = near_components({i: simhash(docs[i]) for i in exact}, 2)
    assert near == set(component.values()) and len(near) < len(exact)
    assert plain == near - hit and hit <= near
    last = P.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in last} <= plain and last
