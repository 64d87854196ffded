import random

import pytest

from quire.llm.queries import QUERIES
from quire.llm.simhash import components, links, near_groups, near_kept
from tests.llm.brute import near_components, simhash


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: simhash(t) for i, t in docs.items()}
    groups = near_components(want)
    got = QUERIES["op4_simhash_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (i, f"{f:016x}", groups[i]) for i, f in want.items()
    )


@pytest.mark.parametrize(("distance", "groups", "block"), [(2, 4, 2), (4, 7, 1)])
@pytest.mark.parametrize("bucket", [1, 4, 10_000])
def test_links_lose_nothing(spark, distance, groups, block, bucket):
    """Clusters of close words, paired or covered, give the components of brute force."""
    rng = random.Random(bucket)
    words = {0, (1 << 64) - 1, 1 << 63, 3}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(8):
            words.add(centre)
            for bit in rng.sample(range(64), rng.randint(1, distance + 1)):
                centre ^= 1 << bit
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    edges = links(spark.createDataFrame([(w,) for w in signed], "fp long"), distance, groups, bucket, block)
    for r in edges.collect():
        assert r.a < r.b and ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= distance
    got = {r.fp: r.root for r in components(edges).collect()}
    want = near_components({w: w & (2**64 - 1) for w in signed}, distance)
    assert {w: got.get(w, w) for w in signed} == want


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (9, None), (7, ""), (None, " \t"), (1, "Ä b"), (2, "ä b"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, first int")
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r._doc.text): r.component_id for r in got}
    assert by[5, text] == 3 and by[9, None] == 7 and by[None, " \t"] == 7
    assert by[1, "Ä b"] == 1 and by[2, "ä b"] == 2
    kept = near_kept(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_groups(docs).count() == 0


def test_long_text_and_single_word(spark):
    rows = [(1, "a " * 300_000), (2, "x" * 1_000_000), (3, "one"), (4, "one two")]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: simhash(t) for i, t in rows}
